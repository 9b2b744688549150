"""Named functions over graphs, and the merge of partial results from several graphs."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


class PluginError(ValueError):
    """No such plugin, or parameters that it does not take."""


@dataclass
class Plugins:
    """Engines answer a request from one graph; pre and post plugins change the request and the response."""

    engines: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    before: dict[str, Callable[[dict], dict]] = field(default_factory=dict)
    after: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def add(self, name: str, engine: Callable | None = None, pre: Callable | None = None, post: Callable | None = None) -> None:
        for table, fn in ((self.engines, engine), (self.before, pre), (self.after, post)):
            if fn is not None:
                table[name] = fn

    def names(self) -> list[str]:
        return sorted({*self.engines, *self.before, *self.after})

    def call(self, name: str, graphs: Graph | list[Graph], sortkey: str | None = None, descending: bool = True, hits: int = -1, **request) -> DataFrame:
        """Runs the engine on each graph with parameters of its annotated types and merges the responses."""
        if name not in self.engines:
            raise PluginError(f"no plugin {name}")
        request = self.before[name](request) if name in self.before else request
        known = inspect.signature(self.engines[name]).parameters
        for key, value in request.items():
            if key not in known:
                raise PluginError(f"{name} takes no {key}")
            kind = known[key].annotation
            request[key] = {"int": int, "float": float, "str": str}.get(getattr(kind, "__name__", str(kind)), lambda x: x)(value)
        parts = [self.engines[name](g, **request) for g in (graphs if isinstance(graphs, list) else [graphs])]
        out = merged(parts, sortkey, descending, hits)
        return self.after[name](out) if name in self.after else out


def merged(parts: list[DataFrame], sortkey: str | None = None, descending: bool = True, hits: int = -1) -> DataFrame:
    """The best rows of several responses; ties go by the other columns."""
    out = reduce(DataFrame.unionByName, parts)
    if sortkey:
        key = F.col(sortkey).desc_nulls_last() if descending else F.col(sortkey).asc_nulls_last()
        out = out.orderBy(key, *[F.col(c) for c, t in out.dtypes if c != sortkey and not t.startswith("map")])
    return out.limit(hits) if hits >= 0 else out


def summed(parts: list[DataFrame]) -> DataFrame:
    """The sums of numeric columns of several one-row responses."""
    out = reduce(DataFrame.unionByName, parts)
    return out.agg(*[F.sum(c).alias(c) for c, t in out.dtypes if t in ("int", "bigint", "double", "float")])
