"""Conditions on arcs and vertices, from the nested dictionaries and tuples of queries to columns.

Anything that asks for further arcs (adjacent, traverse, conditional degrees) is left to the query planner, which this
module hands back as a list of hops.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import Scope, compile_expression, cosine
from ..operators.vectors import fingerprint, fingerprint_longs, hamming

COMPARISONS = ("V_LTE", "V_LT", "V_GTE", "V_GT", "V_EQ", "V_NEQ")
DIRECTIONS = ("D_IN", "D_OUT", "D_ANY", "D_BOTH")


class ConditionError(ValueError):
    """A condition that the language does not have."""


def compare(x: Column, cond, prev: Column | None = None) -> Column:
    """A value condition: a bare value, (V_LT, v), (V_RANGE, (a, b)), or V_DYN_* against the previous hop's value."""
    if not isinstance(cond, tuple):
        if isinstance(cond, str) and cond == "*":
            return x.isNotNull()
        if isinstance(cond, str) and cond.endswith("*"):
            return F.startswith(x, F.lit(cond[:-1]))
        return x == F.lit(cond)
    if len(cond) == 1:
        return compare(x, cond[0], prev)
    op, v = cond
    if op is False:
        return ~F.coalesce(compare(x, v, prev), F.lit(False))
    if op in COMPARISONS:
        if isinstance(v, str) and v.endswith("*") and op in ("V_EQ", "V_NEQ"):
            hit = F.startswith(x, F.lit(v[:-1]))
            return hit if op == "V_EQ" else ~hit
        return {"V_LTE": x <= v, "V_LT": x < v, "V_GTE": x >= v, "V_GT": x > v, "V_EQ": x == F.lit(v), "V_NEQ": x != F.lit(v)}[op]
    if not isinstance(op, str):
        raise ConditionError(f"unknown value condition {op!r}")
    if op == "V_RANGE":
        return x.between(*v)
    if op == "V_NRANGE":
        return (x < v[0]) | (x > v[1])
    if op.startswith("V_DYN_"):
        if prev is None:
            return F.lit(False)
        if op == "V_DYN_DELTA":
            return x.between(prev + v[0], prev + v[1])
        if op == "V_DYN_RATIO":
            return x.between(prev * v[0], prev * v[1])
    raise ConditionError(f"unknown value condition {op}")


@dataclass
class ArcFilter:
    """(relationship, direction, modifier, value condition, value), shorter forms, a bare relationship, or (False, filter)."""

    rel: str | None = None
    dir: str = "D_OUT"
    mod: str | None = None
    value: object = None
    negated: bool = False

    @staticmethod
    def of(spec, default: str = "D_OUT") -> ArcFilter:
        if spec is None:
            return ArcFilter(dir=default)
        if isinstance(spec, ArcFilter):
            return spec
        if isinstance(spec, str):
            return ArcFilter(dir=spec) if spec in DIRECTIONS else ArcFilter(rel=spec, dir=default)
        if spec and spec[0] is False:
            inner = ArcFilter.of(spec[1], default)
            return ArcFilter(inner.rel, inner.dir, inner.mod, inner.value, not inner.negated)
        spec = tuple(spec) + (None,) * (5 - len(spec))
        value = None
        if spec[3] is not None:
            value = (spec[3], spec[4])
        return ArcFilter(spec[0], spec[1] or default, None if spec[2] in (None, "M_ANY") else spec[2], value)

    def column(self, arc: str, prev: str | None = None) -> Column:
        """Whether the arc struct passes; a dynamic value condition misses without a previous arc of the same modifier."""
        c = lambda f: F.col(f"{arc}.{f}")
        hit = F.lit(True)
        if self.rel not in (None, "*"):
            hit = hit & (c("rel") == self.rel)
        if self.mod:
            hit = hit & (c("mod") == self.mod)
        if self.value is not None:
            op, v = self.value
            if self.mod == "M_LSH" and isinstance(v, tuple) and op not in ("V_RANGE", "V_NRANGE"):
                # (bits, distance): the condition holds for the number of bits in which the arc's value differs.
                apart = F.bit_count(c("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.lit(int(v[0]) & 0xFFFFFFFF).cast("long")))
                hit = hit & compare(apart, (op, int(v[1])))
            elif isinstance(op, str) and op.startswith("V_DYN_") and prev:
                same = c("mod") == F.col(f"{prev}.mod")
                old = F.col(f"{prev}.value")
                plain = op.replace("DYN_", "")
                hit = hit & same & (compare(c("value"), (op, v), old) if op in ("V_DYN_DELTA", "V_DYN_RATIO") else compare(c("value"), (plain, old)))
            else:
                hit = hit & compare(c("value"), self.value)
        return ~F.coalesce(hit, F.lit(False)) if self.negated else hit


@dataclass
class Hop:
    """A nested block: its arc filter, the condition on the vertices it reaches and what to do with them."""

    arc: ArcFilter
    neighbor: object = None
    filter: str | None = None
    collect: object = None
    forced: bool | None = None
    semi: bool = True
    negated: bool = False


@dataclass
class VertexCondition:
    """A compiled condition: a column for the vertex itself, and hops that must reach something."""

    column: Column
    hops: list[Hop] = field(default_factory=list)
    degree_hops: list[tuple[ArcFilter, object]] = field(default_factory=list)
    post: Column | None = None
    needs_degrees: bool = False
    negated: bool = False
    #: Whether nothing in it looks back at the path, so that it can be decided for each vertex once.
    local: bool = True
    #: trivial asks nothing; bare asks nothing of the vertex itself, only of what it is linked to.
    trivial: bool = False
    bare: bool = False


LOOKS_BACK = re.compile(r"\b(prev|next|synarc|arc)\b|\.arc\b")


def hop_of(spec, semi: bool) -> Hop:
    if isinstance(spec, (tuple, str)) and not (isinstance(spec, tuple) and spec and spec[0] is False and isinstance(spec[1], dict)):
        return Hop(ArcFilter.of(spec, "D_ANY"), semi=semi)
    negated = isinstance(spec, tuple)
    spec = spec[1] if negated else spec
    return Hop(ArcFilter.of(spec.get("arc"), "D_ANY"), spec.get("neighbor"), spec.get("filter"), spec.get("collect"), spec.get("assert"), semi, negated)


def vertex_condition(spec, at: str, scope: Scope, now: int = 0) -> VertexCondition:
    """spec: None, an id (with * at its end: a prefix), a list of ids, a dictionary, or (False, spec)."""
    c = lambda f: F.col(f"{at}.{f}")
    if spec is None or spec == "*":
        return VertexCondition(F.lit(True), trivial=True)
    if isinstance(spec, tuple) and len(spec) == 2 and spec[0] is False:
        inner = vertex_condition(spec[1], at, scope, now)
        if inner.hops or inner.degree_hops:
            inner.negated = not inner.negated
            return inner
        inner.column = ~F.coalesce(inner.column, F.lit(False))
        return inner
    if isinstance(spec, str):
        return VertexCondition(compare(c("id"), spec))
    if isinstance(spec, (list, set)):
        exact = [x for x in spec if not x.endswith("*")]
        hit = c("id").isin(exact) if exact else F.lit(False)
        for x in spec:
            if x.endswith("*"):
                hit = hit | F.startswith(c("id"), F.lit(x[:-1]))
        return VertexCondition(hit)

    out = VertexCondition(F.lit(True))
    spec = dict(spec)
    traverse = {k: spec.pop(k) for k in ("arc", "neighbor", "collect", "assert") if k in spec}
    if traverse:
        spec["traverse"] = {**(spec.get("traverse") or {}), **traverse}
    adjacent = {k[4:]: spec.pop(k) for k in ("has_arc", "has_neighbor") if k in spec}
    if adjacent:
        spec["adjacent"] = {**(spec.get("adjacent") or {}), **adjacent}
    out.bare = set(spec) <= {"adjacent", "traverse"}
    for key, want in spec.items():
        if key == "virtual":
            hit = c("virtual") == F.lit(bool(want))
        elif key == "type":
            hit = F.lit(True) if want == "*" else c("type").isNull() if want in (None, "__vertex__") else ~F.coalesce(c("type") == want[1], F.lit(False)) if isinstance(want, tuple) else c("type") == want
        elif key in ("degree", "indegree", "outdegree"):
            name = {"degree": "deg", "indegree": "ideg", "outdegree": "odeg"}[key]
            if isinstance(want, tuple) and len(want) == 2 and not (isinstance(want[0], str) and want[0].startswith("V_")):
                default = {"degree": "D_ANY", "indegree": "D_IN", "outdegree": "D_OUT"}[key]
                out.degree_hops.append((ArcFilter.of(want[0], default), want[1]))
                continue
            out.needs_degrees = True
            hit = compare(c(name), want)
        elif key == "id":
            hit = vertex_condition(want, at, scope, now).column
        elif key in ("abstime", "reltime"):
            hit = F.lit(True)
            for which, cond in want.items():
                x = c({"created": "tmc", "modified": "tmm", "expires": "tmx"}[which])
                hit = hit & compare(x if key == "abstime" else x - now, cond)
        elif key == "similarity":
            probe = F.array(*[F.lit(float(v)) for v in want["vector"]])
            hit = c("vector").isNotNull()
            unknown = set(want) - {"vector", "score", "hamdist"}
            if unknown:
                raise ConditionError(f"unknown similarity condition {unknown}")
            if "hamdist" in want:
                own = F.lit(fingerprint_longs([want["vector"]])[0])
                hit = hit & compare(hamming(fingerprint(c("vector")), own), want["hamdist"])
            if "score" in want:
                hit = hit & compare(cosine(c("vector"), probe), want["score"])
        elif key == "property":
            if not isinstance(want, dict):
                want = {want: "*"}
            hit = F.lit(True)
            for name, cond in want.items():
                kind = scope.property_types.get(name, "real")
                x = F.try_element_at(c("text") if kind == "str" else c("num"), F.lit(name))
                hit = hit & F.coalesce(compare(x, cond), F.lit(False))
        elif key == "filter":
            hit = compile_expression(want, Scope(**{**scope.__dict__, "vertex": at, "next": None})).truth()
            out.local = out.local and not LOOKS_BACK.search(want)
            out.needs_degrees = out.needs_degrees or "deg" in want
        elif key == "post":
            out.post = compile_expression(want, Scope(**{**scope.__dict__, "vertex": at, "next": None})).truth()
            out.local = out.local and not LOOKS_BACK.search(want)
            continue
        elif key == "adjacent":
            out.hops.append(hop_of(want, True))
            continue
        elif key == "traverse":
            out.hops.append(hop_of(want, False))
            continue
        else:
            raise ConditionError(f"unknown condition {key}")
        out.column = out.column & hit
    return out
