"""Changes of a graph as new graphs: batches of arcs or vertices are merged by key, the later one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conditions import ArcFilter
from .graph import ARC_COLUMNS, NEVER, VERTEX_COLUMNS, Graph, conform

ARC_KEY = ("tail", "head", "rel", "mod")


def latest(old: DataFrame, new: DataFrame, keys: tuple[str, ...], summed: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: that of the later table; values of modifiers in `summed` are added up.

    Of several new rows with one key the greatest counts, by its other columns in their order.
    """
    rest = [c for c in old.columns if c not in keys]
    every = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    plain = [c for c, t in old.dtypes if c in rest and not t.startswith("map")]  # maps have no order
    out = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__turn", *plain)).alias("row"), *([F.sum("value").alias("total")] if summed else []))
    if summed:
        return out.select(*keys, F.when(F.col("mod").isin(*summed), F.col("total")).otherwise(F.col("row.value")).alias("value"), *[f"row.{c}" for c in rest if c != "value"])
    return out.select(*keys, "row.*")


def connect(graph: Graph, arcs: DataFrame, lifespan: int | None = None, condition=None, timestamps: bool = False) -> Graph:
    """Merges arcs: counters and accumulators add up, creation times stay, others are replaced. Heads without a vertex become virtual ones.

    With a lifespan (seconds from the graph's time) each pair and relationship also gets the time of its end, M_TMX;
    with timestamps those of its making and last change, M_TMC and M_TMM. With a condition only arcs between pairs
    that already have an arc which passes that filter are merged.
    """
    arcs = conform(arcs, ARC_COLUMNS)
    if condition is not None:
        spec = ArcFilter.of(condition)
        there = graph.arcs.withColumn("__arc", F.struct("rel", "mod", "value")).filter(spec.column("__arc")).select("tail", "head").distinct()
        arcs = arcs.join(there, ["tail", "head"], "left_semi").select(*ARC_COLUMNS)
    times = ([("M_TMC", graph.now), ("M_TMM", graph.now)] if timestamps else []) + ([("M_TMX", graph.now + lifespan)] if lifespan is not None else [])
    if times:
        pairs = arcs.filter(~F.col("mod").isin("M_TMC", "M_TMM", "M_TMX")).select("tail", "rel", "head").distinct()
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("mod"), F.lit(float(v)).alias("value")) for m, v in times]))
        arcs = arcs.unionByName(pairs.withColumn("t", each).select("tail", "rel", "t.mod", "t.value", "head"))
    known = graph.arcs.filter("mod = 'M_TMC'").select(*ARC_KEY)
    arcs = arcs.join(known, list(ARC_KEY), "left_anti")
    merged = latest(graph.arcs, arcs, ARC_KEY, ("M_CNT", "M_ACC")).select(*ARC_COLUMNS)
    ends = arcs.select(F.explode(F.array("tail", "head")).alias("id")).distinct().join(graph.vertices, "id", "left_anti")
    fresh = conform(ends.withColumn("virtual", F.lit(True)), VERTEX_COLUMNS)
    return graph.with_(vertices=graph.vertices.unionByName(fresh), arcs=merged)


def create_vertices(graph: Graph, vertices: DataFrame) -> Graph:
    """Merges vertices as real ones; a row without properties leaves the earlier ones."""
    new = conform(vertices, VERTEX_COLUMNS)
    every = graph.vertices.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    plain = [c for c in VERTEX_COLUMNS if c not in ("id", "num", "text")]
    out = every.groupBy("id").agg(F.max_by(F.struct(*plain), "__turn").alias("row"), *[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("__turn"))).alias(m) for m in ("num", "text")])
    return graph.with_(vertices=out.select("id", "row.*", "num", "text"))


def disconnect(graph: Graph, arc=None, tails: DataFrame | None = None, heads: DataFrame | None = None) -> Graph:
    """Drops arcs that pass a filter, of these tails and heads where given."""
    test = F.coalesce(ArcFilter.of(arc).column("__arc"), F.lit(False))
    rows = graph.arcs.withColumn("__arc", F.struct("rel", "mod", "value"))
    hit = rows.filter(test)
    if tails is not None:
        hit = hit.join(tails.select(F.col("id").alias("tail")), "tail", "left_semi")
    if heads is not None:
        hit = hit.join(heads.select(F.col("id").alias("head")), "head", "left_semi")
    if tails is None and heads is None:
        return graph.with_(arcs=rows.filter(~test).drop("__arc"))
    return graph.with_(arcs=graph.arcs.join(hit.select(*ARC_KEY), list(ARC_KEY), "left_anti"))


def delete_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """Drops vertices and their outgoing arcs; those that others still point to stay as virtual vertices."""
    ids = ids.select("id").distinct()
    arcs = graph.arcs.join(ids.select(F.col("id").alias("tail")), "tail", "left_anti").select(*ARC_COLUMNS)
    pointed = arcs.select(F.col("head").alias("id")).distinct()
    stay = graph.vertices.join(ids, "id", "left_anti")
    virtual = conform(ids.join(pointed, "id", "left_semi").withColumn("virtual", F.lit(True)), VERTEX_COLUMNS)
    return graph.with_(vertices=stay.unionByName(virtual), arcs=arcs)


def truncate(graph: Graph, type: str | None = None) -> Graph:
    if type is None:
        return graph.with_(vertices=graph.vertices.filter(F.lit(False)), arcs=graph.arcs.filter(F.lit(False)))
    return delete_vertices(graph, graph.vertices.filter(F.col("type") == type).select("id"))


def set_property(graph: Graph, key: str, values: DataFrame, text: bool = False) -> Graph:
    """values: id, value. Sets one property, keeping the others."""
    column, kind = ("text", "string") if text else ("num", "double")
    joined = graph.vertices.join(values.select("id", F.col("value").cast(kind).alias("__v")), "id", "left")
    old = F.coalesce(F.map_filter(F.col(column), lambda k, v: k != key), F.create_map().cast(f"map<string,{kind}>"))
    new = F.when(F.col("__v").isNotNull(), F.map_concat(old, F.create_map(F.lit(key), F.col("__v")))).otherwise(F.col(column))
    return graph.with_(vertices=joined.withColumn(column, new).drop("__v"), property_types={**graph.property_types, key: "str" if text else "real"})


def set_column(graph: Graph, column: str, values: DataFrame) -> Graph:
    """values: id, value. Sets type, tmx, c0, c1 or vector of some vertices."""
    joined = graph.vertices.join(values.select("id", F.col("value").alias("__v")), "id", "left")
    return graph.with_(vertices=joined.withColumn(column, F.coalesce(F.col("__v").cast(VERTEX_COLUMNS[column]), F.col(column))).drop("__v"))


def inc_property(graph: Graph, key: str, amounts: DataFrame) -> Graph:
    """amounts: id, value. Adds to a numeric property; one that a vertex lacks starts at 0."""
    old = graph.vertices.select("id", F.coalesce(F.try_element_at("num", F.lit(key)), F.lit(0.0)).alias("__old"))
    sums = amounts.groupBy("id").agg(F.sum("value").alias("value")).join(old, "id").select("id", (F.col("__old") + F.col("value")).alias("value"))
    kind = graph.property_types.get(key, "real")
    return set_property(graph, key, sums).with_(property_types={**graph.property_types, key: kind})


def remove_property(graph: Graph, ids: DataFrame, key: str | None = None) -> Graph:
    """Removes one property, or all, of some vertices."""
    marked = graph.vertices.join(ids.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    for column in ("num", "text"):
        left = F.map_filter(F.col(column), lambda k, v: k != key) if key is not None else F.lit(None).cast(VERTEX_COLUMNS[column])
        marked = marked.withColumn(column, F.when(F.col("__gone"), left).otherwise(F.col(column)))
    return graph.with_(vertices=marked.drop("__gone"))


def set_rank(graph: Graph, ranks: DataFrame) -> Graph:
    """ranks: id, c1, c0."""
    return set_column(set_column(graph, "c1", ranks.select("id", F.col("c1").alias("value"))), "c0", ranks.select("id", F.col("c0").alias("value")))


def set_expiration(graph: Graph, times: DataFrame) -> Graph:
    """times: id, value, in seconds of the epoch."""
    return set_column(graph, "tmx", times)


def clear_expiration(graph: Graph, ids: DataFrame) -> Graph:
    return set_column(graph, "tmx", ids.select("id", F.lit(NEVER).alias("value")))


def remove_vector(graph: Graph, ids: DataFrame) -> Graph:
    """Takes the vectors of some vertices away."""
    marked = graph.vertices.join(ids.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    return graph.with_(vertices=marked.withColumn("vector", F.when(F.col("__gone").isNull(), F.col("vector"))).drop("__gone"))
