"""A property graph over the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph

PROPERTY_TYPES = {
    "name": "str", "segment": "str", "status": "str", "priority": "str", "brand": "str", "kind": "str", "acctbal": "real", "totalprice": "real", "retailprice": "real", "size": "int",
    "nationkey": "int", "lat": "real", "lon": "real", "label": "int",
}
#: Queries hold against this time, so that results don't change with the clock.
NOW = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertex(df: DataFrame, prefix: str, key: str, type: str, num: dict | None = None, text: dict | None = None, **more) -> DataFrame:
    pairs = lambda d, t: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.expr(v).cast(t))]) if d else F.lit(None)
    return df.select(
        F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(type).alias("type"), F.lit(False).alias("virtual"), *[(F.expr(more[c]) if c in more else F.lit(d)).cast(t).alias(c) for c, d, t in (("tmc", 0, "long"), ("tmm", 0, "long"), ("tmx", 4102444800, "long"), ("c1", 1.0, "double"), ("c0", 0.0, "double"))],
        (F.expr(more["vector"]) if "vector" in more else F.lit(None)).cast("array<double>").alias("vector"), pairs(num, "double").cast("map<string,double>").alias("num"), pairs(text, "string").cast("map<string,string>").alias("text"),
    )


def arc(df: DataFrame, tail: str, rel: str, mod: str, value: str, head: str) -> DataFrame:
    return df.select(F.expr(tail).alias("tail"), F.lit(rel).alias("rel"), F.lit(mod).alias("mod"), F.expr(value).cast("double").alias("value"), F.expr(head).alias("head"))


class Part:
    """Rows of one table as vertices or arcs: build makes them, keys says which column of the table an id stands for."""

    def __init__(self, rows: DataFrame, build, keys: dict[str, tuple[str, str]]):
        self.rows, self.build, self.keys = rows, build, keys

    def all(self) -> DataFrame:
        return self.build(self.rows)

    def at(self, end: str, id: str) -> DataFrame | None:
        """The rows of one id, by a filter on the table's own key, which reaches the file; None if the id is of another kind."""
        prefix, column = self.keys[end]
        rest = id[len(prefix) :]
        if not id.startswith(prefix) or not rest:
            return None
        if dict(self.rows.dtypes)[column] == "string":
            return self.build(self.rows.filter(F.col(column) == rest))
        return self.build(self.rows.filter(F.col(column) == int(rest))) if rest.isdigit() and str(int(rest)) == rest else None


def union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return none if out is None else out


#: Ends of the relationships: the tables that have their tails and heads as vertices.
ENDS = {"in_region": {"nation", "region"}, "in_nation": {"nation"}, "placed": {"customer", "orders"}, "contains": {"lineitem", "orders", "part"}, "did": {"events"}}


def star_graph(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> Graph:
    """customer, order, part, supplier, nation, region and user vertices with placed, contains, in_nation, in_region and
    did arcs; `only` names the tables to take. contains and did are multiple arcs."""
    t = lambda n: table(spark, sf_dir, n)
    want = lambda n: only is None or n in only
    vs: list[Part] = []
    arcs: list[Part] = []

    def add(rows: DataFrame, prefix: str, key: str, type: str, *rest, **more) -> None:
        vs.append(Part(rows, lambda df: vertex(df, prefix, key, type, *rest, **more), {"id": (prefix, key)}))

    def link(rows: DataFrame, tail: tuple[str, str], rel: str, mod: str, value: str, head: tuple[str, str], shape=lambda df: df) -> None:
        name = lambda e: f"'{e[0]}' || {e[1]}"
        arcs.append(Part(rows, lambda df: arc(shape(df), name(tail), rel, mod, value, name(head)), {"tail": tail, "head": head}))

    if want("region"):
        add(t("region"), "R", "r_regionkey", "region", text={"name": "r_name"})
    if want("nation"):
        n = t("nation")
        lat, lon = "(n_nationkey * 7) % 120 - 60", "(n_nationkey * 13) % 300 - 150"
        add(n, "N", "n_nationkey", "nation", {"nationkey": "n_nationkey", "lat": lat, "lon": lon}, {"name": "n_name"}, c1=lat, c0=lon)
        link(n, ("N", "n_nationkey"), "in_region", "M_STAT", "1", ("R", "n_regionkey"))
    if want("customer"):
        c = t("customer")
        add(c, "C", "c_custkey", "customer", {"acctbal": "c_acctbal", "nationkey": "c_nationkey"}, {"name": "c_name", "segment": "c_mktsegment"})
        link(c, ("C", "c_custkey"), "in_nation", "M_STAT", "1", ("N", "c_nationkey"))
    if want("supplier"):
        s = t("supplier")
        add(s, "S", "s_suppkey", "supplier", {"acctbal": "s_acctbal", "nationkey": "s_nationkey"}, {"name": "s_name"})
        link(s, ("S", "s_suppkey"), "in_nation", "M_STAT", "1", ("N", "s_nationkey"))
    if want("part"):
        add(t("part"), "P", "p_partkey", "part", {"size": "p_size", "retailprice": "p_retailprice"}, {"name": "p_name", "brand": "p_brand", "kind": "p_type"})
    if want("orders"):
        o = t("orders")
        add(o, "O", "o_orderkey", "order", {"totalprice": "o_totalprice"}, {"status": "o_orderstatus", "priority": "o_orderpriority"}, tmc="unix_timestamp(o_orderdate)", tmm="unix_timestamp(o_orderdate)")
        link(o, ("C", "o_custkey"), "placed", "M_FLT", "o_totalprice", ("O", "o_orderkey"))
    if want("lineitem"):
        lines = lambda df: df.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
        for mod, value in (("M_FLT", "price"), ("M_INT", "quantity"), ("M_CNT", "n")):
            link(t("lineitem"), ("O", "l_orderkey"), "contains", mod, value, ("P", "l_partkey"), lines)
    if want("events"):
        e = t("events")
        did = lambda df: df.groupBy("user_id", "event_type").agg(F.min(F.unix_timestamp("ts")).alias("begun"), F.max(F.unix_timestamp("ts")).alias("last"), F.count("*").alias("n"), F.sum("value").alias("value"))
        add(e.select("user_id").distinct(), "U", "user_id", "user")
        add(e.select("event_type").distinct(), "E", "event_type", "event")
        for mod, value in (("M_TMC", "begun"), ("M_TMX", "last + 86400000"), ("M_CNT", "n"), ("M_ACC", "value")):
            link(e, ("U", "user_id"), "did", mod, value, ("E", "event_type"), did)
    if want("embeddings"):
        add(t("embeddings"), "V", "vec_id", "embedding", {"label": "label"}, vector="embedding")
    no_vertex = spark.createDataFrame([], "id string")
    no_arc = spark.createDataFrame([], "tail string, rel string, mod string, value double, head string")
    some = lambda parts, end, id: [x for x in (p.at(end, id) for p in parts) if x is not None]
    return Graph(
        union([p.all() for p in vs], no_vertex), union([p.all() for p in arcs], no_arc), PROPERTY_TYPES, now=NOW, vertex_at=lambda id: union(some(vs, "id", id), no_vertex),
        arcs_at=lambda id, end: union(some(arcs, end, id), no_arc), joined=frozenset(r for r, tables in ENDS.items() if only is None or tables <= set(only)),
    )
