"""Streams of graph changes: text transactions of operations, applied in their order and once each.

A line holds a transaction number, a serial within it, an operation and its arguments, divided by tabs:
    vxn id type          create a vertex             vxd id               delete it and its outgoing arcs
    vxt id type          set its type                vxx id tmx           set its expiry
    vxr id c1 c0         set its rank                vxc id 0 or 1        make it real or virtual
    vps id key value     set a property              vpd id key           delete one
    vpc id               delete all properties       vvs id x,y,...       set its vector
    vvd id               delete its vector           vod id, vid id       delete its outgoing, incoming arcs
    arc tail rel mod value head    connect           ard tail rel mod head        disconnect
    grt                  empty the graph             evx time             let end what has its time before that
Operations take effect in the order of (transaction, serial): a deletion ends what came before it, not what comes
after. Locks, heartbeats and enumerations have nothing to do here and are passed over.

Lines and batches that come again leave the state as it is, since each (transaction, serial) counts once in all batches
of a follower. It writes those it has applied beside each state, and goes on from the last whole state when it starts
anew on its folder. Every batch writes the whole graph, so batches should be large.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import mutate
from ..plans.graph import ARC_COLUMNS, VERTEX_COLUMNS, Graph, conform

SCHEMA = "trans long, serial long, op string, args array<string>"
ARC_KEY = ["tail", "rel", "mod", "head"]
NEVER_YET = (-(1 << 63), -(1 << 63))


def parsed(lines: DataFrame) -> DataFrame:
    """value: lines. Gives trans, serial, op and args; lines that are no operation vanish."""
    parts = F.split("value", "\t")
    out = lines.filter(F.size(parts) >= 3).select(F.get(parts, 0).try_cast("long").alias("trans"), F.get(parts, 1).try_cast("long").alias("serial"), F.get(parts, 2).alias("op"), F.slice(parts, 4, 1 << 20).alias("args"))
    return out.filter(F.col("trans").isNotNull() & F.col("serial").isNotNull())


def line(trans: int, serial: int, op: str, *args) -> str:
    return "\t".join(map(str, (trans, serial, op, *args)))


def arcs_as_operations(graph: Graph, trans: int = 0) -> DataFrame:
    """value: a line for each arc, the sink's side of the stream."""
    serial = F.monotonically_increasing_id()
    return graph.arcs.select(F.concat_ws("\t", F.lit(trans), serial, F.lit("arc"), "tail", "rel", "mod", F.col("value").cast("string"), "head").alias("value"))


def arg(k: int) -> Column:
    return F.get("args", k)


def at() -> Column:
    return F.struct("trans", "serial")


def never() -> Column:
    return F.struct(F.lit(NEVER_YET[0]).cast("long").alias("trans"), F.lit(NEVER_YET[1]).cast("long").alias("serial"))


def last(df: DataFrame, *keys: str) -> DataFrame:
    """Of the rows with one key that of the last operation."""
    order = Window.partitionBy(*keys).orderBy(F.col("trans").desc(), F.col("serial").desc())
    return df.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def after(df: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """Rows whose operation comes after the cut (id, cut) of their key, or has none."""
    cuts = cuts.select(F.col("id").alias("__id"), "cut")
    joined = df.join(cuts, F.col(key) == F.col("__id"), "left").filter(at() > F.coalesce("cut", never()))
    return joined.drop("__id", "cut")


def with_properties(graph: Graph, values: DataFrame) -> Graph:
    """values: id, key, value (text; null deletes), one row per id and key. Numbers go to num unless the key is declared as text, or is new and has other values too."""
    values = values.filter(F.col("id").isNotNull() & F.col("key").isNotNull())
    number = F.col("value").try_cast("double")
    kinds = {r["key"]: "real" if r["real"] else "str" for r in values.filter("value IS NOT NULL").groupBy("key").agg(F.bool_and(number.isNotNull()).alias("real")).collect()}
    types = {**kinds, **graph.property_types}
    texts = [k for k in kinds if types[k] == "str"]
    real = number.isNotNull() & ~F.col("key").isin(texts)
    pairs = lambda test, v: F.map_from_entries(F.collect_list(F.when(test, F.struct("key", v.alias("v")))))
    new = values.groupBy("id").agg(F.collect_set("key").alias("__keys"), pairs(real, number).alias("__num"), pairs(~real & F.col("value").isNotNull(), F.col("value")).alias("__text"))
    vertices = graph.vertices.join(new, "id", "left")
    for column, kind in (("num", "double"), ("text", "string")):
        old = F.coalesce(F.map_filter(F.col(column), lambda k, v: ~F.array_contains("__keys", k)), F.create_map().cast(f"map<string,{kind}>"))
        vertices = vertices.withColumn(column, F.when(F.col("__keys").isNotNull(), F.map_concat(old, F.col(f"__{column}"))).otherwise(F.col(column)))
    return graph.with_(vertices=vertices.drop("__keys", "__num", "__text"), property_types=types)


def applied(graph: Graph, ops: DataFrame) -> Graph:
    """The graph after all operations of a batch, in their order; counters and accumulators add up."""
    ops = ops.dropDuplicates(["trans", "serial"])
    emptied = ops.filter("op = 'grt'").agg(F.max(at()).alias("cut")).first()["cut"]
    if emptied is not None:
        graph = mutate.truncate(graph)
        ops = ops.filter(at() > F.struct(F.lit(emptied["trans"]).alias("trans"), F.lit(emptied["serial"]).alias("serial")))
    of = lambda *names: ops.filter(F.col("op").isin(*names))
    cut_of = lambda *names: of(*names).groupBy(arg(0).alias("id")).agg(F.max(at()).alias("cut"))

    # Vertices: what comes before a vertex's last deletion has no effect on it.
    deleted = cut_of("vxd")
    graph = mutate.delete_vertices(graph, deleted)
    own = after(of("vxn", "vxt", "vxx", "vxr", "vxc", "vps", "vpd", "vpc", "vvs", "vvd").withColumn("id", arg(0)), deleted, "id")
    which = lambda *names: own.filter(F.col("op").isin(*names))
    made = last(which("vxn").select("trans", "serial", "id", arg(1).alias("type")), "id")
    graph = mutate.create_vertices(graph, made.select("id", "type"))

    cleared = which("vpc").groupBy("id").agg(F.max(at()).alias("cut"))
    graph = mutate.remove_property(graph, cleared)
    values = last(which("vps", "vpd").select("trans", "serial", "id", arg(1).alias("key"), F.when(F.col("op") == "vps", arg(2)).alias("value")), "id", "key")
    graph = with_properties(graph, after(values, cleared, "id"))
    # Single values, each by its last operation, in one join.
    single = {"type": ("vxt", arg(1)), "tmx": ("vxx", arg(1).try_cast("long")), "virtual": ("vxc", arg(1) == "1"), "c1": ("vxr", arg(1).try_cast("double")), "c0": ("vxr", arg(2).try_cast("double"))}
    new = which(*{name for name, _ in single.values()}).groupBy("id").agg(*[F.max_by(F.when(F.col("op") == name, v), F.when(F.col("op") == name, at())).alias(f"__{c}") for c, (name, v) in single.items()])
    set_ = graph.vertices.join(new, "id", "left")
    graph = graph.with_(vertices=set_.withColumns({c: F.coalesce(f"__{c}", c) for c in single}).drop(*[f"__{c}" for c in single]))
    vectors = last(which("vvs", "vvd").select("trans", "serial", "id", "op", F.transform(F.split(arg(1), ","), lambda x: x.try_cast("double")).alias("value")), "id")
    graph = mutate.remove_vector(graph, vectors.filter("op = 'vvd'"))
    graph = mutate.set_column(graph, "vector", vectors.filter("op = 'vvs'"))

    # Arcs: an arc's cut is the last of its own disconnection and of its ends'.
    gone = last(of("ard").select("trans", "serial", arg(0).alias("tail"), arg(1).alias("rel"), arg(2).alias("mod"), arg(3).alias("head")), *ARC_KEY).select(*ARC_KEY, at().alias("__own"))
    ends = {"tail": cut_of("vod", "vxd"), "head": cut_of("vid")}

    def cut(arcs: DataFrame) -> DataFrame:
        arcs = arcs.join(gone, ARC_KEY, "left")
        for end, cuts in ends.items():
            arcs = arcs.join(cuts.select(F.col("id").alias(end), F.col("cut").alias(f"__{end}")), end, "left")
        least = F.greatest(*[F.coalesce(c, never()) for c in ("__own", "__tail", "__head")])
        return arcs.withColumn("__cut", least).drop("__own", "__tail", "__head")

    links = of("arc").select("trans", "serial", arg(0).alias("tail"), arg(1).alias("rel"), arg(2).alias("mod"), arg(3).try_cast("double").alias("value"), arg(4).alias("head"))
    links = cut(links).filter(at() > F.col("__cut")).drop("__cut")
    graph = graph.with_(arcs=cut(graph.arcs).filter(F.col("__cut") == never()).select(*ARC_COLUMNS))
    adding = F.col("mod").isin("M_CNT", "M_ACC")
    total = links.filter(adding).groupBy(*ARC_KEY).agg(F.sum("value").alias("value"))
    newest = last(links.filter(~adding), *ARC_KEY)
    graph = mutate.connect(graph, conform(total, ARC_COLUMNS).unionByName(conform(newest, ARC_COLUMNS)))
    due = of("evx").agg(F.max(arg(0).try_cast("long")).alias("t")).first()["t"]
    return graph if due is None else graph.live(due)


class Follower:
    """Keeps a graph up to date with a stream of operation lines; each batch reads the state before it and writes its own.

    A state is a folder of vertices, arcs, the applied (transaction, serial) and, written last, a line with the types
    of properties. A follower that starts on a folder with states goes on from the last one that is whole.
    """

    def __init__(self, spark: SparkSession, folder: str, start: Graph):
        self.spark, self.folder = spark, folder
        self.kept = start
        self.batch = -1
        self.states = 0
        while self._exists(f"{folder}/state-{self.states}/whole/_SUCCESS"):
            self.states += 1
        if self.states:
            self._read(self.states - 1)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _read(self, state: int) -> None:
        path = f"{self.folder}/state-{state}"
        types = json.loads(self.spark.read.text(f"{path}/whole").first()[0])
        rows = [self.spark.read.schema(", ".join(f"{c} {t}" for c, t in columns.items())).parquet(f"{path}/{name}") for name, columns in (("vertices", VERTEX_COLUMNS), ("arcs", ARC_COLUMNS))]
        self.kept = self.kept.with_(vertices=rows[0], arcs=rows[1], property_types=types)

    def _apply(self, lines: DataFrame, batch: int) -> None:
        path = f"{self.folder}/state-{self.states}"
        ops = parsed(lines)
        if self.states:
            seen = self.spark.read.schema("trans long, serial long").parquet(*[f"{self.folder}/state-{k}/seen" for k in range(self.states)])
            ops = ops.join(seen, ["trans", "serial"], "left_anti")
        ops.write.mode("overwrite").parquet(f"{path}/operations")
        ops = self.spark.read.schema(SCHEMA).parquet(f"{path}/operations")
        if not ops.isEmpty():
            graph = applied(self.kept, ops)
            ops.select("trans", "serial").distinct().write.mode("overwrite").parquet(f"{path}/seen")
            graph.vertices.select(*VERTEX_COLUMNS).write.mode("overwrite").parquet(f"{path}/vertices")
            graph.arcs.write.mode("overwrite").parquet(f"{path}/arcs")
            self.spark.createDataFrame([(json.dumps(graph.property_types),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/whole")
            self._read(self.states)
            self.states += 1
        self.batch = batch

    def follow(self, lines: DataFrame, checkpoint: str):
        """Starts the query over a streaming DataFrame of lines; stops by itself when all that is there has been read."""
        return lines.writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per key and time window; rows later than `late` behind the newest are left out in streams."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), key, "n", "value")
