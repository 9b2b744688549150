"""What the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Ship the functions of a module to the Python workers by value, so that workers need not import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to 1000 rows and, where Spark knows the setting, 8 MB.

    They stay lowered, because results are lazy and read them when they run; a limit that is lower already stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is not None and not (re.fullmatch("[0-9]+", now) and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives memory that a task has freed back to the system, since Python workers live on for other tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own house


def extended(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """Columns of an Arrow batch as they are, so that no id passes through Python numbers, and new ones behind them."""
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns.values()], names=[*keep, *columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """A folder of this run in the shared folder of the cluster (spark.checkpoint.dir) for tables that cut lineage.

    Where the setting is absent a temporary folder stands in if Spark runs in one local process, as in tests; on a
    cluster, whose machines would not share it, that is an error. The folder goes when the JVM ends; tables that a
    later one replaces can be dropped before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="quiverdf-")
        self.root = f"{base.rstrip('/')}/quiverdf-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self.paths: dict[str, str] = {}
        self.made: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table of its own and read it back."""
        self.paths[name] = path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        self.made.append(path)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name)), True)

    def clear(self) -> None:
        """Drops all tables, once what was made of them has been written elsewhere."""
        for path in self.made:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self.paths, self.made = {}, []


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own (__row); ids may be null or come again.

    A scan of files deals the same rows to the same partitions however often it runs, whichever columns it reads, so
    its numbers stay. The rows of any other plan are written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = Workspace(docs.sparkSession).keep(docs, "rows")
    return docs.withColumn("__row", F.monotonically_increasing_id())


def crc_of(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def running(df: DataFrame, order: list[Column], sums: list[str], work: Workspace, name: str) -> DataFrame:
    """Adds before_n, the number of rows before each one in an order, and before_x, the sum of x over them, for x in sums.

    Rows are dealt out by ranges of the order, so that no task sees them all; only the ranges' totals meet.
    """
    n = partitions(df.sparkSession)
    dealt = work.keep(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), name)
    cols = {"n": F.lit(1).cast("long"), **{c: F.col(c) for c in sums}}
    totals = dealt.groupBy("__part").agg(*[F.sum(v).alias(f"__t_{c}") for c, v in cols.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("__part", *[F.sum(f"__t_{c}").over(earlier).alias(f"__b_{c}") for c in cols])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x, c: F.coalesce(x, F.lit(0).cast("long") if c == "n" else F.lit(0.0).cast(dict(df.dtypes)[c]))
    out = dealt.join(F.broadcast(totals), "__part")
    added = {f"before_{c}": zero(F.sum(v).over(inside), c) + zero(F.col(f"__b_{c}"), c) for c, v in cols.items()}
    return out.withColumns(added).drop("__part", *[f"__b_{c}" for c in cols])


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, label: for each node of an edge the smallest node of its component."""
    both = work.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = work.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "label0")
    level = 0
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = label.join(near.select(F.col("a").alias("node"), "near"), "node", "left").select("node", F.least("label", "near").alias("up"), F.col("label").alias("was"))
        hooked = work.keep(hooked, f"hooked{level}")
        jumped = hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.least("up", "top").alias("label"), "was")
        jumped = work.keep(jumped, f"label{level + 1}")
        changed = not jumped.filter(F.col("label") != F.col("was")).isEmpty()
        work.drop(f"hooked{level}", f"label{level}")
        label, level = jumped.select("node", "label"), level + 1
        if not changed:
            return label
