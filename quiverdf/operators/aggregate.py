"""Aggregation of arcs by head, relationship and kind of value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.conditions import ArcFilter

# Limits of the result's integers.
INT_LEAST, INT_MOST = -(1 << 31), (1 << 31) - 1
REAL_MODS = ("M_SIM", "M_DIST", "M_FLT", "M_ACC")


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(float(INT_LEAST)), F.least(F.lit(float(INT_MOST)), x))


def aggregate_arcs(rows: DataFrame, mode: str, having=None) -> DataFrame:
    """mode: first, max, min, average, count, sum, sqsum or product. Integers stay within 32 bits, averages are real.

    first takes the smallest by anchor, modifier and value, as traversal has no order here.
    """
    value = F.col("arc.value")
    fns = {
        "first": F.min_by(value, F.struct("anchor", "arc.mod", "arc.value")), "max": F.max(value), "min": F.min(value), "average": F.avg(value), "count": F.count("*").cast("double"),
        "sum": F.sum(value), "sqsum": F.sum(value * value), "product": F.product(value),
    }
    keyed = rows.withColumn("real", F.lit(False) if mode == "count" else F.col("arc.mod").isin(*REAL_MODS))
    out = keyed.groupBy(F.col("next.id").alias("id"), F.col("arc.rel").alias("rel"), "real").agg(fns[mode].alias("val"))
    real = F.lit(True) if mode == "average" else F.col("real")
    out = out.select("id", "rel", F.when(real, "M_FLTAGGR").otherwise("M_INTAGGR").alias("mod"), F.when(real, F.col("val")).otherwise(clamped(F.col("val"))).alias("val"))
    if having is not None:
        spec = ArcFilter.of(having)
        out = out.withColumn("a", F.struct("rel", "mod", F.col("val").alias("value"))).filter(spec.column("a")).drop("a")
    return out
