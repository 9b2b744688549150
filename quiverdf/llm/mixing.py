"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

The target of a source divided by its size is the expected number of copies of each of its documents. The documents of
a source stand in a fixed order; the running sum of expected copies, shifted by the source's one random offset, crosses
integers, and a document is taken once for each integer that falls into its own interval.

Long documents, each worth more than 1/`FINE` of the target, are sampled first: whether a few of them are taken moves
the words by more than any order can even out. The other documents' expected copies are what is then left of the
target over their size, so that the words taken come near it whichever long ones were drawn.

The order within a source goes by blocks (a hash of the document) and by size within a block, ascending and descending
in turn, so that neighbours have similar sizes. Blocks keep a hot source from meeting in one task: ranks are counted
within a block, and only block totals are summed along a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, running

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_ROWS = 1000
FINE = 50
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    """Number of runs of bytes that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, work: Workspace, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes: one row per source (source, n, source_size). Adds target.

    The sources share the sum of all sizes by weight; weights repeat along the sources in code-point order, null last.
    A target ends at `most` times its source's size; what is above is shared again by weight among the others. Along
    ascending size over weight the sources that end at their bound come first, so running sums find the water level.
    Neither order meets in one task, so that there may be as many sources as hosts.
    """
    named = [F.col("source").isNull(), F.col("source")]
    ranked = running(sizes, named, [], work, "by_name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(most)).drop("before_n")
    level = running(ranked, [F.col("bound") / F.col("weight"), *named], ["bound", "weight"], work, "by_level")
    every = level.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    if every["weight"] is None:
        return sizes.withColumn("target", F.lit(0.0))
    # In this order, the first source whose fair share of what is left is below its bound sets the level for all after it.
    share = level.withColumn("level", (every["size"] - F.col("before_bound")) / (every["weight"] - F.col("before_weight")))
    order = F.struct((F.col("bound") / F.col("weight")).alias("o"), *[c.alias(k) for c, k in zip(named, "zs", strict=True)], F.col("level").alias("level"))
    first = share.agg(F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), order)).alias("m")).first()["m"]
    water = F.col("bound") if first is None else F.lit(first["level"]) * F.col("weight")
    return share.select("source", "n", "source_size", F.least(F.col("bound"), water).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_rows: int = BLOCK_ROWS, work: Workspace | None = None) -> DataFrame:
    """One row per input row: id, source (as __source), size, source_size, target, copies, taken.

    Null and empty texts have size 0; a source whose sizes are all 0 has target 0 and takes nothing. A null source is
    a source. Rows that are equal in id, source and text take the copies of their ranks in some order, so that null and
    repeated ids need no care. An empty table gives an empty result; columns of the input with other names play no part.
    """
    work = work or Workspace(docs.sparkSession)
    spot = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    rows = work.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), spot.alias("spot")), "sizes")
    totals = work.keep(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "totals")
    targets = work.keep(source_targets(totals, work), "targets")
    side = lambda df, *more: df.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), *more)
    placed = side(rows, "id", "source", "size", "spot").join(side(targets, "n", "source_size", "target"), ["key", "none"])
    placed = placed.withColumn("long", F.col("size") * FINE > F.col("target"))
    placed = placed.withColumn("block", F.pmod("spot", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block_rows))))
    group = ["key", "none", "long"]
    counts = placed.groupBy(*group, "block").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.keep(counts.withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0).cast("long"))), "starts")
    turn = F.when(F.col("block") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy(*group, "block").orderBy(turn, "spot", "id"))
    placed = placed.join(starts, [*group, "block"])
    ranked = work.keep(placed.select(*group, "id", "source", "size", "source_size", "target", rank.alias("rank")), "ranked")

    # The offset is a multiple of 2^-20 in [0, 1), drawn by a hash for each source.
    offset = F.pmod(F.xxhash64("key", "none", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def crossed(rate: Column) -> Column:
        return F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)

    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    long_copies = crossed(over(F.col("target"), F.col("source_size")))
    words = lambda long, x: F.sum(F.when(F.col("long") == long, x).otherwise(F.lit(0).cast("long")))
    drawn = ranked.groupBy("key", "none").agg(words(True, long_copies * F.col("size")).alias("drawn"), words(False, F.col("size")).alias("others"))
    ranked = ranked.join(work.keep(drawn, "drawn"), ["key", "none"])
    rest = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_COPIES)), over(F.col("target") - F.col("drawn"), F.col("others"))))
    copies = F.when(F.col("long"), long_copies).otherwise(crossed(rest))
    return ranked.select(F.col("id").alias(id_col), F.col("source").alias("__source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
