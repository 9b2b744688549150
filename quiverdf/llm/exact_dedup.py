"""Exact duplicates by distributed most-significant-first radix partitioning.

Every document starts in one group. A round splits each group by the next bytes of its documents. A group that is
left with one document, or whose documents have ended, is done; the others go on behind those bytes. Documents that
stay together to their end are equal, so equality rests on the bytes themselves and needs no digest.

A round handles a run of bytes at once, 64 in the first round and 16 times as many in each next one, so that even
megabyte texts end within five rounds. Groups are counted with map-side aggregation and the counts are joined back by
a plain equi-join, which adaptive execution splits where a key is hot. Only documents that still share their whole
prefix with another one move on with what is left of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

FIRST_BYTES = 64
GROWTH = 16
REPEATS = 1 << 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, work: Workspace | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id of the rows with an equal text and group_size their number. Null counts as the empty
    text. A null id never beats another one. Of rows with that id and text one is `kept`, so of every text exactly one
    row stays. Ids can be of any type that has an order. An empty table gives an empty result; other columns are ignored.
    """
    work = work or Workspace(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    active = docs.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("sha"), F.lit(0).cast("long").alias("gid"), body.alias("rest"))
    width, level, done = first_bytes, 0, []
    while True:
        step = active.withColumn("chunk", F.substring("rest", 1, width))
        # A group's number is written with it, so that it stays.
        groups = step.groupBy("gid", "chunk").agg(F.count("*").alias("n"), F.max("id").alias("top")).withColumn("name", F.monotonically_increasing_id())
        groups = work.keep(groups, f"groups{level}")
        ended = (F.col("n") == 1) | (F.octet_length("chunk") < width)
        done.append(
            step.select("id", "sha", "gid", "chunk")
            .join(groups.filter(ended).select("gid", "chunk", "n", "top"), ["gid", "chunk"])
            .select("id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), "sha")
        )
        going = groups.filter(~ended).select("gid", "chunk", "name")
        if going.isEmpty():
            break
        rest = F.expr(f"substring(rest, {width + 1}, octet_length(rest))")
        active = work.keep(step.join(going, ["gid", "chunk"]).select("id", "sha", F.col("name").alias("gid"), rest.alias("rest")), f"active{level}")
        width, level = width * GROWTH, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    # Rows that are equal in all of these differ in `kept` alone: the first of them may have it. They are counted and
    # dealt out again in two steps, so that no array grows with their number.
    same = out.groupBy("id", "keep_id", "group_size", "sha").agg(F.count("*").alias("times"))
    block = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    most = F.least(F.col("times") - F.col("block") * REPEATS, F.lit(REPEATS).cast("long"))
    each = block.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    first = (F.col("block") == 0) & (F.col("place") == 1)
    return each.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), F.col("sha").alias("text_sha256"))
