"""Documents to packed training sequences: each stage calls one operator and passes on all that it keeps.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; docs is the table that the
stage before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverdf.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from quiverdf.llm.common import Workspace, crc_of, numbered, table
from quiverdf.llm.queries import tokenizer_path


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Numbered rows without those whose number is in dropped, and without the number."""
    return rows.join(dropped.select("__row").distinct(), "__row", "left_anti").drop("__row")


def settled(work: Workspace, decisions: DataFrame) -> DataFrame:
    """A stage's decisions, written in a folder of their own; what the operator has written to come to them goes."""
    kept = Workspace(work.spark).keep(decisions, "decisions")
    work.clear()
    return kept


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the network learns from the labelled documents of the input tables.

    Null and empty texts stay; repeated rows share their fate; ids play no part but in the choice of training rows.
    """
    network = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of("doc_id") % 5 != 0, "doc_id", "text", "toxic")
    return toxicity.keep_clean(docs, network)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps exactly one row, that with the largest id; null counts as the empty text.

    A null id is smaller than every other; of equal ids the later row stays. Other texts of a dropped row's id stay.
    """
    work, rows = Workspace(spark), numbered(docs)
    key = rows.select(F.struct("doc_id", "__row").alias("key"), "text")
    dropped = exact_dedup.exact_groups(key, "key", work=work).filter(~F.col("kept")).select("key.__row")
    return without(rows, settled(work, dropped))


def distinct_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keeps exactly one row, that with the smallest id.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; texts without a
    word, null ones too, are one group. Of equal ids the earlier row stays; a null id comes after all others.
    """
    work, rows = Workspace(spark), numbered(docs)
    groups = simhash_dedup.near_groups(rows.select("__row", "text"), "__row", words=5, similarity=0.8, work=work).select("__row", "component_id")
    keyed = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row")).alias("key")).join(work.keep(groups, "groups"), "__row")
    stays = keyed.groupBy("component_id").agg(F.min("key").getField("row").alias("stays"))
    return without(rows, settled(work, keyed.join(stays, "component_id").filter("__row <> stays").select("__row")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows so that sources have their target shares; copies keep their row's columns.

    Each row has copies of its own, so null and repeated ids are rows like others. Texts without a word count nothing
    towards a target and are taken like others of their source.
    """
    work, rows = Workspace(spark), numbered(docs)
    copies = mixing.mix(rows.select("__row", "text", "source"), "__row", work=work).filter(F.col("copies") > 0).select("__row", "copies")
    taken = rows.join(settled(work, copies), "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens; a row without text is one closing token, copies are rows of their own."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", clean), ("exact_dedup", distinct_texts), ("near_dedup", distinct_near), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the network, fingerprints or tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.keep(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
