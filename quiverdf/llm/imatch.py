"""I-Match fingerprints with randomised lexicon subsets, in DataFrame operations only.

The lexicon holds the terms whose inverse document frequency lies in a band. Of each text the distinct lexicon terms
are sorted and hashed once for each of `DRAWS` x `LEVELS` random subsets of the lexicon; level l of a draw keeps a
share of 2^-l of the terms and lies within the level before, so that each is filtered from the last one. Dense subsets
notice any change, sparse ones survive many, so the share of equal hashes says how alike two texts are at any length:
the likeness is the largest share of any level.

A text is compared with an edited copy, whose second half comes from the next document by descending id. Documents
meet their next one in blocks of 2^`BLOCK_BITS` consecutive ids, blocks with very many rows (null or repeated ids) in
parts by digest; the first document of each block is sent to the block before as well. The window, the look-up in the
lexicon, the hashes and the likeness then need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

#: Share of documents that hold a term, from and below; idf between ln 20 and ln 500.
BAND = (0.002, 0.05)
#: A hash of 64 bits serves eight draws; bits of each subset's hash that the fingerprint shows.
DRAWS, LEVELS, BYTES, SHOWN = 32, 8, 8, 16
#: Blocks of more than HOT_BLOCK rows are cut into parts of about BLOCK_ROWS.
BLOCK_BITS, BLOCK_ROWS, HOT_BLOCK = 8, 256, 4096
#: A lexicon up to this size is broadcast. Its size is at most the mean number of distinct terms of a document divided
#: by the lower end of the band, whatever the number of documents; a larger one is joined by an exchange.
BROADCAST_TERMS = 500_000
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), NOT_TERM))


def lexicon(docs: DataFrame, text_col: str, work: Workspace, band: tuple[float, float] = BAND) -> DataFrame:
    """term: hashes of the terms in the band, counted over all documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = docs.select(F.explode(terms(text)).alias("w")).filter("w <> ''").select(F.xxhash64("w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    return work.keep(counts.filter((F.col("df") >= band[0] * n) & (F.col("df") < band[1] * n)).select("term"), "lexicon")


def following(blocks: DataFrame, work: Workspace) -> DataFrame:
    """blocks: block, one row each. Adds after, the next block in ascending order; the first one after the last.

    Blocks are dealt out by ranges, so that no task sees them all; only the ranges' first blocks meet.
    """
    dealt = work.keep(blocks.repartitionByRange(partitions(blocks.sparkSession), "block").withColumn("part", F.spark_partition_id()), "dealt")
    heads = dealt.groupBy("part").agg(F.min("block").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("head"))
    near = F.lead("block").over(Window.partitionBy("part").orderBy("block"))
    return dealt.withColumn("near", near).join(F.broadcast(heads), "part").withColumn("after", F.coalesce("near", "head")).drop("part", "near", "head")


def with_next(docs: DataFrame, work: Workspace, id_col: str, text_col: str) -> DataFrame:
    """id, text, sha, block, halo, place and the text of the next document by descending id (after the last: of the first).

    Documents stand in the order of id, null last, and of their texts' digests, both descending.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("wide", F.struct(F.col("id").isNull().alias("none"), F.bitwise_not(F.coalesce(F.shiftright("id", BLOCK_BITS), F.lit(0).cast("long"))).alias("ids")))
    hot = work.keep(rows.groupBy("wide").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BLOCK), "hot")
    # In a hot block each id has parts of its own, by the digest's first digits.
    parts = F.ceil(F.col("n") / BLOCK_ROWS)
    spot = F.lit(65535) - F.conv(F.substring("sha", 1, 4), 16, 10).cast("long")
    own = F.when(F.col("n").isNotNull(), F.struct(F.bitwise_not(F.coalesce("id", F.lit(0).cast("long"))).alias("id"), F.floor(spot * parts / 65536).cast("long").alias("part")))
    plain = F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("part"))
    rows = rows.join(hot, "wide", "left").withColumn("block", F.struct("wide.none", "wide.ids", F.coalesce(own, plain).alias("own"))).select("id", "text", "sha", "block")
    first_of = F.min(F.struct(F.col("id").isNull().alias("none"), F.bitwise_not(F.coalesce("id", F.lit(0).cast("long"))).alias("id"), F.translate("sha", "0123456789abcdef", "fedcba9876543210").alias("sha")))
    blocks = work.keep(rows.groupBy("block").agg(first_of.alias("top")), "blocks")
    upper = following(blocks, work).select(F.col("block").alias("upper"), F.col("after").alias("block"))
    tops = blocks.select("block", F.when(~F.col("top.none"), F.bitwise_not("top.id")).alias("top_id"), F.translate("top.sha", "fedcba9876543210", "0123456789abcdef").alias("top_sha"))
    lower = work.keep(upper.join(tops, "block"), "lower")
    first = rows.join(lower, "block").filter(F.col("id").eqNullSafe(F.col("top_id")) & (F.col("sha") == F.col("top_sha")))
    first = first.groupBy("upper").agg(F.any_value("text").alias("text"))
    every = rows.withColumn("halo", F.lit(0)).unionByName(first.select(F.lit(None).cast("long").alias("id"), "text", F.lit("").alias("sha"), F.col("upper").alias("block"), F.lit(1).alias("halo")))
    order = Window.partitionBy("block").orderBy("halo", F.col("id").desc_nulls_last(), F.col("sha").desc())
    return every.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two fingerprints: the largest share of equal hashes, among those that either text has, of
    all levels that have two of them at least, or of the levels together; 1 if neither text has any."""
    # Six bits of a long count the draws of a level: one long for hashes that either has, one for equal ones.
    units = F.array(*[F.lit(1 << 6 * level).cast("long") for _ in range(DRAWS) for level in range(LEVELS)])
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    zero = F.lit(0).cast("long")
    met = F.zip_with(a, b, lambda x, y: F.when(x != y, 1).when(x != 0, 2).otherwise(0))
    rows = rows.withColumn("__met", met)
    rows = rows.withColumn("__some", total(F.zip_with("__met", units, lambda m, u: F.when(m > 0, u).otherwise(zero))))
    rows = rows.withColumn("__same", total(F.zip_with("__met", units, lambda m, u: F.when(m == 2, u).otherwise(zero))))
    count = lambda c, level: F.shiftright(F.col(c), 6 * level).bitwiseAND(F.lit(63).cast("long"))
    some, same = ([count(c, level) for level in range(LEVELS)] for c in ("__some", "__same"))
    share = lambda x, y, least: F.when(y >= least, x / F.when(y > 0, y)).otherwise(F.lit(0.0))
    best = F.greatest(share(sum(same[1:], same[0]), sum(some[1:], some[0]), 1), *[share(x, y, 2) for x, y in zip(same, some, strict=True)])
    return rows.withColumn(name, F.when(F.col("__some") == 0, F.lit(1.0)).otherwise(best)).drop("__met", "__some", "__same")


def shown(hash_: Column) -> Column:
    """The bits of a subset's hash that the fingerprint keeps; never 0, which stands for an empty subset."""
    return hash_.bitwiseAND(F.lit((1 << SHOWN) - 1)).bitwiseOR(F.lit(1))


def subset_hashes(own: Column, whole: Column) -> Column:
    """own: sorted distinct terms; whole: a hash of the text for texts with characters but no terms, else null."""
    none = F.lit(0).cast("long")

    def nested(subset: Column, draw: int, level: int) -> Column:
        """Hashes of levels `level` and up of one draw: a term stays as long as its next bit is 0, which shifting makes the sign."""
        inside = F.filter(subset, lambda t: F.shiftleft(t, 8 * draw + level - 1) >= 0)

        def down(x: Column) -> Column:
            here = F.array(F.when(F.size(x) > 0, shown(F.xxhash64(x))).otherwise(none))
            return here if level == LEVELS else F.concat(here, nested(x, draw, level + 1))

        return F.transform(F.array(inside), down)[0]

    def word(k: int) -> Column:
        """The terms' hashes for draws 8k to 8k + 7, in the terms' order."""
        return own if k == 0 else F.transform(own, lambda t: F.xxhash64(t, F.lit(k)))

    draws = [F.transform(F.array(word(k)), lambda x: F.concat(*[nested(x, d, 1) for d in range(BYTES)]))[0] for k in range(DRAWS // BYTES)]
    instead = F.array(*[shown(F.xxhash64(whole, F.lit(k))) for k in range(DRAWS * LEVELS)])
    return F.when(F.size(own) > 0, F.concat(*draws)).when(whole.isNotNull(), instead).otherwise(F.array_repeat(none, DRAWS * LEVELS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null counts as the empty text, whose hashes are all 0; two such texts have likeness 1. Rows with a null id come
    last, rows with equal ids stand in the order of their texts' digests. A table of one row is its own next one. An
    empty table gives an empty result; other columns are ignored.
    """
    work = Workspace(docs.sparkSession)
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    words = lexicon(docs, text_col, work).withColumn("listed", F.lit(True))
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half))
    rows = with_next(docs, work, id_col, text_col)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), edited.alias("body")))
    # The copy of the next block's first document is there for its fingerprint only.
    sides = F.when(F.col("halo") == 1, F.slice(sides, 1, 1)).otherwise(sides)
    both = rows.select("block", "place", "halo", "id", F.explode(sides).alias("s")).select("block", "place", "halo", "id", "s.side", "s.body")
    both = both.select("block", "place", "halo", "id", "side", F.char_length("body").alias("n"), F.sha2("body", 256).alias("sha"), terms(F.col("body")).alias("words"))
    each = both.select("block", "place", "halo", "id", "side", "n", "sha", F.explode_outer("words").alias("w"))
    each = each.withColumn("term", F.when(F.col("w") != "", F.xxhash64("w")))
    found = each.join(words, "term", "left").groupBy("block", "place", "side").agg(
        F.collect_set(F.when(F.col("listed"), F.col("term"))).alias("listed"), F.first("halo").alias("halo"), F.first("id").alias("id"), F.first("n").alias("n"), F.first("sha").alias("sha")
    )
    found = found.withColumn("own", F.sort_array("listed"))
    found = found.withColumn("print", subset_hashes(F.col("own"), F.when(F.col("n") > 0, F.col("sha"))))
    text = lambda p: F.array_join(F.transform(p, lambda x: F.lower(F.lpad(F.hex(x), SHOWN // 4, "0"))), "")
    pick = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    whole = found.groupBy("block", "place").agg(
        F.first("halo").alias("halo"), F.first("id").alias("id"), pick(0, "n").alias("n"), pick(1, "sha").alias("edited_sha256"), pick(0, "print").alias("a"), pick(1, "print").alias("b")
    )
    whole = whole.withColumn("c", F.lead("a").over(Window.partitionBy("block").orderBy("place"))).filter("halo = 0")
    whole = with_likeness(with_likeness(whole, "a", "b", "near_edited"), "a", "c", "near_next")
    return whole.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", text(F.col("a")).alias("fingerprint"), text(F.col("b")).alias("edited_fingerprint"), "near_edited", "near_next")
