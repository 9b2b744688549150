"""Links of texts by the Jaccard similarity of their word shingles, for `simhash_dedup` where a similarity is asked for.

Candidates are pairs that fingerprints propose and pairs that share a MinHash band. A pair at similarity s shares a band
of `ROWS` hashes with probability s**ROWS; of `BANDS` bands a pair at 0.8 misses all with probability 1e-4, and a pair
at 0.4 meets in one with probability 0.03. Each candidate pair is checked on its whole shingle sets, in four rounds, of
which each sees only what the rounds before left in different components: every text with the smallest one that it
shares a bucket with; the members of every bucket with its smallest, and the pairs that fingerprints propose; the members
of a bucket with its pivot, the one with the least share of shingles that no other text has; and the members of a bucket
outside its largest component with all others. So a large group of near copies costs stars and not its pairs.

Before the last round, members that can't have a partner leave their bucket, by bounds that lose no pair. Shingles that
only one of the texts has (lone ones) are in no intersection. And two sets differ exactly where their differences from
a third differ: with p the pivot without its lone shingles and v(x) = |x ^ p|, of which lone(x) are lone, |x ^ y| >= v(x) +
v(y) - 2 min(v(x) - lone(x), v(y) - lone(y)), while a pair at similarity s has |x ^ y| <= (|x| + |y|) (1 - s) / (1 + s).
Most copies with edits of their own fail that with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, by_value, components, extended, trim

by_value(__name__)

WORDS = 5
SEED = 42
ROWS = 8
BANDS = 50
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK = 4096
#: Shingles whose hashes are taken at once, so that tables of them stay in the cache.
HASHED = 256


def digests(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.fromiter(map(len, tokens), np.int64, len(tokens)).cumsum() + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - words + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct ones."""
    return np.unique(digests(text, words))


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of shingle hashes: bits that over half of them have."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        count += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * count > len(hashes)))


def signature(grams: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The least value of each of ROWS * BANDS hash functions over a set that is not empty."""
    r = np.random.default_rng(seed)
    factor = r.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = r.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), HASHED):
        least = np.minimum(least, (grams[None, at : at + HASHED] * factor[:, None] + shift[:, None]).min(1))
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """id, fp (the fingerprint), whole (a 128-bit hash of the shingle set), keys (one for each band of least hashes)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, whole, keys = [], [], []
            for body in batch.column("body").to_pylist():
                each = digests(body, words)
                grams = np.unique(each)
                fps.append(majority(each))
                whole.append(xxhash.xxh3_128_hexdigest(grams.tobytes()))
                sig = signature(grams) if len(grams) else grams
                bands = [xxhash.xxh64_intdigest(sig[k : k + ROWS].tobytes(), k) for k in range(0, len(sig), ROWS)]
                keys.append(np.array(bands, np.uint64).view(np.int64))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield extended(batch, ["id"], fp=fp, whole=pa.array(whole, pa.string()), keys=pa.array(keys, pa.list_(pa.int64())))
        trim()

    return bodies(docs, id_col, text_col).mapInArrow(run, "id long, fp long, whole string, keys array<long>")


def sets(bodies: DataFrame, words: int = WORDS) -> DataFrame:
    """id, whole, grams: the shingle sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            grams = [shingles(x, words) for x in batch.column("body").to_pylist()]
            whole = [xxhash.xxh3_128_hexdigest(g.tobytes()) for g in grams]
            yield extended(batch, ["id"], whole=pa.array(whole, pa.string()), grams=pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64())))

    return bodies.mapInArrow(run, "id long, whole string, grams array<long>")


def bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("body"))


def compared(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs (a, b) with shared, the number of shingles in both sets, and similarity."""
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", shared.alias("shared"), (shared / (F.size("ga") + F.size("gb") - shared)).alias("similarity"))


def verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have at least the similarity."""
    return compared(pairs, grams).filter(F.col("similarity") >= similarity).select("a", "b")


def weighed(nodes: DataFrame, grams: DataFrame) -> DataFrame:
    """node, n (its shingles), lone (those that no other of the nodes has)."""
    own = grams.join(nodes, "node", "left_semi")
    holders = own.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    lone = holders.filter("n = 1").groupBy("node").agg(F.count("*").alias("lone"))
    return own.select("node", F.size("grams").alias("n")).join(lone, "node", "left").select("node", "n", F.coalesce("lone", F.lit(0)).alias("lone"))


def possible(placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components, but for those that bounds rule out.

    placed: key, node, label, main (the bucket's largest component), n, lone, v (shingles in which it differs from the
    bucket's pivot without lone ones); pivots are not among them.
    """
    # Pairs at the similarity differ in at most this share of both sizes; the slack is for rounding.
    most, slack = (1 - similarity) / (1 + similarity), 1e-6
    # far(x) + close(y) <= 0 and close(x) + far(y) <= 0 for any pair at the similarity.
    placed = placed.withColumns({"far": F.col("v") - most * F.col("n"), "close": 2 * F.col("lone") - F.col("v") - most * F.col("n")})
    outside = F.col("label") != F.col("main")
    least = placed.groupBy("key").agg(*[F.min(F.when(outside, F.col(c))).alias(f"out_{c}") for c in ("far", "close")], *[F.min(c).alias(f"any_{c}") for c in ("far", "close")])
    meets = lambda of: (F.col("close") + F.col(f"{of}_far") <= slack) & (F.col("far") + F.col(f"{of}_close") <= slack)
    placed = placed.join(least, "key").filter(F.when(outside, meets("any")).otherwise(meets("out")))
    side = lambda s, rows: rows.select("key", "main", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "lone", "far", "close")])
    once = (F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    sizes = F.col("n_a") + F.col("n_b")
    fits = (F.col("close_a") + F.col("far_b") <= slack) & (F.col("far_a") + F.col("close_b") <= slack)
    fits = fits & (similarity * sizes <= (1 + similarity) * F.least(F.col("n_a") - F.col("lone_a"), F.col("n_b") - F.col("lone_b")) + slack)
    both = side("a", placed.filter(outside)).join(side("b", placed).drop("main"), "key").filter((F.col("label_a") != F.col("label_b")) & once & fits)
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, words: int, propose: Callable[[DataFrame], DataFrame], work: Workspace) -> DataFrame:
    """One row per input row: id, fp, component_id (smallest id that links reach).

    Two rows are linked if the Jaccard similarity of their shingle sets is at least `similarity`, which should not be
    below 0.8. propose takes node, fp (distinct fingerprints) and gives pairs a, b of nodes besides those of the bands.
    Null and empty texts have equal sets. Rows with a null id take part with the smallest other id of their shingle set,
    or null where there is none. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    rows = work.keep(sketches(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # An id with several texts stands for several sets, so nodes are rows, one for each set, and not ids.
    first = rows.filter("id IS NOT NULL").groupBy("whole").agg(F.min(F.struct("id", "row", "fp")).alias("x"))
    nodes = work.keep(first.select("whole", "x.id", F.col("x.row").alias("node"), "x.fp"), "nodes")
    bands = rows.select(F.col("row").alias("node"), "keys").join(nodes.select("node"), "node", "left_semi").select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1").select("key", "low")
    members = work.keep(bands.join(shared, "key"), "members")
    heads = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    alike = nodes.select("fp", F.col("node").alias("b")).join(heads.select("fp", F.col("node").alias("a")), "fp").filter("a <> b").select("a", "b")
    proposed = work.keep(propose(heads).select("a", "b").union(alike), "proposed")
    wanted = members.select("node").union(proposed.select("a")).union(proposed.select("b")).distinct()
    open_nodes = nodes.join(wanted, "node", "left_semi").select("node", "id", "whole")
    texts = bodies(docs, id_col, text_col).join(open_nodes.select("id").distinct(), "id", "left_semi")
    grams = work.keep(sets(texts, words).join(open_nodes, ["id", "whole"]).dropDuplicates(["node"]).select("node", "grams"), "grams")

    def labelled_by(label: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
        """rows with label_<name> for each column of nodes: the component, or the node itself."""
        for name in names:
            rows = rows.join(label.select(F.col("node").alias(name), F.col("label").alias("__l")), name, "left").withColumn(f"label_{name}", F.coalesce("__l", name)).drop("__l")
        return rows

    nearest = members.filter("node <> low").groupBy("node").agg(F.min("low").alias("a")).select("a", F.col("node").alias("b"))
    found = work.keep(verified(nearest, grams, similarity), "nearest")
    label = components(found, work)
    stars = members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).union(proposed)
    stars = labelled_by(label, stars, "a", "b").filter("label_a <> label_b").select("a", "b").distinct()
    more = work.keep(verified(work.keep(stars, "open_stars"), grams, similarity), "stars")
    found = work.keep(found.union(more), "links2")
    label = components(found, work)

    def apart(rows: DataFrame) -> DataFrame:
        """key, node, label, main (the largest component of the bucket) for buckets in which components are left apart."""
        placed = work.keep(labelled_by(label, rows.select("key", "node"), "node").withColumnRenamed("label_node", "label"), "placed")
        sizes = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).getField("label").alias("main")).filter("labels > 1")
        return placed.join(main.select("key", "main"), "key")

    placed = work.keep(apart(members), "apart")
    work.drop("placed")
    weights = work.keep(weighed(placed.select("node").distinct(), grams), "weights")
    # A partner has this share of a set's shingles at least.
    able = work.keep(placed.select("key", "node").join(weights, "node").filter(F.col("n") - F.col("lone") >= similarity * F.col("n") - 1e-6), "able")
    pivots = work.keep(able.groupBy("key").agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("share"), "node", (F.col("n") - F.col("lone")).alias("n"))).alias("x")).select("key", F.col("x.node").alias("pivot"), F.col("x.n").alias("n_pivot")), "pivots")
    beside = able.join(pivots, "key").filter("node <> pivot")
    star = beside.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = work.keep(compared(work.keep(star, "star"), grams), "compared")
    found = work.keep(found.union(star.filter(F.col("similarity") >= similarity).select("a", "b")), "links3")
    label = components(found, work)

    placed = apart(able).join(beside.select("key", "node", "n", "lone", "pivot", "n_pivot"), ["key", "node"])
    placed = placed.join(star.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "shared"), ["pivot", "node"])
    placed = work.keep(placed.withColumn("v", F.col("n") + F.col("n_pivot") - 2 * F.col("shared")), "beside")
    pairs = work.keep(possible(placed, similarity), "pairs")
    last = work.keep(verified(pairs, grams, similarity), "last")
    work.drop("grams", "members", "placed", "apart", "able", "beside")

    label = components(work.keep(found.union(last), "links4"), work)
    labelled = nodes.join(label, "node", "left").select("whole", "id", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    named = work.keep(labelled.join(smallest, "label").select("whole", "component_id"), "named")
    return rows.select("id", "fp", "whole").join(named, "whole", "left").select("id", "fp", "component_id")
