"""Near-duplicates by SimHash: exact comparison of all fingerprints, tile by tile.

Fingerprints stand in the order of their population counts and are cut into tiles of `SIDE`. Two tiles meet only if
their population counts are at most the radius apart; then numpy takes exclusive-or and bit counts of all their pairs.
That alone would let half of all pairs meet, so it is done within segments: fingerprints within `radius` bits agree on
at least one of radius + 1 segments of the 64 bits, and each segment value has its own row of tiles. Rows of more than
`TILE` fingerprints are dealt out to several tasks, again by population count, and within one count by a hash.

A task passes on a star for each linked group of a tile row, not its pairs. The stars join to components by repeated
minimum labels with pointer jumping, each round written to the shared folder.

A few bits find texts that differ in some words of a hundred. `near_groups` with a `similarity` asks for more: two texts
are linked if their sets of word shingles have that Jaccard similarity, which at 0.8 leaves some ten differing bits, too
many for tiles to be skipped by. There fingerprints propose links together with shared bands of the sets (`shingle_sets`),
and the whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, by_value, components, extended, partitions

by_value(__name__)

RADIUS = 4
WORDS = 4
SEED = 42
TILE, SIDE = 1024, 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK = 4096


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        # One shingle: a bit of the only hash is set in over half of the hashes if it is set.
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    ends = np.fromiter(map(len, tokens), np.int64, len(tokens)).cumsum() + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, n = np.zeros(64, np.int64), len(tokens) - words + 1
    first, last = starts[:n].tolist(), ends[words - 1 :].tolist()
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * count > n))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """id, fp: the fingerprint's bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in batch.column("body").to_pylist()], dtype=np.uint64)
            yield extended(batch, ["id"], fp=pa.array(fps.view(np.int64)))

    body = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).mapInArrow(run, "id long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """Shift and width of each of radius + 1 segments of 64 bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def close_pairs(fps: np.ndarray, radius: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j in population order) of fingerprints at most `radius` bits apart, tile pair by tile pair."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int64)
    first, second = [], []
    starts = range(0, len(fps), side)
    for i in starts:
        most = pop[min(i + side, len(fps)) - 1]
        for j in range(i, len(fps), side):
            if pop[j] - most > radius:
                break  # this tile and all behind it hold too many bits
            a, b = np.nonzero(np.bitwise_count(fps[i : i + side, None] ^ fps[None, j : j + side]) <= radius)
            if i == j:
                a, b = a[a < b], b[a < b]
            first.append(order[a + i])
            second.append(order[b + j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def stars(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of fingerprints linked within one row of tiles: of each group the smallest node with each other one."""
    a, b = close_pairs(fps, radius)
    if not len(a):
        return nodes[:0], nodes[:0]
    label = nodes.copy()
    while True:
        lower = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, lower)
        np.minimum.at(after, b, lower)
        if (after == label).all():
            break
        label = after
    member = label != nodes
    return label[member], nodes[member]


def links(nodes: DataFrame, radius: int, tile: int, work: Workspace) -> DataFrame:
    """nodes: node, fp, distinct fingerprints. Stars (a, b) whose components are those of all links."""
    each = F.array(*[F.struct(F.lit(k).alias("seg"), F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("val")) for k, (s, w) in enumerate(segments(radius))])
    rows = nodes.select("node", "fp", F.bit_count(F.col("fp")).cast("int").alias("pop"), F.explode(each).alias("x")).select("node", "fp", "pop", "x.seg", "x.val")
    counts = rows.groupBy("seg", "val", "pop").agg(F.count("*").alias("n"))
    # At most 65 population counts for each segment value.
    full = counts.groupBy("seg", "val").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("cuts")))).alias("tiles"))
    full = work.keep(full.filter(F.col("n") > tile).select("seg", "val", "tiles"), "full_rows")
    placed = rows.join(full, ["seg", "val"], "left")

    def pairs_of(pop: Column, tiles: Column) -> Column:
        own = F.filter(tiles, lambda t: t["pop"] == pop)[0]["cuts"]
        cut = F.pmod(F.xxhash64("fp"), own).cast("int")
        near = F.filter(tiles, lambda t: F.abs(t["pop"] - pop) <= radius)
        others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["cuts"] - 1), lambda c: F.struct(t["pop"].alias("p"), c.alias("c")))))
        me = F.struct(pop.alias("p"), cut.alias("c"))
        return F.transform(others, lambda o: F.struct(F.least(me, o).alias("u"), F.greatest(me, o).alias("v")))

    nowhere = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("c"))
    one = F.array(F.struct(nowhere.alias("u"), nowhere.alias("v")))
    placed = placed.select("node", "fp", "seg", "val", F.explode(F.when(F.col("tiles").isNull(), one).otherwise(pairs_of(F.col("pop"), F.col("tiles")))).alias("t"))
    placed = placed.select("node", "fp", F.xxhash64("seg", "val", "t").alias("key"), "seg", "val")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch])
            change = np.flatnonzero(np.diff(batch["key"].to_numpy())) + 1
            cut = int(change[-1]) if len(change) else 0
            held = batch.iloc[cut:]
            if cut:
                yield compare(batch.iloc[:cut], change)
        if held is not None and len(held):
            yield compare(held, np.zeros(0, np.int64))

    def compare(part: pd.DataFrame, change: np.ndarray) -> pd.DataFrame:
        fps, nodes = part["fp"].to_numpy().view(np.uint64), part["node"].to_numpy()
        a, b = [], []
        edges = [0, *change[change < len(part)].tolist(), len(part)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 1:
                x, y = stars(fps[lo:hi], nodes[lo:hi], radius)
                if len(x):
                    a.append(x)
                    b.append(y)
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    # Rows of different tile pairs with one hash meet in one comparison, which adds only true links.
    dealt = placed.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "seg", "val")
    return dealt.select("node", "fp", "key").mapInPandas(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, tile: int = TILE, similarity: float | None = None, work: Workspace | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part with the
    smallest other id of their fingerprint, or null where there is none. Repeated rows give repeated rows. An empty
    table gives an empty result; other columns are ignored.

    With a `similarity` of 0.8 or more, texts are linked by the Jaccard similarity of their sets of word shingles and
    not by bits alone. Texts without words have equal sets; rows with a null id then take part with the smallest other
    id of their set.
    """
    work = work or Workspace(docs.sparkSession)
    if similarity is not None:
        from .shingle_sets import similar_groups

        propose = lambda fps: links(fps, radius, tile, work)
        out = similar_groups(docs, id_col, text_col, similarity, words, propose, work)
        return out.select(F.col("id").alias(id_col), hex_of("fp").alias("fingerprint"), "component_id")
    fps = work.keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = work.keep(fps.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    label = components(work.keep(links(nodes.filter(F.col("node").isNotNull()), radius, tile, work), "links"), work)
    named = work.keep(nodes.join(label, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id")), "named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), hex_of("fp").alias("fingerprint"), "component_id")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
