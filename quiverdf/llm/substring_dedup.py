"""Removal of bytes in 50-byte strings that an earlier document also holds.

A suffix order of the whole collection finds repeats, but one symbol a round for whole documents would take as many
passes over everything as the longest document has bytes. So the collection is first cut into short overlapping
strings that keep every 50-byte string whole, and equal ones are made to meet:

1. Each 50-byte window picks the 16-byte string of least hash in it, its anchor; equal windows pick equal anchors at
   equal places. The windows of one anchor form a context of 50 to 84 bytes. Contexts are dealt out by the anchor's
   hash, as packed records of fixed size. Within a task, copies of a context in later documents are settled at once and
   only the earliest one travels, so that a passage that many documents share does not meet in one task.
2. Where records meet, whole contexts that an earlier document has are settled; contexts are taken as equal if they
   agree in 96 bits of two hashes and in length. A shared window has 17 equal bytes more on one side of the anchor at
   least; contexts of different documents that agree there, but not as a whole, are open.
3. Open contexts are read from their documents and dealt out by the 33 bytes they agree in, so that an anchor with very
   many contexts is split by what stands beside it. Each task builds the Burrows-Wheeler transform of its collection
   of contexts column by column: a round inserts the next symbol of every context, finds the places of the new suffixes
   by the last-to-first mapping and updates the common prefixes, between files that are read and written in sequence.
   Runs with common prefixes of 50 or more are equal strings; those above the run's smallest document are settled.
4. The settled ranges are gathered by row, joined to their document, merged and cut out, one document at a time.

Documents are told apart by a row number; the id only says which of two is the earlier one.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, by_value, extended, numbered, partitions

by_value(__name__)

LENGTH, GRAM = 50, 16
SIDE = (LENGTH - GRAM + 1) // 2  # 17: one side of the anchor has at least so many bytes of a window
PART_BYTES = 1 << 20
FLUSH_RECORDS = 1_500_000
COLLECTION = 4_000
BUCKETS_PER_PARTITION = 4
#: A column of a transform up to this size stays in memory; beyond it is a file in the task's own temporary folder, which
#: a retry writes anew.
IN_MEMORY = 64 << 20
ROWS_PER_BATCH = 100_000

RECORD = [("whole", "<u8"), ("check", "<u4"), ("left", "<u4"), ("right", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("at", "<u4"), ("more", "u1")]
RANGE = [("row", "<i8"), ("at", "<u4"), ("size", "<u4")]
KEPT_RECORDS, KEPT_RANGES, KEPT_OPEN = 0, 1, 2


def tables() -> tuple[np.ndarray, ...]:
    """Byte codes for anchors and for the two context hashes, powers and inverse powers of their base."""
    r = np.random.default_rng(20240229)
    codes = r.integers(0, 1 << 63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = 2 * PART_BYTES + 256
    power, back = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    power[0] = back[0] = 1
    return (*codes, np.multiply.accumulate(power), np.multiply.accumulate(back))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def contexts(b: np.ndarray, valid: np.ndarray, tabs) -> tuple[np.ndarray, ...]:
    """Of the valid windows of bytes b: first window and number of further windows of each context, its anchor's hash,
    two hashes of the whole and those of the anchor with 17 bytes on its left and right (0 where no window needs it)."""
    codes, whole_codes, check_codes, power, back = tabs
    h, gap, m = codes[b], 1, 0x2545F4914F6CDD1D
    while gap < GRAM:
        h = h[:-gap] * np.uint64(m) + h[gap:]
        m, gap = m * m % (1 << 64), 2 * gap
    h = mixed(h)
    places = np.uint64(1 << 22)
    key = (h & ~(places - np.uint64(1))) | np.arange(len(h), dtype=np.uint64)
    low, width, want = key, 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: width - want], low[want - width :])
    anchor = (low & (places - np.uint64(1))).astype(np.int64)
    windows = np.flatnonzero(valid[: len(anchor)])
    anchor = anchor[windows]
    new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(windows) != 1)])
    first, last, anchor = windows[new], windows[np.r_[new[1:] - 1, len(windows) - 1]], anchor[new]
    weight = power[: len(b)]

    def sums(table: np.ndarray):
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * weight, out=run[1:])
        return lambda s, e: (run[e] - run[s]) * back[s]

    part = sums(whole_codes)
    salt = ((last - first) * 64 + (anchor - first)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    whole = mixed(part(first, last + LENGTH) + salt)
    check = mixed(sums(check_codes)(first, last + LENGTH)) >> np.uint64(32)
    wide = np.where(anchor - first >= SIDE, anchor - SIDE, anchor)
    left = np.where(anchor - first >= SIDE, (mixed(part(wide, anchor + GRAM)) >> np.uint64(32)) | np.uint64(1), np.uint64(0))
    fits = (anchor - last <= SIDE) & (anchor + GRAM + SIDE <= last + LENGTH)
    end = np.where(fits, anchor + GRAM + SIDE, anchor)
    right = np.where(fits, (mixed(part(anchor, end)) >> np.uint64(32)) | np.uint64(1), np.uint64(0))
    return first, last - first, h[anchor], whole, check, left, right


def parts(docs: Iterable[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes of several documents (id, row, bytes), or of a part of one, with for each byte whether a window starts there,
    its document, row and place."""
    held: list[tuple[int, bytes, int, int]] = []
    size = 0

    def flush():
        b = np.frombuffer(b"".join(x[1] for x in held), np.uint8)
        n = np.array([len(x[1]) for x in held], np.int64)
        ends = n.cumsum()
        left = np.repeat(ends, n) - np.arange(len(b))
        each = lambda k: np.repeat(np.array([x[k] for x in held], np.int64), n)
        return b, left >= LENGTH, each(0), each(3), np.arange(len(b)) - np.repeat(ends - n, n) + each(2)

    for doc, row, body in docs:
        if len(body) < LENGTH:
            continue
        for at in range(0, max(1, len(body) - LENGTH + 1), PART_BYTES):
            some = body[at : at + PART_BYTES + LENGTH - 1]
            held.append((doc, some, at, row))
            size += len(some)
            if size >= PART_BYTES // 2:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def merged(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of one document's ranges, joined where they touch."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], at[order] + size[order]
    reach = np.maximum.accumulate(end)
    start = np.flatnonzero(np.r_[True, at[1:] > reach[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[start], reach[np.r_[start[1:] - 1, len(at) - 1]] if len(at) else at


def range_rows(row: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), RANGE)
    out["row"], out["at"], out["size"] = row, at, size
    return out


def blobs(kind: int, buckets: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(kind, bucket, rows as bytes), one for each bucket."""
    if not len(rows):
        return []
    order = np.argsort(buckets, kind="stable")
    buckets, rows = buckets[order], rows[order]
    cut = np.flatnonzero(np.r_[True, np.diff(buckets) != 0])
    return [(kind, int(buckets[a]), rows[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(rows)], strict=True)]


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["kind", "bucket", "rows"])


BLOB = "kind int, bucket long, rows binary"
MET = "kind int, row long, at long, size int, side long"


def met_batches(kind: int, rows: np.ndarray, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Ranges or open contexts as columns."""
    for k in range(0, len(rows), ROWS_PER_BATCH):
        some = rows[k : k + ROWS_PER_BATCH]
        beside = np.zeros(len(some), np.int64) if side is None else side[k : k + ROWS_PER_BATCH]
        columns = [np.full(len(some), kind, np.int32), some["row"].astype(np.int64), some["at"].astype(np.int64), some["size"].astype(np.int32), beside]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["kind", "row", "at", "size", "side"])


def settle(rec: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of contexts that an earlier document has whole, and which records are left."""
    if not len(rec):
        return np.zeros(0, RANGE), np.zeros(0, np.int64)
    order = np.lexsort((rec["doc"], rec["more"], rec["check"], rec["whole"], group))
    s, g = rec[order], group[order]
    new = np.r_[True, (s["whole"][1:] != s["whole"][:-1]) | (s["check"][1:] != s["check"][:-1]) | (s["more"][1:] != s["more"][:-1]) | (g[1:] != g[:-1])]
    least = s["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = s["doc"] > least
    gone = s[later]
    return range_rows(gone["row"], gone["at"], gone["more"].astype(np.uint32) + LENGTH), order[~later]


def open_records(rec: np.ndarray, side: str) -> np.ndarray:
    """Numbers of records that agree on that side of the anchor with a different context of another document."""
    have = np.flatnonzero(rec[side])
    have = have[np.lexsort((rec["doc"][have], rec[side][have]))]
    s = rec[have]
    if not len(s):
        return have
    start = np.flatnonzero(np.r_[True, np.diff(s[side].astype(np.int64)) != 0])
    last = np.r_[start[1:], len(s)] - 1
    several = s["doc"][start] != s["doc"][last]
    return have[np.repeat(several, last - start + 1)]


class Column:
    """An array in a file that is written and read in sequence; in memory while small, without a name on disk beyond."""

    def __init__(self, dtype, values: np.ndarray):
        self.dtype = dtype
        self.write(values)

    def write(self, values: np.ndarray) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)  # noqa: SIM115
        self.file.write(np.ascontiguousarray(values, self.dtype).tobytes())

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.dtype)


class RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value of each a..b, b inclusive."""
        out = np.zeros(len(a), self.levels[0].dtype)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            w = level == k
            out[w] = np.minimum(self.levels[k][a[w]], self.levels[k][b[w] + 1 - 2**k])
        return out


def collection_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: string number, length, common prefix with the one before.

    Round t inserts the suffixes of length t. The symbol before the suffix of length t - 1, at its place in the
    transform, gives the new suffix's place: all end markers come first, then suffixes by their first symbol and,
    within a symbol, in the order of the transform. A string's start has the symbol END, which no suffix begins with.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    longest = int(size.max()) if m else 0
    flat = np.frombuffer(b"".join(strings), np.uint8)
    # UTF-8 has no byte of 255, which then marks a start; other texts take wider symbols.
    wide = bool(len(flat)) and int(flat.max()) == 255
    kind, end = (np.uint16, 256) if wide else (np.uint8, 255)
    # Column t: the symbol before the suffix of length t.
    t_of = np.repeat(size.cumsum(), size) - 1 - np.arange(len(flat))
    text = np.full((longest + 1, m), end, kind)
    text[t_of, np.repeat(np.arange(m), size)] = flat
    symbols, commons = Column(kind, text[0]), Column(np.uint8, np.zeros(m))
    place = np.arange(m)  # of each string's longest suffix so far
    live = np.flatnonzero(size > 0)
    for t in range(1, longest + 1):
        symbol, common = symbols.read(), commons.read()
        n = len(symbol)
        order = np.argsort(symbol, kind="stable")
        here = place[live]
        at = np.zeros(n, bool)
        at[here] = True
        who = np.empty(n, np.int32)
        who[here] = live
        r = np.flatnonzero(at[order])  # END is the last symbol
        here = order[r]
        live = who[here]
        mine = symbol[here]
        to = m + r
        lowest = RangeMinimum(common)
        before = order[np.maximum(r - 1, 0)]
        has_before = (r > 0) & (symbol[before] == mine)
        value = np.zeros(len(live), np.uint8)
        value[has_before] = lowest(before[has_before] + 1, here[has_before]) + 1
        after = order[np.minimum(r + 1, n - 1)]
        has_after = (r + 1 < n) & (symbol[after] == mine)
        follow = lowest(here[has_after] + 1, after[has_after]) + 1

        old = np.ones(n + len(live), bool)
        old[to] = False
        more, mores = np.empty(len(old), kind), np.empty(len(old), np.uint8)
        more[old], mores[old] = symbol, common
        more[to], mores[to] = text[t, live], value
        # Common prefixes of the suffixes that follow a new one; a new one that follows has the same value already.
        mores[to[has_after] + 1] = follow
        symbols.write(more)
        commons.write(mores)
        place[live] = to
        live = live[size[live] > t]
    symbol, common = symbols.read(), commons.read()
    # The mapping walks every string from its end marker to its start.
    rank = np.empty(len(symbol), np.int64)
    rank[np.argsort(symbol, kind="stable")] = np.arange(len(symbol))
    owner, length = np.empty(len(symbol), np.int32), np.empty(len(symbol), np.uint8)
    place, live = np.arange(m), np.arange(m)
    for t in range(longest + 1):
        owner[place], length[place] = live, t
        on = size[live] > t
        live, place = live[on], m + rank[place[on]]
    return owner, length, common


def repeated(strings: list[bytes], docs: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranges of 50-byte strings that a string of an earlier document holds."""
    owner, length, common = collection_order(strings)
    size = np.array([len(s) for s in strings], np.int64)
    start = np.flatnonzero(np.r_[True, common[1:] < LENGTH])
    doc = docs[owner]
    # Suffixes under 50 bytes are runs of their own.
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.r_[start, len(doc)]))
    hit = np.flatnonzero((length >= LENGTH) & (doc > least))
    string, place = owner[hit], size[owner[hit]] - length[hit]
    # Windows of one string that stand side by side are one range.
    order = np.lexsort((place, string))
    string, place = string[order], place[order]
    new = np.flatnonzero(np.r_[True, (np.diff(string) != 0) | (np.diff(place) > LENGTH)]) if len(hit) else order
    last = np.r_[new[1:], len(hit)] - 1 if len(hit) else order
    return range_rows(rows[string[new]], at[string[new]] + place[new], place[last] - place[new] + LENGTH)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null counts as the empty text; texts under 50 bytes lose nothing. Rows with equal ids are documents of their own,
    none of them earlier than the other, so that repeated rows keep what they alone share. A null id counts as smaller
    than every other. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Workspace(spark)
    lanes = partitions(spark)
    buckets = lanes * BUCKETS_PER_PARTITION
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    source = numbered(docs).select(F.col(id_col).cast("long").alias("id"), F.col("__row").alias("row"), body.alias("body"))
    null_id = -(1 << 63)
    ordered_id = F.coalesce("id", F.lit(null_id)).alias("doc")  # the smallest long stands for null, too

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs = tables()
        held, held_buckets, n = [], [], 0

        def flush():
            rec, where = np.concatenate(held), np.concatenate(held_buckets)
            ranges, left = settle(rec, where)
            return blob_batch(blobs(KEPT_RECORDS, where[left], rec[left]) + blobs(KEPT_RANGES, np.mod(ranges["row"], buckets), ranges))

        for batch in batches:
            for b, valid, doc, row, at in parts(zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "body")), strict=True)):
                first, more, ahash, whole, check, left, right = contexts(b, valid, tabs)
                rec = np.zeros(len(first), RECORD)
                rec["whole"], rec["check"], rec["left"], rec["right"] = whole, check, left, right
                rec["doc"], rec["row"], rec["at"], rec["more"] = doc[first], row[first], at[first], more
                held.append(rec)
                held_buckets.append((ahash % np.uint64(buckets)).astype(np.int64))
                n += len(rec)
                if n >= FLUSH_RECORDS:
                    yield flush()
                    held, held_buckets, n = [], [], 0
        if n:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, mine in by_bucket(batches):
            yield from met_batches(KEPT_RANGES, np.frombuffer(b"".join(x for k, x in mine if k == KEPT_RANGES), RANGE))
            rec = np.frombuffer(b"".join(x for k, x in mine if k == KEPT_RECORDS), RECORD)
            ranges, left = settle(rec, np.zeros(len(rec), np.int8))
            yield from met_batches(KEPT_RANGES, ranges)
            rec = rec[left]
            for k, name in enumerate(("left", "right")):
                own = rec[open_records(rec, name)]
                side = mixed(own[name].astype(np.uint64) * np.uint64(2) + np.uint64(k) + (np.uint64(bucket) << np.uint64(33))).view(np.int64)
                yield from met_batches(KEPT_OPEN, range_rows(own["row"], own["at"], own["more"].astype(np.uint32) + LENGTH), side)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        now, mine = None, []
        for batch in batches:
            for kind, bucket, rows in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "rows")), strict=True):
                if bucket != now:
                    if mine:
                        yield now, mine
                    now, mine = bucket, []
                mine.append((kind, rows))
        if mine:
            yield now, mine

    dealt = source.select(ordered_id, "row", "body").mapInArrow(find, BLOB).repartition(lanes, "bucket").sortWithinPartitions("bucket")
    met = work.keep(dealt.mapInArrow(meet, MET), "met")
    ranges = met.filter(F.col("kind") == KEPT_RANGES).select("row", "at", "size")
    asked = met.filter(F.col("kind") == KEPT_OPEN).select("row", "at", "size", "side")

    def ranges_of(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
        """One document's structs of numbers, a column for each field."""
        rows = batch.column(name)[k].values
        return np.stack([f.to_numpy(zero_copy_only=False).astype(np.int64) for f in rows.flatten()]) if rows is not None else np.zeros((2, 0), np.int64)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("body")):
                text, (at, size, side) = text.as_py(), ranges_of(batch, "asks", k)
                n = len(at)
                columns = {"side": side, "doc": np.full(n, batch.column("doc")[k].as_py(), np.int64), "row": np.full(n, batch.column("row")[k].as_py(), np.int64), "at": at}
                pieces = pa.array([text[a : a + w] for a, w in zip(at.tolist(), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), pieces], names=[*columns, "text"])

    def order_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            side = batch.column("side").to_numpy()
            # The last group may go on in the next batch; what stands before it can be worked off.
            cut = int(np.flatnonzero(np.r_[True, np.diff(side) != 0])[-1]) if len(side) else 0
            ends = bool(cut) or bool(held) and len(side) and held[-1].column("side")[-1].as_py() != side[0]
            if ends and n + cut >= COLLECTION:
                yield from ordered([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += len(batch)
        if n:
            yield from ordered(held)

    def ordered(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches([b for b in some if len(b)])
        doc, row, at = (every.column(c).to_numpy() for c in ("doc", "row", "at"))
        yield from met_batches(KEPT_RANGES, repeated(every.column("text").to_pylist(), doc, row, at))

    if not asked.isEmpty():
        asks = asked.groupBy("row").agg(F.collect_list(F.struct("at", "size", "side")).alias("asks"))
        open_texts = source.select(ordered_id, "row", "body").join(asks, "row").mapInArrow(cut_out, "side long, doc long, row long, at long, text binary")
        more = open_texts.repartition(lanes, "side").sortWithinPartitions("side").mapInArrow(order_all, MET)
        ranges = ranges.unionByName(work.keep(more.select("row", "at", "size"), "ordered"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column("body")):
                text, digest, at = text.as_py(), hashlib.sha256(), 0
                starts, ends = merged(*ranges_of(batch, "gone", k))
                for a, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(text[at:a])
                    at = e
                digest.update(text[at:])
                out.append((len(text), int((ends - starts).sum()), len(starts), digest.hexdigest()))
            names = ("n_bytes", "n_removed", "n_spans")
            columns = {c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(names)}
            yield extended(batch, ["id"], **columns, kept_sha256=pa.array([x[3] for x in out], pa.string()))

    gone = ranges.groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("gone"))
    result = source.join(gone, "row", "left").select("id", "body", "gone").mapInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return result.withColumnRenamed("id", id_col)
