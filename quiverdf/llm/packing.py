"""Packing token streams into sequences by order-preserving dynamic programming.

The documents of a partition form one stream of ids in their order. Cuts may fall behind a document, behind a sentence
or, where neither is near, on a grid inside a sentence. A sequence costs its padding and the cut at its end a penalty
that grows in that order. With f(j) the least cost of all ids before cut j and p its position,

    f(j) = penalty(j) + min over cuts i within one sequence of f(i) + p(i) + (longest - p(j)),

so one queue, kept monotone in f(i) + p(i), gives every minimum in amortised constant time. Lengths that are a power
of two need no padding and are tried besides, at a price for one more sequence. The stream is worked off in blocks; of each block all but the last
sequence is settled. What is left of a partition at its end, less than one sequence, joins the ends of the partitions
next to it in a second, short stream that is packed in the same way; only a stream of `MERGED` such ends leaves a
last sequence that may be short.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, by_value, trim

by_value(__name__)

LONGEST = 2048
END_ID = 1
SENTENCE_PENALTY, INNER_PENALTY, GRID = 4, 64, 32
#: A shorter sequence needs no padding, but is one more; the tail that is left to the next stream is free.
SHORTEST_UNPADDED, SHORT_COST = 256, 128
BLOCK_IDS = 1 << 20
#: A table of words holds so many of at most so many characters; longer ones are encoded each time.
CACHE_WORDS, CACHE_LENGTH = 600_000, 48
#: Partitions whose ends are packed together.
MERGED = 1024
#: What the tokenizer's patterns take as white space.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: str.split() also splits at these, the tokenizer does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SENTENCE_ENDS = frozenset(".!?\u2026\u3002\uff01\uff1f")

PIECE = "row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What is left of a document at a partition's end has its ids and sentence ends besides; sequence_id is the partition.
SCHEMA = f"doc_id long, {PIECE}, ids binary, ends binary"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in own else n))
        n += b not in own
    return out


class WordTokenizer(dict):
    """Ids of words, as little-endian 32-bit words, by a word-end BPE file that drops white space.

    White space never joins two words' ids in such a file, so a text's ids are those of its words in a row, and each
    distinct word is encoded once. Latin words with plain punctuation at their end go to the BPE model itself, which
    is several times as fast as the whole tokenizer; every other word goes through the whole.
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]+)([.,!?;:]*)")

    def __init__(self, file: str, keep: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(file)
        self.model, self.letters, self.keep = self.plain.model, byte_letters(), keep

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        if word.isascii() and (stem := word.rstrip(".,!?;:")).isalpha():
            # ASCII letters and punctuation stand for themselves.
            ids = [t.id for t in self.model.tokenize(stem.lower())]
            if len(stem) < len(word):
                ids += [t.id for t in self.model.tokenize(word[len(stem) :])]
        elif m := self.PLAIN.fullmatch(word):
            parts = ["".join([self.letters[b] for b in p.lower().encode()]) for p in m.groups() if p]
            ids = [t.id for p in parts for t in self.model.tokenize(p)]
        else:
            ids = self.plain.encode(word, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(word) <= CACHE_LENGTH:
            self[word] = out
        return out

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """A text's ids, and the numbers of ids before which a sentence has ended."""
        words = [w for w in SPACE.split(text) if w] if NOT_SPACE.search(text) else text.split()
        parts = list(map(self.__getitem__, words))
        at = [k for k, w in enumerate(words) if w[-1] in SENTENCE_ENDS]
        ends = np.fromiter(map(len, parts), np.int64, len(parts)).cumsum()[at] // 4 if at else np.zeros(0, np.int64)
        return b"".join(parts), ends


def candidates(ends: Iterable[tuple[int, np.ndarray]], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Positions of cuts and their penalties. ends: for each document its number of ids and its sentence ends."""
    places, costs, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
    for n, inner in ends:
        inner = inner[(inner > 0) & (inner < n)]
        p = np.append(np.unique(inner), n) + base
        c = np.full(len(p), SENTENCE_PENALTY, np.int64)
        c[-1] = 0
        places.append(p)
        costs.append(c)
        base += n
    p, c = np.concatenate(places), np.concatenate(costs)
    step = min(GRID, longest)
    gaps = np.flatnonzero(np.diff(p) > step)
    if len(gaps):
        more = np.concatenate([np.arange(p[g] + step, p[g + 1], step) for g in gaps])
        p, c = np.concatenate([p, more]), np.concatenate([c, np.full(len(more), INNER_PENALTY, np.int64)])
        order = np.argsort(p, kind="stable")
        p, c = p[order], c[order]
    return p, c


def best_cuts(p: np.ndarray, c: np.ndarray, longest: int = LONGEST, goes_on: bool = False) -> list[int]:
    """The cut positions of least cost; p starts with 0 and its last position is a cut. Where the stream goes on behind
    it, the last sequence is not settled and costs nothing yet."""
    n, where = len(p), p.tolist()
    cost, back = [0] * n, [0] * n
    penalty = c.tolist()
    exact: dict[int, list[int]] = {}
    size = SHORTEST_UNPADDED
    while size <= longest:
        k = np.searchsorted(p, p - size)
        for j in np.flatnonzero((p >= size) & (p[np.minimum(k, n - 1)] == p - size)).tolist():
            exact.setdefault(j, []).append(int(k[j]))
        size *= 2
    queue: deque[int] = deque([0])
    keyed = [0] * n
    for j in range(1, n):
        here = where[j]
        while where[queue[0]] < here - longest:
            queue.popleft()
        i = queue[0]
        least = keyed[i] + longest - here
        for k in exact.get(j, ()):
            price = cost[k] + (SHORT_COST if here - where[k] < longest else 0)
            if price < least:
                least, i = price, k
        cost[j], back[j] = least + penalty[j], i
        keyed[j] = key = cost[j] + here
        while queue and keyed[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    if goes_on and j:
        near = range(int(np.searchsorted(p, where[j] - longest)), j)
        back[j] = min(near, key=lambda i: cost[i])
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order and gives rows of pieces."""

    def __init__(self, first_sequence: int, longest: int = LONGEST, block: int = BLOCK_IDS):
        self.sequence, self.longest, self.block = first_sequence, longest, block
        self.docs: list[list] = []  # key, ids as bytes, ids before this part, ids of the document, sentence ends of this part
        self.held = 0

    def add(self, key, raw: bytes, ends: np.ndarray, before: int = 0, total: int | None = None) -> list[tuple]:
        n = len(raw) // 4
        self.docs.append([key, raw, before, n if total is None else total, ends])
        self.held += n
        return self.settle() if self.held >= self.block else []

    def settle(self, last: bool = False) -> list[tuple]:
        if not self.held:
            return []
        cuts = best_cuts(*candidates(((len(d[1]) // 4, d[4]) for d in self.docs), self.longest), self.longest, not last)
        lengths = np.diff([0, *cuts]).tolist()
        if not last:
            lengths.pop()
        rows, at, k = [], 0, 0
        for length in lengths:
            offset = 0
            while offset < length:
                key, raw, before, total, _ = self.docs[k]
                take = min(length - offset, len(raw) // 4 - at)
                rows.append((*key, before + at, take, zlib.crc32(raw[4 * at : 4 * (at + take)]), total, self.sequence, offset))
                offset += take
                at += take
                if at == len(raw) // 4:
                    k, at = k + 1, 0
            self.sequence += 1
        self.docs = self.docs[k:]
        if at:
            d = self.docs[0]
            self.docs[0] = [d[0], d[1][4 * at :], d[2] + at, d[3], d[4][d[4] > at] - at]
        self.held -= sum(lengths)
        return rows


def piece_batch(rows: list[tuple], rest: list[list] = (), partition: int = 0) -> pa.RecordBatch:
    """rows: settled pieces. rest: what a packer still holds."""
    rows = [(*r, None, None) for r in rows]
    for k, (key, raw, before, total, ends) in enumerate(rest):
        rows.append((*key, before, len(raw) // 4, None, total, partition, k, raw, ends.astype("<i8").tobytes()))
    kinds = [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row.

    Every document ends with END_ID, so that null and empty texts give one piece of that id. Rows with a null id or
    repeated rows are documents of their own, told apart by `row`. Texts of any length are cut into as many pieces as
    needed. An empty table gives an empty result. Sequence ids are unique but not consecutive: each partition counts
    from its own start.
    """
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer_file)
        partition = TaskContext.get().partitionId()
        packer = Packer(partition << 40, longest)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "text")), strict=True):
                raw, ends = words.encode(text)
                rows += packer.add((doc_id, row), raw + end, ends)
            if rows:
                yield piece_batch(rows)
        yield piece_batch(packer.settle(), packer.docs, partition)
        del words, packer
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((1 << 62) + (TaskContext.get().partitionId() << 40), longest)
        for batch in batches:
            rows: list[tuple] = []
            for x in batch.to_pylist():
                rows += packer.add((x["doc_id"], x["row"]), x["ids"], np.frombuffer(x["ends"], "<i8"), x["start"], x["doc_tokens"])
            yield piece_batch(rows)
        yield piece_batch(packer.settle(last=True))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = work.keep(texts.mapInArrow(run, SCHEMA), "pieces")
    rest = first.filter("ids IS NOT NULL").withColumn("lane", F.floor(F.col("sequence_id") / MERGED))
    lanes = rest.agg(F.countDistinct("lane")).first()[0]
    rest = rest.repartition(max(1, lanes), "lane").sortWithinPartitions("lane", "sequence_id", "offset").drop("lane").mapInArrow(merge, SCHEMA)
    out = first.filter("ids IS NULL").unionByName(rest)
    return out.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")
