"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (one to three letters, word edges included) in
order of rank. A document's own list is compared with each profile: every n-gram counts the distance between its two
ranks, or the length of a profile if the profile lacks it. The language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, extended

by_value(__name__)

PROFILE = 300
#: Training reads about this many documents of each language, taken by a hash of their id.
SAMPLE_PER_LANGUAGE = 600
EDGE = 0x5F
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, 21 bits a letter, and how often each occurs. Empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    known = letters[np.minimum(c, 0xFFFF)]
    for x in np.unique(c[c > 0xFFFF]).tolist():
        known[c == x] = chr(x).isalpha()
    if not known.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = known.copy()
    keep[1:] |= known[:-1]
    c = np.where(known, c, EDGE)[keep].astype(np.uint64)
    c = np.concatenate([[np.uint64(EDGE)], c, [np.uint64(EDGE)]]) if c[-1] != EDGE else np.concatenate([[np.uint64(EDGE)], c])
    c = c[1:] if c[0] == c[1] == EDGE else c
    inner = c != EDGE
    s1, s2 = np.uint64(21), np.uint64(42)
    pairs = (c[:-1] << s1) | c[1:]
    triples = (c[:-2] << s2) | (c[1:-1] << s1) | c[2:]
    return np.unique(np.concatenate([c[inner], pairs, triples[inner[1:-1]]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    if len(codes) > 4 * most:  # ties of the last count stay, the sort below breaks them
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        high = counts >= least
        codes, counts = codes[high], counts[high]
    return codes[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    def __init__(self, texts: dict[str, list[str]], most: int = PROFILE):
        letters = letter_table()
        self.languages, self.most, lists = sorted(texts), most, []
        for name in self.languages:
            every = [grams(t, letters) for t in texts[name]]
            codes, where = np.unique(np.concatenate([x[0] for x in every]), return_inverse=True)
            lists.append(ranked(codes, np.bincount(where, np.concatenate([x[1] for x in every]), len(codes)).astype(np.int64), most))
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]))
        # The last column is for n-grams that no profile has.
        self.ranks = np.full((len(lists), len(self.codes) + 1), -1, np.int64)
        for k, own in enumerate(lists):
            self.ranks[k, np.searchsorted(self.codes, own)] = np.arange(len(own))

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        """A language and one minus its distance as a share of the greatest possible one."""
        own = ranked(*grams(text, letters), self.most) if text else np.zeros(0, np.uint64)
        if not len(own) or not len(self.codes):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = self.ranks[:, np.where(self.codes[at] == own, at, len(self.codes))]
        away = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return self.languages[best], float(1 - away[best] / (self.most * len(own)))


def learn(docs: DataFrame, trained: Column, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from the rows where `trained` holds and text and language are not null; about `sample` rows a language.

    Repeated rows count as often as they stand there, rows of one id are taken or left together. N-grams of equal
    frequency rank by their code points. An empty table gives no profile.
    """
    rows = docs.filter(trained & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return Profiles({})
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    chosen = None
    for name, n in counts.items():
        part = (F.col(lang_col) == name) & (place < int((1 << 30) * min(1.0, sample / n)))
        chosen = part if chosen is None else chosen | part
    texts: dict[str, list[str]] = {}
    for row in rows.filter(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).orderBy("id", "text").toLocalIterator():
        texts.setdefault(row["lang"], []).append(row["text"])
    return Profiles(texts)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    Texts that are null or without a letter get `und` and score 0, as does every text if nothing was learned. Equal
    distances go to the first language by name. Repeated rows give repeated rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            found = [profiles.predict(t, letters) for t in batch.column("text").to_pylist()]
            yield extended(batch, ["id"], lang_pred=pa.array([x[0] for x in found], pa.string()), score=pa.array([x[1] for x in found], pa.float64()))

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
