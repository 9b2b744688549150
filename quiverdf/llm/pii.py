"""Personal data: base patterns, and bootstrapped extraction from the contexts in which base finds stand.

The base patterns give the seeds. Every occurrence of a seed or of a token that looks like an identifier (four digits or
an @ at least) has the two words before it as its lexical pattern; what is glued to it ("tel:", "<") ends the second word,
and ^ stands for a word before the text's start. Patterns and instances form a graph: a pattern's confidence is the share of all
its occurrences in the whole corpus that are followed by an accepted instance, an instance's score combines the
confidences of the patterns that it follows. Both are computed in turn for `ROUNDS` rounds; instances over the
threshold are accepted and support patterns in the next round. What stands behind a pattern of high confidence is
found as personal data of kind `id`, beside the base finds, which always stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, by_value, extended

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
ROUNDS = 3
#: A pattern needs this many different instances, and this confidence to extract; an instance this score to be accepted.
SUPPORT, CONFIDENCE, ACCEPT = 5, 0.7, 0.7
START = "^"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
#: A second word that is glued to an instance ends with one of these.
GLUE = re.compile(r"""(.*["'<>=,;:(\[])[^"'<>=,;:(\[]""")
GLUED = re.compile(r"""["'<>=,;:(\[]""")
#: Bits of the filter of patterns at most, and in one row of it (as Spark's bitmaps have); pairs that a task counts at once.
FILTER_BITS, CHUNK_BITS, COUNTED = 1 << 25, 1 << 15, 100_000

# The base patterns. The look-behind of `ip` only keeps long digit runs linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*$")
DIGIT = re.compile("[0-9]")
CANDIDATE = re.compile(r"\(?[0-9](?:[()\x20.-]*+[0-9])++|[^\s\"'<>=,;:0-9@]*+[0-9@][^\s\"'<>=,;:]*+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x[-400:] if len(x.lstrip("0")) <= 3 else "999" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def context(text: str, start: int) -> str:
    """The last two words before a place, in lower case; START for those that the text lacks."""
    width = 64
    while True:
        # A word that the cut may have shortened is left out.
        words = text[max(0, start - width) : start].translate(FOLD).split()
        if len(words) > 2 or width >= start:
            return " ".join([START, START, *words][-2:])
        width *= 4


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """(pattern, instance, start, end, seed) of base finds and other tokens that look like identifiers."""
    out = [(context(text, a), text[a:b].translate(FOLD), a, b, True) for _, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    if DIGIT.search(text) or "@" in text:
        for m in CANDIDATE.finditer(text):
            a, b = m.start(), m.end()
            while b > a and not text[b - 1].isalnum():
                b -= 1
            while a < b and not (text[a].isalnum() or text[a] in "(+"):
                a += 1
            if len(DIGIT.findall(text[a:b])) < 4 and "@" not in text[a:b]:
                continue
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not (k < len(taken) and taken[k][0] < b):
                out.append((context(text, a), text[a:b].translate(FOLD), a, b, False))
    return out


SCAN = "id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<pattern:string,instance:string,start:long,end:long,seed:boolean>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = ("pattern", "instance", "start", "end", "seed")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, found = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                counts.append([n[k] for k in KINDS])
                bases.append(listed(base))
                found.append([dict(zip(names, x, strict=True)) for x in occurrences(text, base)])
            by_kind = {f"n_{k}": pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(KINDS)}
            yield extended(batch, ["id", "row"], **by_kind, base=pa.array(bases, pa.string()), found=pa.array(found, kind))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text")).mapInArrow(run, SCAN)


def positions(patterns: list[str], bits: int) -> np.ndarray:
    """The bit of a filter of so many bits that stands for each pattern."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p) for p in patterns), np.uint64, len(patterns)) % np.uint64(bits)


def marked(patterns: DataFrame) -> tuple[np.ndarray, int]:
    """A filter with the bits of all patterns, and its size; the driver sees `FILTER_BITS` bits at most, whatever their number."""
    bits = min(FILTER_BITS, max(CHUNK_BITS, 16 << int(patterns.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(batch.column("pattern").to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    at = patterns.select("pattern").mapInArrow(run, "at long")
    chunks = at.groupBy(F.floor(F.col("at") / CHUNK_BITS).alias("chunk")).agg(F.bitmap_construct_agg(F.col("at") % CHUNK_BITS).alias("bits"))
    filled = np.zeros((bits // CHUNK_BITS, CHUNK_BITS // 8), np.uint8)
    for x in chunks.collect():
        filled[x["chunk"]] = np.frombuffer(x["bits"], np.uint8)
    return filled.ravel(), bits


def neighbors(text: str) -> list[str]:
    """Each two neighboring words of a text, and each two of which the second ends where something may be glued to it."""
    words = [START, START, *text.translate(FOLD).split()]
    out = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    if GLUED.search(text):
        out += [f"{a} {m[1]}" for a, b in zip(words, words[1:], strict=False) if (m := GLUE.match(b))]
    return out


def corpus_counts(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """pattern, total: occurrences of each pattern's two words in all texts, whatever follows them.

    Words are those of `context`. Each task counts what a filter of the patterns lets pass before anything is joined, so
    the join sees a pattern once a task (again after every `COUNTED` others) and not once an occurrence; it drops
    what has passed without being a pattern.
    """
    bounded_batches(docs.sparkSession)
    filled, bits = marked(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "times"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                pairs = neighbors(text)
                at = positions(pairs, bits)
                hits = (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                counts.update([pairs[k] for k in np.flatnonzero(hits).tolist()])
                if len(counts) > COUNTED:
                    yield table()
                    counts.clear()
        yield table()

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "pattern string, times long")
    return counted.join(patterns.select("pattern"), "pattern").groupBy("pattern").agg(F.sum("times").alias("total"))


def confident_patterns(seen: DataFrame, totals: DataFrame, work: Workspace) -> DataFrame:
    """seen: pattern, instance, times, seed. Scores patterns and instances in turn; gives pattern, confidence."""
    graph = work.keep(seen.join(totals, "pattern", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long"))), "graph")
    # A pattern stands in the corpus at least as often as instances behind it were seen.
    least = graph.groupBy("pattern").agg(F.greatest(F.max("total"), F.sum("times")).alias("total"))
    graph = work.keep(graph.drop("total").join(least, "pattern"), "weighed")
    accepted = graph.groupBy("instance").agg(F.max("seed").alias("seed")).select("instance", F.col("seed").cast("double").alias("score"))
    accepted = work.keep(accepted, "instances0")
    for k in range(ROUNDS):
        good = graph.join(accepted.filter(F.col("score") >= ACCEPT), "instance")
        scored = good.groupBy("pattern").agg(F.sum("times").alias("hits"), F.count("*").alias("support"), F.max("total").alias("total"))
        scored = scored.filter(F.col("support") >= SUPPORT).select("pattern", (F.col("hits") / F.greatest("total", "hits")).alias("confidence"))
        scored = work.keep(scored, f"patterns{k}")
        if k + 1 < ROUNDS:
            miss = graph.join(scored, "pattern", "left").groupBy("instance").agg(
                F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))).alias("miss")
            )
            score = F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.exp("miss"))
            accepted = work.keep(miss.select("instance", score.alias("score")), f"instances{k + 1}")
    return scored.filter(F.col("confidence") >= CONFIDENCE)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base finds), base_sha256, spans.

    spans lists base finds by kind and start, then finds by context as kind `id`; offsets are code points, ends are
    exclusive. Null counts as the empty text, which has no spans. Repeated rows give repeated rows and count in patterns
    as often as they stand there; null and repeated ids are rows like others; an empty table gives an empty result;
    other columns are ignored.
    """
    work = Workspace(docs.sparkSession)
    rows = work.keep(scan(docs, id_col, text_col), "scan")
    seen = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    edges = seen.groupBy("pattern", "instance").agg(F.count("*").alias("times"), F.max("seed").alias("seed"))
    edges = work.keep(edges, "edges")
    broad = edges.groupBy("pattern").agg(F.count("*").alias("support"), F.max("seed").alias("seed"))
    broad = work.keep(broad.filter((F.col("support") >= SUPPORT)).select("pattern"), "broad")
    base = rows.select("row", "id", *(f"n_{k}" for k in KINDS), "base")
    if broad.isEmpty():
        more = base.withColumn("more", F.lit(""))
    else:
        totals = work.keep(corpus_counts(docs, text_col, broad), "totals")
        good = confident_patterns(edges.join(broad, "pattern"), totals, work)
        span = F.struct("start", F.concat_ws(":", F.lit(FOUND), "start", "end").alias("s"))
        extra = seen.filter(~F.col("seed")).join(good, "pattern").groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_set(span)), lambda x: x["s"]), ",").alias("more"))
        more = base.join(extra, "row", "left").withColumn("more", F.coalesce("more", F.lit("")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more")))
    return more.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
