"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the sum of two inputs: an embedding of the word, if the training sample knows it, and the mean
embedding of its character trigrams. A gated recurrent unit reads a window of words in each direction, attention pools
its states and a logistic unit scores the window. Windows overlap and cover the whole text; a document scores as its
worst window. Training sees documents with their labels only: the gradient of a document runs through its worst window.

Every distinct word of a batch is embedded and projected once, so that scoring a window is table look-up, one small
product and the gates for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, extended, trim

by_value(__name__)

WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
TRIGRAMS = 4096
VOCABULARY = 20_000
#: Training reads about this many documents of each label, taken by a hash of their id.
SAMPLE_PER_LABEL = {1: 800, 0: 1600}
UPDATES, BATCH, RATE, DROPOUT, PRIOR = 250, 32, 0.03, 0.2, 5
#: Embeddings learn slower than the rest, so that few documents are not learned by heart; all weights decay.
SLOW, DECAY = 0.05, 0.01
SEED = 5
CHUNK, TOGETHER = 1024, 250
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(word: str) -> str:
    return word.lower().strip(EDGES)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, one after another, and where each word's start."""
    raw = [f"<{w}>".encode() for w in words]
    raw = [x if len(x) > 2 else b"<_>" for x in raw]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    h = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(20)
    ends = size.cumsum()
    inside = np.ones(len(h), bool)
    inside[np.concatenate([ends[:-1] - 2, ends[:-1] - 1]).astype(np.int64)] = False
    starts = np.concatenate([[0], (size - 2).cumsum()[:-1]])
    return h[inside].astype(np.int64) % TRIGRAMS, starts.astype(np.int64)


def windows_of(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of overlapping windows that cover n words; the last ends with the text."""
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


class Network:
    """Weights; `inputs` projects distinct words, `forward` scores windows of them."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        f = np.float32
        word = 0.05 * r.standard_normal((len(vocabulary) + 1, WORD_DIM))
        word[1:, 0] = odds
        word[0] = 0
        self.p = {
            "word": word.astype(f), "char": (0.05 * r.standard_normal((TRIGRAMS, CHAR_DIM))).astype(f), "w": (r.standard_normal((d, 6 * h)) / np.sqrt(d)).astype(f), "b": np.zeros(6 * h, f),
            "u": (r.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(f), "a": (0.5 * r.standard_normal(2 * h)).astype(f), "o": (0.5 * r.standard_normal(2 * h)).astype(f), "c": np.full(1, -1, f),
        }

    def embed(self, words: list[str], odds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words; odds: what stands for the first number of their embeddings."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        tri, starts = trigrams(words)
        size = np.diff(np.append(starts, len(tri)))
        chars = np.add.reduceat(self.p["char"][tri], starts, axis=0) / size[:, None]
        x = np.concatenate([self.p["word"][ids], chars], 1).astype(np.float32)
        if odds is not None:
            x[:, 0] = odds
        return x, ids, tri, size

    def inputs(self, words: list[str], odds: np.ndarray | None = None) -> np.ndarray:
        return self.embed(words, odds)[0] @ self.p["w"] + self.p["b"]

    def forward(self, table: np.ndarray, idx: np.ndarray, lengths: np.ndarray | None, keep: bool = False):
        """idx: windows of word numbers, -1 behind the end; lengths: None if all are full. Gives a logit for each."""
        n, t = idx.shape
        h, u = HIDDEN, self.p["u"]
        state = np.zeros((2, n, h), np.float32)
        states = np.zeros((t, 2, n, h), np.float32)
        trace = []
        live = None if lengths is None else (np.arange(t)[:, None] < lengths[None, :]).astype(np.float32)
        for k in range(t):
            x = np.stack([table[idx[:, k], : 3 * h], table[idx[:, t - 1 - k], 3 * h :]])
            g = state @ u
            gates = sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
            z, reset = gates[..., :h], gates[..., h:]
            new = np.tanh(x[..., 2 * h :] + reset * g[..., 2 * h :])
            after = new + z * (state - new)
            if live is not None:
                m = np.stack([live[k], live[t - 1 - k]])[..., None]
                after = m * after + (1 - m) * state
            if keep:
                trace.append((state, g, z, reset, new))
            state = after
            states[k, 0], states[t - 1 - k, 1] = after[0], after[1]
        both = states.transpose(2, 0, 1, 3).reshape(n, t, 2 * h)
        e = both @ self.p["a"]
        if live is not None:
            e = np.where(live.T > 0, e, -1e9)
        weight = np.exp(e - e.max(1, keepdims=True))
        if live is not None:
            weight = weight * live.T
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = (weight[..., None] * both).sum(1)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, both, weight, pooled, trace, live) if keep else logit

    def gradients(self, words: list[str], odds: np.ndarray, idx: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x, ids, tri, size = self.embed(words, odds)
        table = x @ self.p["w"] + self.p["b"]
        logit, both, weight, pooled, trace, live = self.forward(table, idx, lengths, True)
        n, t, h, p = *idx.shape, HIDDEN, self.p
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["c"][0] = pooled.T @ d, d.sum()
        dpool = d[:, None] * p["o"]
        dweight = (both * dpool[:, None]).sum(2)
        de = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
        g["a"] = (de[..., None] * both).sum((0, 1))
        dboth = (weight[..., None] * dpool[:, None] + de[..., None] * p["a"]).reshape(n, t, 2, h)
        dtable, dstate = np.zeros_like(table), np.zeros((2, n, h), np.float32)
        for k in range(t - 1, -1, -1):
            state, gu, z, reset, new = trace[k]
            dafter = dstate + np.stack([dboth[:, k, 0], dboth[:, t - 1 - k, 1]])
            m = np.stack([live[k], live[t - 1 - k]])[..., None]
            dnew_state = dafter * m
            dz, dnew = dnew_state * (state - new), dnew_state * (1 - z)
            da = dnew * (1 - new * new)
            dz, dr = dz * z * (1 - z), da * gu[..., 2 * h :] * reset * (1 - reset)
            dg = np.concatenate([dz, dr, da * reset], 2)
            g["u"] += state.transpose(0, 2, 1) @ dg
            dstate = dafter * (1 - m) + dnew_state * z + dg @ p["u"].transpose(0, 2, 1)
            dx = np.concatenate([dz, dr, da], 2)
            np.add.at(dtable, (idx[:, k], slice(0, 3 * h)), dx[0])
            np.add.at(dtable, (idx[:, t - 1 - k], slice(3 * h, 6 * h)), dx[1])
        g["w"], g["b"] = x.T @ dtable, dtable.sum(0)
        dx = dtable @ p["w"].T
        np.add.at(g["word"], ids, dx[:, :WORD_DIM])
        g["word"][0] = g["word"][:, 0] = 0  # the odds are counted, not trained
        np.add.at(g["char"], tri, np.repeat(dx[:, WORD_DIM:] / size[:, None], size, axis=0))
        return g


class Scorer:
    """Scores documents in batches, each distinct word of a batch projected once."""

    def __init__(self, network: Network):
        self.network = network

    def window_logits(self, docs: list[list[int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: its document, its start and its logit. docs: numbers of words in table."""
        owner, start, size = [], [], []
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(d, np.int64) for d in docs)])
        base = np.cumsum([0, *map(len, docs)])
        for k, d in enumerate(docs):
            for s in windows_of(len(d)):
                owner.append(k)
                start.append(s)
                size.append(min(WINDOW, len(d)))
        owner, start, size = np.array(owner, np.int64), np.array(start, np.int64), np.array(size, np.int64)
        logit = np.zeros(len(owner), np.float32)
        steps = np.arange(WINDOW)
        for full in (True, False):
            these = np.flatnonzero((size == WINDOW) == full)
            for at in range(0, len(these), CHUNK):
                w = these[at : at + CHUNK]
                place = (base[owner[w]] + start[w])[:, None] + steps[None, :]
                if full:
                    logit[w] = self.network.forward(table, flat[place], None)
                else:
                    t = max(1, int(size[w].max()))
                    live = steps[None, :t] < size[w][:, None]
                    idx = np.where(live, np.append(flat, 0)[np.minimum(place[:, :t], len(flat))], 0)
                    logit[w] = self.network.forward(table, idx, size[w])
        return owner, start, logit

    def number(self, texts: list[str | None]) -> tuple[list[list[int]], list[str]]:
        known: dict[str, int] = {}
        docs = []
        for t in texts:
            words = t.split() if t else []
            for w in set(words).difference(known):
                known[w] = len(known)
            docs.append([known[w] for w in words])
        return docs, [normal(w) for w in known] or [""]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of all texts, some at a time, since their distinct words are what takes memory."""
        return np.concatenate([np.zeros(0), *(self.some(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER))])

    def some(self, texts: list[str | None]) -> np.ndarray:
        docs, words = self.number(texts)
        owner, _, logit = self.window_logits(docs, self.network.inputs(words))
        worst = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(worst, owner, logit)
        return sigmoid(worst.astype(np.float64))


def train(texts: list[str], labels: np.ndarray, updates: int = UPDATES, seed: int = SEED) -> Network:
    """Adam over balanced batches.

    The first number of a known word's embedding is its log odds to stand in toxic documents. For a training document
    they are counted without that document, so that they say as much about it as about any other; the same holds for
    the final scores of the training documents, whose best threshold the last bias puts at one half.
    """
    r = np.random.default_rng(seed)
    count: dict[str, list[int]] = {}
    for t, y in zip(texts, labels.tolist(), strict=True):
        for w in {normal(w) for w in t.split()}:
            count.setdefault(w, [0, 0])[y] += 1
    often = sorted((w for w, c in count.items() if sum(c) >= 3 and w), key=lambda w: (-sum(count[w]), w))[:VOCABULARY]
    total = np.maximum(np.bincount(labels, minlength=2), 1)
    share = total[1] / total.sum()
    counts = np.array([[0, 0], *(count[w] for w in often)], np.float64)

    def odds_of(ids: np.ndarray, without: int | None) -> np.ndarray:
        # PRIOR imagined documents of the mean label keep rare words from saying much.
        c = counts[ids].copy()
        if without is not None:
            c[:, without] = np.maximum(c[:, without] - 1, 0)
        out = np.log((c[:, 1] + PRIOR * share) / (c[:, 0] + PRIOR * (1 - share)) * (1 - share) / share)
        return np.where(ids > 0, np.clip(out, -3, 3) / 3, 0).astype(np.float32)

    mixed = len(set(labels.tolist())) == 2 and bool(often)
    net = Network({w: k + 1 for k, w in enumerate(often)}, odds_of(np.arange(1, len(often) + 1), None) if mixed else np.zeros(len(often)), seed)
    if not mixed:
        net.p["o"][:] = 0
        net.p["c"][:] = 5 if len(labels) and labels.all() else -5
        return net
    scorer = Scorer(net)
    # For each document its distinct words and its text in their numbers.
    docs = [np.unique(np.array([normal(w) for w in t.split()] or [""], dtype=object), return_inverse=True) for t in texts]
    ids = [np.array([net.vocabulary.get(w, 0) for w in d[0]], np.int64) for d in docs]
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))

    def inputs_of(pick: np.ndarray, drop: float):
        base = np.cumsum([0, *(len(docs[k][0]) for k in pick)])
        words = [w for k in pick for w in docs[k][0]]
        odds = np.concatenate([odds_of(ids[k], int(labels[k])) for k in pick])
        if drop:
            gone = r.random(len(words)) < drop
            words, odds = ["" if g else w for w, g in zip(words, gone.tolist(), strict=True)], np.where(gone, 0, odds).astype(np.float32)
        return words, odds, [docs[k][1] + b for k, b in zip(pick, base, strict=False)]

    for step in range(1, updates + 1):
        pick = np.concatenate([r.choice(s, BATCH // 2) for s in sides])
        words, odds, parts = inputs_of(pick, DROPOUT)
        owner, start, logit = scorer.window_logits(parts, net.inputs(words, odds))
        order = np.lexsort((-logit, owner))
        first = order[np.r_[True, np.diff(owner[order]) > 0]]
        idx, size = np.zeros((len(first), WINDOW), np.int64), np.zeros(len(first), np.int64)
        for k, w in enumerate(first):
            some = parts[owner[w]][start[w] : start[w] + WINDOW]
            idx[k, : len(some)], size[k] = some, len(some)
        g = net.gradients(words, odds, idx, size, labels[pick[owner[first]]].astype(np.float32))
        rate = RATE * min(1.0, 2 * (1 - step / (updates + 1)))
        for k, x in net.p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] * g[k] - v[k])
            own = rate * SLOW if k in ("word", "char") else rate
            move = own * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + DECAY * x)
            if k == "word":
                move[:, 0] = 0
            x -= move.astype(np.float32)

    logits = np.zeros(len(texts))
    for at in range(0, len(texts), 200):
        pick = np.arange(at, min(at + 200, len(texts)))
        words, odds, parts = inputs_of(pick, 0)
        owner, _, logit = scorer.window_logits(parts, net.inputs(words, odds))
        worst = np.full(len(pick), -np.inf)
        np.maximum.at(worst, owner, logit)
        logits[pick] = worst
    edges = np.unique(logits)
    cuts = np.concatenate([[0.0], (edges[1:] + edges[:-1]) / 2])
    weight = np.where(labels == 1, 0.4 / total[1], 0.6 / total[0])
    good = np.array([(weight * ((logits >= c) == labels)).sum() for c in cuts])
    net.p["c"] -= np.float32(np.median(cuts[good >= good.max() - 1e-9]))
    return net


def learn(docs: DataFrame, labels: DataFrame, trained: Column, id_col: str, text_col: str, label_col: str, sample: dict[int, int] | None = None) -> Network:
    """A network from about `sample` labelled documents of each label where `trained` holds, a bound that no table size moves.

    Labels that are null or not 0 or 1 and labels without a document are left out; a repeated label counts once, a
    repeated document or one with both labels as often as it stands there. Null texts train as empty ones. Without
    both labels, or without any row, the network gives every text the one label, or 0.
    """
    sample = sample or SAMPLE_PER_LABEL
    marks = labels.filter(trained & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for y, n in counts.items():
        chosen = chosen | ((F.col("y") == y) & (place < int((1 << 30) * min(1.0, sample[y] / n))))
    few = F.broadcast(marks.filter(chosen))  # about the sum of `sample` rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id").orderBy("id", "y", "text").collect()
    return train([r["text"] or "" for r in rows], np.array([r["y"] for r in rows], np.int64))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score in 0 to 1.

    Null texts and texts without a word score as a window of nothing, below one half unless all training documents
    are toxic. Texts of any length are scored whole. Repeated rows give repeated rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            yield extended(batch, ["id"], score=pa.array(scorer.score(batch.column("text").to_pylist())))
        del scorer
        trim()

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold.

    Null and empty texts stay, unless all training documents are toxic; repeated rows share their fate; a score at the
    threshold goes. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            found = scorer.score(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array(found < threshold))
        del scorer
        trim()

    return docs.mapInArrow(run, docs.schema)
