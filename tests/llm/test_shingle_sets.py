"""Near copies by shingle similarity, as operator and as the pipeline's stage."""

import random
from pathlib import Path

from quiverdf.llm import shingle_sets, simhash_dedup
from quiverdf.llm.common import Workspace

from .data import frame, rows, words
from .test_dedup import components


def grams(text):
    tokens = (text or "").encode().translate(shingle_sets.LOWER).split()
    n = max(len(tokens) - 4, 1)
    return {b" ".join(tokens[i : i + 5]) for i in range(n)} if tokens else set()


def near(a, b):
    return not a | b or len(a & b) / len(a | b) >= 0.8


def planted(seed=5):
    """Texts with copies of which some words differ, from 0.7 to 0.97 alike, a chain and a group of many near copies."""
    r = random.Random(seed)
    out = []
    for k in range(30):
        base = words(r, 300, 5000).split()
        out.append(" ".join(base))
        for edits in (1, 2, 4, 6, 7, 9):
            copy = list(base)
            for at in r.sample(range(300), edits):
                copy[at] = f"new{k}x{at}"
            out.append(" ".join(copy))
    step = words(r, 200, 5000).split()
    for k in range(12):
        step = step[12:] + words(r, 12, 5000).split()
        out.append(" ".join(step))
    base = words(r, 250, 5000).split()
    for k in range(60):
        copy = list(base)
        for at in r.sample(range(250), 3):
            copy[at] = f"h{k}x{at}"
        out.append(" ".join(copy))
    return out


def wanted(data):
    sets = {k: grams(t) for k, t in data.items()}
    ids = sorted(sets)
    return components([(a, b) for a in ids for b in ids if a < b and near(sets[a], sets[b])], ids)


def test_similar_groups_match_brute_force(spark):
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    texts |= {1000 + k: t for k, t in enumerate(planted())}
    data = [(k, t, None, None, None) + ("clash",) * 11 for k, t in texts.items()]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_groups(frame(spark, data=data), words=5, similarity=0.8).collect()}
    assert got == wanted(texts)
    assert simhash_dedup.near_groups(frame(spark), words=5, similarity=0.8).count() == len(rows())
    assert simhash_dedup.near_groups(frame(spark, data=[]), words=5, similarity=0.8).count() == 0


def test_near_stage_drops_planted_copies(spark):
    import corpus_pipeline

    texts = dict(enumerate(planted(6)))
    data = [(k, t, "en", "s", len(t)) + ("clash",) * 11 for k, t in texts.items()]
    left = {r["doc_id"] for r in corpus_pipeline.distinct_near(spark, frame(spark, data=data), "").collect()}
    assert left == set(wanted(texts).values())


def spied(monkeypatch, tell):
    keep = Workspace.keep

    def told(self, df, name):
        out = keep(self, df, name)
        tell(name, out, self.paths[name])
        return out

    monkeypatch.setattr(Workspace, "keep", told)


def test_copies_with_edits_of_their_own_are_not_paired(spark, monkeypatch):
    """A group of which many are too far from all others: bounds leave few pairs of it for the last round."""
    r = random.Random(11)
    base = words(r, 150, 5000).split()
    texts = {}
    for k in range(400):
        copy = list(base)
        for at in r.sample(range(150), r.choice((1, 2, 3, 3, 4, 4, 4))):
            copy[at] = f"e{k}x{at}"
        texts[k] = " ".join(copy)
    twin = texts[399].split()
    twin[75] = "twin"
    texts[400] = " ".join(twin)
    pairs = []
    spied(monkeypatch, lambda name, out, _: pairs.append(out.count()) if name == "pairs" else None)
    data = [(k, t, None, None, None) + ("clash",) * 11 for k, t in texts.items()]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_groups(frame(spark, data=data), words=5, similarity=0.8).collect()}
    want = wanted(texts)
    assert got == want and len(set(want.values())) > 50
    assert len(pairs) == 1 and pairs[0] <= 10 * len(texts)


def test_tables_are_small_beside_the_texts(spark, monkeypatch):
    r = random.Random(12)
    data = [(k, words(r, 300, 5000), None, None, None) + ("clash",) * 11 for k in range(2000)]
    kept = []
    spied(monkeypatch, lambda name, out, path: kept.append(sum(f.stat().st_size for f in Path(path.removeprefix("file://")).iterdir())))
    assert simhash_dedup.near_groups(frame(spark, data=data), words=5, similarity=0.8).count() == 2000
    assert sum(kept) < 0.6 * sum(len(x[1]) for x in data)
