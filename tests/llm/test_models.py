"""Scores recomputed by hand: the network's, the language profiles' and those of the pattern graph."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quiverdf.llm import language_id, pii, toxicity

from .data import frame, words


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def window_logit(net, tokens):
    """One window, word by word and number by number."""
    p, h = net.p, toxicity.HIDDEN
    inputs = []
    for t in tokens:
        w = toxicity.normal(t)
        tri, _ = toxicity.trigrams([w])
        x = np.concatenate([p["word"][net.vocabulary.get(w, 0)], p["char"][tri].mean(0)]).astype(float)
        inputs.append(x @ p["w"] + p["b"])
    states = []
    for side, order in ((0, range(len(tokens))), (1, range(len(tokens) - 1, -1, -1))):
        s, out, u = np.zeros(h), {}, p["u"][side]
        for k in order:
            x, g = inputs[k][3 * h * side : 3 * h * (side + 1)], s @ u
            z = np.array([sigmoid(v) for v in x[:h] + g[:h]])
            r = np.array([sigmoid(v) for v in x[h : 2 * h] + g[h : 2 * h]])
            new = np.tanh(x[2 * h :] + r * g[2 * h :])
            s = z * s + (1 - z) * new
            out[k] = s
        states.append([out[k] for k in range(len(tokens))])
    both = np.concatenate([np.array(states[0]), np.array(states[1])], 1)
    e = np.exp(both @ p["a"] - (both @ p["a"]).max())
    return float((e / e.sum()) @ both @ p["o"] + p["c"][0])


def test_a_document_scores_as_its_worst_window():
    r = random.Random(4)
    texts = [words(r, n) + " " + r.choice(["bad", "good"]) for n in (3, 20, 64, 65, 200) for _ in range(8)]
    labels = np.array([int(t.endswith("bad")) for t in texts])
    net = toxicity.train(texts, labels, updates=20)
    some = texts[::5]
    for t, got in zip(some, toxicity.Scorer(net).score(some)):
        tokens = t.split()
        starts = toxicity.windows_of(len(tokens))
        want = max(window_logit(net, tokens[s : s + toxicity.WINDOW]) for s in starts)
        assert got == pytest.approx(sigmoid(want), abs=1e-4)


def plain_ranks(texts, most=language_id.PROFILE):
    """N-grams of letters by frequency, ties by their code points, as numbers of 21 bits a letter."""
    count = Counter()
    for t in texts:
        run = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in run:
            count.update(w)
            edged = f"_{w}_"
            count.update(edged[k : k + 2] for k in range(len(edged) - 1))
            count.update(edged[k : k + 3] for k in range(len(edged) - 2))
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g[::-1]))
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], number(x[0])))[:most]]


def test_languages_by_out_of_place_distance():
    r = random.Random(8)
    sources = {"aa": "banana bandana cabana, anaconda", "bb": "zwölf boxkämpfer jagen viktor quer", "cc": "lorem ipsum dolor sit amet vita"}
    make = lambda s, n: " ".join(r.choice(s.split()) for _ in range(n))
    texts = {k: [make(s, 40) for _ in range(6)] for k, s in sources.items()}
    profiles = language_id.Profiles(texts)
    ranks = {k: {g: n for n, g in enumerate(plain_ranks(v))} for k, v in texts.items()}
    letters = language_id.letter_table()
    for k, s in sources.items():
        for n in (1, 3, 30):
            text = make(s, n) + " xyz"
            own = plain_ranks([text])
            away = {lang: sum(abs(at - known[g]) if g in known else language_id.PROFILE for at, g in enumerate(own)) for lang, known in ranks.items()}
            best = min(sorted(away), key=away.get)
            lang, score = profiles.predict(text, letters)
            assert lang == best and score == pytest.approx(1 - away[best] / (language_id.PROFILE * len(own)))


def brute_patterns(texts):
    """Patterns over the threshold, by the rounds of the graph."""
    times, seeds, total = Counter(), defaultdict(bool), Counter()
    for t in texts:
        for pattern, instance, _, _, seed in pii.occurrences(t, pii.base_spans(t)):
            times[pattern, instance] += 1
            seeds[pattern, instance] |= seed
        w = ["^", "^", *t.translate(pii.FOLD).split()]
        for a, b in zip(w, w[1:]):
            total[f"{a} {b}"] += 1
            cut = max((b.rfind(c, 0, len(b) - 1) for c in "\"'<>=,;:(["), default=-1)
            if cut >= 0:
                total[f"{a} {b[: cut + 1]}"] += 1
    support = Counter(p for p, _ in times)
    edges = {e: n for e, n in times.items() if support[e[0]] >= pii.SUPPORT}
    seen = Counter()
    for (p, _), n in edges.items():
        seen[p] += n
    is_seed = defaultdict(bool)
    for p, i in edges:
        is_seed[i] |= seeds[p, i]
    score = {i: float(s) for i, s in is_seed.items()}
    for _ in range(pii.ROUNDS):
        hits, n = Counter(), Counter()
        for (p, i), k in edges.items():
            if score[i] >= pii.ACCEPT:
                hits[p] += k
                n[p] += 1
        sure = {p: hits[p] / max(total[p], seen[p], hits[p]) for p in hits if n[p] >= pii.SUPPORT}
        score = {i: 1.0 if is_seed[i] else 1 - math.prod(1 - min(sure.get(p, 0.0), 0.999) for p, j in edges if j == i) for i in score}
    return {p for p, c in sure.items() if c >= pii.CONFIDENCE}


def test_pattern_graph_matches_brute_force(spark):
    r = random.Random(12)
    texts = []
    for k in range(60):
        parts = [words(r, 6)]
        kind = 2 if k % 6 == 3 and k > 9 else 0 if k % 6 == 1 and k > 13 else k % 6
        parts += {
            0: [f"call me at +1 (555) 01{k % 10}-12{k:02d}"], 1: [f"call me at 5550-{1000 + k}-99"], 2: [f"mail <user{k}@x{k}.org>"], 3: [f"mail <{k}7777-{k}>"], 4: [f"tel:+49 (30) 55{k:02d}-44{k % 7}{k % 3}"], 5: [f"is at 12{k}45 and is at home"],
        }[kind]
        texts.append(" ".join([*parts, words(r, 3)]))
    texts += ["mail <no> and tel: none", "Call ME At 99-88-77-66 now", "1234567 starts", *[f"{k}234567 starts" for k in range(6)]]
    good = brute_patterns(texts)
    assert any("<" in p for p in good) and "me at" in good
    data = [(k, t, None, None, None) + (None,) * 11 for k, t in enumerate(texts)]
    got = {x["doc_id"]: x["spans"] for x in pii.find(frame(spark, data=data)).collect()}
    for k, t in enumerate(texts):
        base = pii.base_spans(t)
        more = [("id", a, b) for p, _, a, b, seed in pii.occurrences(t, base) if not seed and p in good]
        assert got[k] == pii.listed([*base, *more]), t


def test_recall_of_planted_contexts_in_real_documents(spark):
    """Identifiers of unknown shape behind a phrase that also stands before known ones, among the documents of the smallest table."""
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    data, planted = [], {}
    for k, t in enumerate(docs["text"].fillna("").tolist()):
        middle = len(t) // 2
        if k % 4 != 1:
            t = f"{t[:middle]} member number: +1 (555) 0{k:03d}-1234 {t[middle:]}"
        else:
            at = middle + len(" member number: ")
            t, planted[k] = f"{t[:middle]} member number: ZK-{k:04d}-77 {t[middle:]}", f"id:{at}:{at + 10}"
        data.append((k, t, None, None, None) + (None,) * 11)
    got = {x["doc_id"]: x["spans"] for x in pii.find(frame(spark, data=data)).collect()}
    assert np.mean([span in got[k].split(",") for k, span in planted.items()]) >= 0.9
    others = [s for k, spans in got.items() if k not in planted for s in spans.split(",") if s.startswith("id:")]
    assert len(others) <= 0.05 * len(planted)


def joined_rows(df):
    """What the joins of a plan that has run made."""
    out, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if "Join" in name:
            out.append(plan.metrics().get("numOutputRows").get().value())
        inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
        plans += [inner] if inner is not None else [plan.children().apply(k) for k in range(plan.children().size())]
    return out


def test_patterns_are_counted_before_they_are_joined(spark):
    r = random.Random(13)
    texts = [f"{words(r, 5)} call me at {words(r, 4)} call\u00a0me  AT home, tel:{k} {words(r, 3)}" for k in range(500)]
    data = [(k, t, None, None, None) + (None,) * 11 for k, t in enumerate([*texts, None, "", "^ ^", "call me\u00a0at\u2003home"])]
    patterns = spark.createDataFrame([("me at",), ("home, tel:",), ("^ ^",), ("not there",), *[(f"more {k}",) for k in range(3000)]], "pattern string")
    totals = pii.corpus_counts(frame(spark, 3, data), "text", patterns)
    assert {x["pattern"]: x["total"] for x in totals.collect()} == {"me at": 1001, "home, tel:": 500, "^ ^": 506}
    made = joined_rows(totals)
    assert made and sum(made) <= 3 * 3
