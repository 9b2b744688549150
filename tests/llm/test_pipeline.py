"""Each stage on what the one before kept, against plain versions."""

from collections import Counter, defaultdict

from quiverdf.llm import mixing, toxicity
from quiverdf.llm.common import Workspace, crc_of, table

from .data import frame
from .test_shingle_sets import wanted

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    work = Workspace(spark)
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = table(spark, DATA, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}

    clean = work.keep(stages["toxicity"](spark, docs, DATA), "a")
    net = toxicity.learn(docs, table(spark, DATA, "labels"), crc_of("doc_id") % 5 != 0, "doc_id", "text", "toxic")
    bad = {k for k, s in zip(rows, toxicity.Scorer(net).score([r["text"] for r in rows.values()])) if s >= 0.5}
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got == {k: r for k, r in rows.items() if k not in bad} and clean.columns == docs.columns

    distinct = work.keep(stages["exact_dedup"](spark, clean, DATA), "b")
    top = {}
    for k, r in got.items():
        top[r["text"] or ""] = max(k, top.get(r["text"] or "", k))
    kept = {r["doc_id"]: r for r in distinct.collect()}
    assert set(kept) == set(top.values()) and distinct.columns == docs.columns

    near = work.keep(stages["near_dedup"](spark, distinct, DATA), "c")
    left = {r["doc_id"] for r in near.collect()}
    assert left == set(wanted({k: r["text"] for k, r in kept.items()}).values()) and near.columns == docs.columns

    mixed = work.keep(stages["mixing"](spark, near, DATA), "d")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies and mixed.columns == docs.columns

    pieces = stages["packing"](spark, mixed, DATA).collect()
    tokens = defaultdict(int)
    for x in pieces:
        tokens[x["doc_id"]] += x["length"]
    size = {x["doc_id"]: x["doc_tokens"] for x in pieces}
    assert tokens == {k: size[k] * n for k, n in copies.items()}
    filled = Counter()
    for x in pieces:
        filled[x["sequence_id"]] += x["length"]
    assert max(filled.values()) <= 2048


BIG = (1 << 60) + 1


def test_awkward_rows_go_through_all_stages(spark):
    """Null, repeated and large ids, repeated rows, null texts and columns with clashing names."""
    import corpus_pipeline as p

    work, stages = Workspace(spark), dict(p.STAGES)
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    few = [(None, text(1)), (None, text(1)), (5, text(2)), (5, text(2)), (5, text(3)), (BIG, text(4)), (BIG + 2, text(4)), (None, text(5)), (9, None), (10, ""), (11, text(5))]
    docs = frame(spark, data=[(i, t, "en", "s", None) + ("clash",) * 11 for i, t in few])
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    clean = work.keep(stages["toxicity"](spark, docs, DATA), "a")
    assert plain(clean) == Counter(few)
    one = work.keep(stages["exact_dedup"](spark, clean, DATA), "b")
    want = Counter({(None, text(1)): 1, (5, text(2)): 1, (5, text(3)): 1, (BIG + 2, text(4)): 1, (11, text(5)): 1, (10, ""): 1})
    assert plain(one) == want and one.columns == docs.columns
    near = work.keep(stages["near_dedup"](spark, one, DATA), "c")
    assert plain(near) == want and near.columns == docs.columns
    again = work.keep(stages["near_dedup"](spark, docs, DATA), "again")
    assert sorted(Counter(t or "" for _, t in plain(again).elements()).values()) == [1] * 6
    assert {i for i, t in plain(again) if t == text(4)} == {BIG} and {i for i, t in plain(again) if t == text(5)} == {11}
    mixed = work.keep(stages["mixing"](spark, near, DATA), "d")
    copies = Counter()
    for (i, t), n in plain(mixed).items():
        assert (i, t) in want and n <= 3
        copies[i] += n
    assert mixed.columns == docs.columns and abs(sum(copies.values()) - len(want)) <= 1
    pieces = stages["packing"](spark, mixed, DATA).collect()
    assert Counter({i: len({x["row"] for x in pieces if x["doc_id"] == i}) for i in copies}) == copies
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_run_is_its_stages(spark):
    import corpus_pipeline as p

    got = p.run(spark, DATA)
    assert got.count() > 0 and {"doc_id", "sequence_id", "length"} <= set(got.columns)
