import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quiverdf.llm import imatch, language_id, mixing, packing, pii, toxicity
from quiverdf.llm.common import Workspace
from quiverdf.llm.queries import tokenizer_path

from .data import frame, rows, words


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    data = rows()
    plain = Tokenizer.from_file(tokenizer_path())
    for longest in (64, 2048):
        got = packing.pack(frame(spark), tokenizer_path(), longest=longest).collect()
        by_sequence: dict = {}
        for p in got:
            by_sequence.setdefault(p["sequence_id"], []).append(p)
        padding = total = 0
        for pieces in by_sequence.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p["offset"]):
                assert p["offset"] == at and p["length"] > 0
                at += p["length"]
            assert at <= longest
            padding, total = padding + (0 if at & (at - 1) == 0 else longest - at), total + at
        assert padding < 0.1 * total
        want = Counter()
        for r in data:
            ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
            want[r[0]] += len(ids)
            if sum(x[0] == r[0] for x in data) == 1:
                at = 0
                for p in sorted((p for p in got if p["doc_id"] == r[0]), key=lambda p: p["start"]):
                    assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                    at += p["length"]
                assert at == len(ids)
        assert {k: sum(p["length"] for p in got if p["doc_id"] == k) for k in want} == want
    assert packing.pack(frame(spark, data=[]), tokenizer_path()).count() == 0


def test_word_tokenizer_is_the_tokenizer():
    from tokenizers import Tokenizer

    plain, words_ = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), keep=50)
    r = random.Random(5)
    every = ["don't I'LL a\x1cb x́ É <|endoftext|> a<|endoftext|>b. 3.5 ﬁ 한국 Σας", " ".join(chr(c) + "a." for c in range(1, 0x2100))]
    every += ["".join(r.choice("aAéÉ.!'s \x1f\t̀ñ1-<|") for _ in range(200)) for _ in range(100)]
    for t in every:
        assert np.frombuffer(words_.encode(t)[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_cuts_cost_least():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 14))
        p = np.concatenate([[0], np.cumsum(r.integers(1, 9, n))])
        c = np.append(0, r.integers(0, 5, n))
        longest = 16

        def cost(cuts, p=p, c=c):
            return sum((longest - (p[j] - p[i])) + c[j] for i, j in zip([0, *cuts], cuts))

        best = min(
            (cost(cuts) for mask in range(1 << (n - 1)) for cuts in [[k + 1 for k in range(n - 1) if mask >> k & 1] + [n]] if all(p[j] - p[i] <= longest for i, j in zip([0, *cuts], cuts))), default=None
        )
        if best is not None:
            where = {int(x): k for k, x in enumerate(p)}
            got = [where[x] for x in packing.best_cuts(p, c, longest)]
            assert cost(got) == best


def test_cuts_at_powers_of_two_cost_least():
    """Sequences of a power of two need no padding, the shortest of them included."""
    r = np.random.default_rng(8)
    low = packing.SHORTEST_UNPADDED
    for _ in range(60):
        n = int(r.integers(2, 10))
        p = np.concatenate([[0], np.cumsum(r.choice([low // 2, low, 2 * low, 37, 511], n))])
        c = np.append(0, r.integers(0, 90, n))
        longest = 4 * low
        if np.diff(p).max() > longest:
            continue

        def cost(cuts, p=p, c=c):
            sizes = [int(p[j] - p[i]) for i, j in zip([0, *cuts], cuts)]
            price = lambda x: min(longest - x, packing.SHORT_COST) if x >= low and x & (x - 1) == 0 else longest - x
            return sum(price(x) + int(c[j]) for x, j in zip(sizes, cuts))

        every = ([k + 1 for k in range(n - 1) if mask >> k & 1] + [n] for mask in range(1 << (n - 1)))
        best = min(cost(cuts) for cuts in every if all(p[j] - p[i] <= longest for i, j in zip([0, *cuts], cuts)))
        where = {int(x): k for k, x in enumerate(p)}
        assert cost([where[x] for x in packing.best_cuts(p, c, longest)]) == best


def test_partition_ends_are_packed_together(spark):
    r = random.Random(3)
    data = [(k, words(r, r.randrange(20, 400)), None, None, None) + (None,) * 11 for k in range(400)]
    counts = {}
    for parts in (1, 60):
        got = packing.pack(frame(spark, parts, data), tokenizer_path()).collect()
        counts[parts] = len({x["sequence_id"] for x in got})
        assert len({x["row"] for x in got}) == len(data)
    assert counts[60] <= 1.05 * counts[1] + 1


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("block", [3, 1000])
def test_mix_meets_targets(spark, block):
    r = random.Random(1)
    sizes = [(k, words(r, r.randrange(0, 60)), None, r.choice(["a", "b", "b", "b", "c", None, "\U0001F600", "￿"]), None) + (None,) * 11 for k in range(600)]
    got = mixing.mix(frame(spark, data=sizes), block_rows=block).collect()
    again = mixing.mix(frame(spark, 3, data=sizes), block_rows=block).collect()
    assert sorted(got, key=lambda x: x["doc_id"]) == sorted(again, key=lambda x: x["doc_id"])
    total = Counter()
    for x in sizes:
        total[x[3]] += len(x[1].split())
    target = brute_targets(total)
    taken = Counter()
    for x in got:
        assert x["taken"] == x["copies"] * x["size"] and 0 <= x["copies"] <= 3 and x["size"] == len(sizes[x["doc_id"]][1].split())
        assert x["target"] == pytest.approx(target[x["__source"]]) and x["source_size"] == total[x["__source"]]
        taken[x["__source"]] += x["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(60, 0.05 * t)


def test_copies_are_those_of_systematic_sampling(spark):
    """Copies recomputed by hand: one offset a source, whole numbers crossed, long documents first."""
    r = random.Random(4)
    sizes = [(k, words(r, r.choice([3, 20, 20, 400])), None, r.choice("abc"), None) + (None,) * 11 for k in range(300)]
    docs = frame(spark, data=sizes)
    got = {x["doc_id"]: x for x in mixing.mix(docs).collect()}
    spots = {x[0]: x[1] for x in docs.selectExpr("doc_id", f"xxhash64(doc_id, text, {mixing.SEED})").collect()}
    draws = {x[0]: x[1] for x in spark.createDataFrame([(c,) for c in "abc"], "key string").selectExpr("key", f"pmod(xxhash64(key, false, {mixing.SEED + 1}), {1 << 20}) / {float(1 << 20)}D").collect()}
    for source in "abc":
        own = [k for k in got if got[k]["__source"] == source]
        target, total = got[own[0]]["target"], got[own[0]]["source_size"]
        left = target

        def sample(ids, rate, offset=draws[source]):
            ids = sorted(ids, key=lambda k: (got[k]["size"], spots[k]))
            return {k: math.floor((n + 1) * rate + offset) - math.floor(n * rate + offset) for n, k in enumerate(ids)}

        long = [k for k in own if got[k]["size"] * mixing.FINE > target]
        want = sample(long, target / total)
        left -= sum(n * got[k]["size"] for k, n in want.items())
        others = [k for k in own if k not in want]
        want |= sample(others, max(0.0, min(3.0, left / max(1, sum(got[k]["size"] for k in others)))))
        assert {k: got[k]["copies"] for k in own} == want


def test_mix_of_many_sources(spark):
    """More sources than partitions, null ids and repeated rows."""
    r = random.Random(6)
    sizes = [(None, "a b c d", None, "s1", None) + (None,) * 11] * 40 + [(k, words(r, r.randrange(1, 30)), None, f"h{r.randrange(80)}", None) + (None,) * 11 for k in range(400)]
    got = mixing.mix(frame(spark, data=sizes), block_rows=7).collect()
    total = Counter()
    for x in sizes:
        total[x[3]] += len(x[1].split())
    target = brute_targets(total)
    assert len(got) == len(sizes) and all(x["target"] == pytest.approx(target[x["__source"]]) for x in got)
    assert abs(sum(x["taken"] for x in got if x["doc_id"] is None) - target["s1"]) <= 8


def test_mix_of_awkward_rows(spark):
    assert mixing.mix(frame(spark)).count() == len(rows())
    assert mixing.mix(frame(spark, data=[])).count() == 0
    nothing = [(1, None, None, "a", None) + (None,) * 11, (2, "", None, None, None) + (None,) * 11]
    assert [(x["size"], x["target"], x["taken"]) for x in mixing.mix(frame(spark, data=nothing)).collect()] == [(0, 0.0, 0)] * 2


def test_fingerprints_of_edits(spark):
    data = [r for r in rows() if r[0] is not None]
    unique = list({r[0]: r for r in data}.values())
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, data=unique)).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    same = {}
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        x = got[r[0]]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, x["fingerprint"]) == x["fingerprint"]
        assert same.setdefault(edited, x["edited_fingerprint"]) == x["edited_fingerprint"]
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        if x["fingerprint"] == got[order[(k + 1) % len(order)][0]]["fingerprint"]:
            assert x["near_next"] == 1
    assert np.mean([x["near_edited"] for x in got.values()]) > np.mean([x["near_next"] for x in got.values()])
    assert imatch.fingerprints(frame(spark)).count() == len(rows())
    assert imatch.fingerprints(frame(spark, data=[])).count() == 0
    one = imatch.fingerprints(frame(spark, data=data[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_next_blocks(spark):
    blocks = sorted(random.Random(3).sample(range(-5000, 5000), 60))
    df = spark.createDataFrame([(b,) for b in blocks], "block long")
    got = {r["block"]: r["after"] for r in imatch.following(df, Workspace(spark)).collect()}
    assert got == dict(zip(blocks, [*blocks[1:], blocks[0]]))


def folded(values, seed=42):
    """The hash of several longs in a row: each hash is the next one's seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_print(text, lexicon):
    terms = {w for w in re.split(imatch.NOT_TERM, text.lower()) if w}
    own = sorted(t for t in (signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in terms) if t in lexicon)
    out = []
    for draw in range(imatch.DRAWS):
        k, d = divmod(draw, 8)
        hashes = own if k == 0 else [signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), folded([t]))) for t in own]
        for level in range(1, imatch.LEVELS + 1):
            subset = [h for h in hashes if (h >> (64 - 8 * d - level)) & ((1 << level) - 1) == 0]
            if own:
                out.append(folded(subset) & 0xFFFF | 1 if subset else 0)
            else:
                sha = hashlib.sha256(text.encode()).hexdigest().encode()
                number = draw * imatch.LEVELS + level - 1
                out.append(xxhash.xxh64_intdigest(number.to_bytes(4, "little"), xxhash.xxh64_intdigest(sha, 42)) & 0xFFFF | 1 if text else 0)
    return out


def brute_likeness(a, b):
    if not any(a) and not any(b):
        return 1.0
    shares = []
    for level in range(-1, imatch.LEVELS):
        own = [(x, y) for n, (x, y) in enumerate(zip(a, b)) if (x or y) and level in (-1, n % imatch.LEVELS)]
        if len(own) >= (1 if level < 0 else 2):
            shares.append(sum(x == y for x, y in own) / len(own))
    return max(shares)


def test_fingerprints_match_brute_force(spark, monkeypatch):
    """Lexicon, subsets, hashes and likeness anew; hot blocks cut by digests, null and repeated ids included."""
    monkeypatch.setattr(imatch, "HOT_BLOCK", 8)
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 3)
    monkeypatch.setattr(imatch, "BAND", (0.02, 0.3))
    r = random.Random(11)
    data = [(i, words(r, r.choice([0, 3, 40, 200]))) + ("x",) * 14 for i in [*range(30), *[7] * 12, *[None] * 14, 1 << 60, -(1 << 61)]]
    data = [(x[0], x[1], None, None, None) + x[5:] for x in data]
    got = imatch.fingerprints(frame(spark, data=data))
    n = len(data)
    df = Counter(w for x in data for w in {w for w in re.split(imatch.NOT_TERM, x[1].lower()) if w})
    lexicon = {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w, c in df.items() if 0.002 * n <= c < 0.05 * n}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(((x[0], x[1]) for x in data), key=lambda x: sha(x[1]), reverse=True)
    order.sort(key=lambda x: (x[0] is None, -(x[0] or 0)))
    text = lambda p: "".join(f"{x:04x}" for x in p)
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (brute_print(x, lexicon) for x in (t, edited, after))
        want[(i, len(t), sha(edited), text(a), text(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9))] += 1
    have = Counter((*list(x)[:5], round(x["near_edited"], 9), round(x["near_next"], 9)) for x in got.collect())
    assert have == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(7)
    for _ in range(3000):
        text = "".join(r.choice("aé@@..--+%0123456789  ()") for _ in range(r.randrange(80)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("9" * 50_000 + "." + "a" * 50_000 + "@" * 50_000) == []


def test_contexts_discover_identifiers(spark):
    r = random.Random(2)
    data = [(k, f"{words(r, 9)} call me at +1 (555) 01{k % 10}-12{k:02d} now", None, None, None) + (None,) * 11 for k in range(30)]
    data.append((30, "please call me at 5550-1234-99 or in room 5551234 and w1a", None, None, None) + (None,) * 11)
    data += [(31 + k, words(r, 30), None, None, None) + (None,) * 11 for k in range(10)]
    got = {x["doc_id"]: x for x in pii.find(frame(spark, data=data)).collect()}
    text = data[30][1]
    at = text.index("5550")
    assert got[30]["spans"] == f"id:{at}:{at + 12}" and got[30]["n_phone"] == 0
    for k in range(30):
        assert got[k]["n_phone"] == 1 and got[k]["base_sha256"] == hashlib.sha256(got[k]["spans"].encode()).hexdigest()
    assert all(got[k]["spans"] == "" for k in range(31, 41))


def test_pii_of_awkward_rows(spark):
    got = pii.find(frame(spark)).collect()
    assert len(got) == len(rows())
    for r, x in ((r, x) for r in rows() for x in got if r[0] is not None and x["doc_id"] == r[0]):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r[1] or ""))
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find(frame(spark, data=[])).count() == 0


def test_languages(spark):
    from pyspark.sql import functions as F

    english, french = "the house and the garden with this that have been there ", "le chat est dans la maison avec des enfants qui sont "
    r = random.Random(1)
    shuffled = lambda s: " ".join(r.sample(s.split(), len(s.split())))
    data = [(k, shuffled(english if k % 2 else french) * 3, "en" if k % 2 else "fr", None, None) + ("clash",) * 11 for k in range(60)]
    data += [(100, None, "en", None, None) + (None,) * 11, (101, "", None, None, None) + (None,) * 11, (102, "12 34 !?", "fr", None, None) + (None,) * 11, (103, "é", "fr", None, None) + (None,) * 11]
    docs = frame(spark, data=data)
    profiles = language_id.learn(docs, F.col("doc_id") % 4 != 2, "doc_id", "text", "lang")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(docs, profiles).collect()}
    assert all(got[k][0] == ("en" if k % 2 else "fr") for k in range(60))
    assert [got[k] for k in (100, 101, 102)] == [("und", 0.0)] * 3 and got[103][0] in ("en", "fr")
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = frame(spark, data=[])
    none = language_id.learn(empty, F.lit(True), "doc_id", "text", "lang")
    assert language_id.identify(empty, none).count() == 0 and none.predict("abc", language_id.letter_table()) == ("und", 0.0)


def test_grams():
    codes, counts = language_id.grams("Ab, ab", language_id.letter_table())
    code = lambda s: sum(ord(c) << 21 * k for k, c in enumerate(s[::-1]))
    assert dict(zip(codes.tolist(), counts.tolist())) == {code(s): 2 for s in ("a", "b", "_a", "ab", "b_", "_ab", "ab_")}


def toxic_rows(n=160):
    r = random.Random(9)
    out = []
    for k in range(n):
        w = words(r, r.randrange(10, 150)).split()
        for _ in range(k % 4 == 0 and 1 + k % 3):
            w.insert(r.randrange(len(w)), r.choice(["idiotling", "moronling", "scumling"]) + r.choice(["", "s", "x", "!"]))
        out.append((k, " ".join(w), None, None, None) + ("clash",) * 11)
    return out


def test_toxicity_generalises(spark):
    from pyspark.sql import functions as F

    data = toxic_rows()
    docs = frame(spark, data=[*data, (500, None) + (None,) * 14, (501, "") + (None,) * 14, (502, "\x00 ") + (None,) * 14])
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(len(data))], "doc_id long, toxic int, text string")
    net = toxicity.learn(docs, labels, F.col("doc_id") % 5 != 0, "doc_id", "text", "toxic")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, net).collect()}
    held = [k for k in range(len(data)) if k % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) >= 0.85
    assert all(0 <= s <= 1 for s in got.values()) and all(got[k] < 0.5 for k in (500, 501, 502))
    kept = toxicity.keep_clean(docs, net)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {k for k, s in got.items() if s < 0.5}
    assert toxicity.score(frame(spark, data=[]), net).count() == 0
    only = toxicity.learn(docs, labels.filter("toxic = 0"), F.lit(True), "doc_id", "text", "toxic")
    assert all(x["score"] < 0.5 for x in toxicity.score(docs, only).collect())
    assert toxicity.learn(docs, labels.limit(0), F.lit(True), "doc_id", "text", "toxic")


def test_windows_cover_texts():
    for n in range(1, 400):
        starts = toxicity.windows_of(n)
        covered = {k for s in starts for k in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network({"a": 1, "b": 2}, np.array([0.5, -0.5]), seed=1)
    words_ = ["a", "b", "zz", "yy"]
    odds = np.array([0.5, -0.5, 0, 0], np.float32)
    idx = np.zeros((3, toxicity.WINDOW), np.int64)
    idx[:, :6] = np.random.default_rng(0).integers(0, 4, (3, 6))
    size, y = np.array([6, 4, 1]), np.array([1, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = toxicity.sigmoid(net.forward(net.embed(words_, odds)[0] @ net.p["w"] + net.p["b"], idx, size).astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(words_, odds, idx, size, y)
    r = np.random.default_rng(1)
    for k in ("w", "u", "a", "o", "b"):
        for _ in range(3):
            at = tuple(int(r.integers(0, n)) for n in net.p[k].shape)
            old = net.p[k][at]
            net.p[k][at] = old + 1e-3
            up = loss()
            net.p[k][at] = old - 1e-3
            down = loss()
            net.p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4, rel=2e-2), k
