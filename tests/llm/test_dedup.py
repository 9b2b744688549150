import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from quiverdf.llm import exact_dedup, simhash_dedup, substring_dedup
from quiverdf.llm.common import Workspace

from .data import frame, rows


def test_exact_groups_match_brute_force(spark):
    data = rows()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            # Of rows that tie on id and text one stays.
            first = i == top and not want[(i, top, len(ids), True, hashlib.sha256(text.encode()).hexdigest())]
            want[(i, top, len(ids), first, hashlib.sha256(text.encode()).hexdigest())] += 1
    want = +want
    for width in (4, 64):
        got = Counter(tuple(r) for r in exact_dedup.exact_groups(frame(spark), first_bytes=width).collect())
        assert got == want
        assert sum(n for k, n in got.items() if k[3]) == len(groups)


def test_exact_groups_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATS", 4)
    data = [(7, "same") + (None,) * 14] * 11 + [(None, None) + (None,) * 14] * 4 + [(1 << 60 | 1, "same") + (None,) * 14]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(frame(spark, data=data)).collect())
    assert got == {(7, 1 << 60 | 1, 12, False): 11, (1 << 60 | 1, 1 << 60 | 1, 12, True): 1, (None, None, 4, True): 1, (None, None, 4, False): 3}


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, data=[])).count() == 0


def brute_fingerprint(text):
    tokens = [w for w in (text or "").encode().translate(simhash_dedup.LOWER).split()]
    shingles = [b" ".join(tokens[k : k + 4]) for k in range(max(1, len(tokens) - 3))] if tokens else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_groups_match_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    fps = {r[0]: brute_fingerprint(r[1]) for r in data}
    ids = sorted(fps)
    want = components([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], ids)
    got = simhash_dedup.near_groups(frame(spark, data=data)).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash_dedup.near_groups(frame(spark)).count() == len(data) + 1
    assert simhash_dedup.near_groups(frame(spark, data=[])).count() == 0


def test_links_of_full_tiles_are_exact(spark):
    r = np.random.default_rng(1)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {0}
    for k in range(400):
        x = int(centres[k % 12])
        for b in r.integers(0, 64, r.integers(0, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    want = components([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4], range(len(fps)))
    for tile in (4, 1024):  # tiny tiles cut every row of tiles
        work = Workspace(spark)
        edges = work.keep(simhash_dedup.links(nodes, 4, tile, work), "edges")
        got = {r["node"]: r["label"] for r in simhash_dedup.components(edges, work).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_close_pairs_skip_no_link():
    r = np.random.default_rng(5)
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:] = fps[r.integers(0, 100, 200)] ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64))
    fps = np.concatenate([fps, np.array([0, (1 << 64) - 1, 7], np.uint64)])
    for side in (1, 5, 64, 1000):
        a, b = simhash_dedup.close_pairs(fps, 4, side)
        want = {(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4}
        assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)


def brute_repeats(data):
    seen, out = {}, Counter()
    for r in sorted(data, key=lambda r: -1 if r[0] is None else r[0]):
        b = (r[1] or "").encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], -1 if r[0] is None else r[0])
    for r in data:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < (-1 if r[0] is None else r[0]):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[(r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeats_match_brute_force(spark):
    for parts in (1, 7):
        got = Counter(tuple(r) for r in substring_dedup.remove_repeats(frame(spark, parts)).collect())
        assert got == brute_repeats(rows())
    assert substring_dedup.remove_repeats(frame(spark, data=[])).count() == 0


def test_repeats_of_rows_with_one_id(spark):
    """Other texts of an id count too, and rows of one id are no earlier than each other."""
    a, b = "abcdefghij" * 6, "0123456789" * 7
    data = [(1, a), (1, "short"), (1, b + "x"), (2, a), (2, b), (3, a + b), (None, b + "y"), (None, b + "y"), (3, a + b), (1 << 60, "z" + a), ((1 << 60) + 1, b)]
    data = [x + (None,) * 14 for x in data]
    for parts in (1, 5):
        assert Counter(tuple(r) for r in substring_dedup.remove_repeats(frame(spark, parts, data)).collect()) == brute_repeats(data)


def test_repeats_in_small_collections(spark, monkeypatch):
    """Collections that end at every group, columns in files."""
    monkeypatch.setattr(substring_dedup, "COLLECTION", 1)
    monkeypatch.setattr(substring_dedup, "IN_MEMORY", 64)
    data = [r for r in rows() if r[1] is None or len(r[1]) < 2000]
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(frame(spark, 3, data)).collect()) == brute_repeats(data)


def test_repeats_that_overlap_in_part(spark, monkeypatch):
    r = np.random.default_rng(4)
    line = bytes(r.integers(97, 101, 600).tolist()).decode()
    data = []
    for k in range(60):
        a, n = int(r.integers(0, 500)), int(r.integers(40, 100))
        mine = bytes(r.integers(97, 101, 60).tolist()).decode()
        data.append((k, mine + line[a : a + n] + mine[::-1] + line[a : a + 55]) + (None,) * 14)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 128)
    for parts in (1, 9):
        got = Counter(tuple(x) for x in substring_dedup.remove_repeats(frame(spark, parts, data)).collect())
        assert got == brute_repeats(data)


def test_collection_order_is_that_of_sorted_suffixes():
    r = np.random.default_rng(2)
    for _ in range(40):
        least, most = (97, 99) if r.integers(2) else (254, 256)
        strings = [bytes(r.integers(least, most, r.integers(0, 12)).tolist()) for _ in range(r.integers(1, 8))]
        owner, length, common = substring_dedup.collection_order(strings)
        got = [strings[o][len(strings[o]) - n :] for o, n in zip(owner, length)]
        want = sorted((s[k:], o) for o, s in enumerate(strings) for k in range(len(s) + 1))
        assert got == [w[0] for w in want]
        for k in range(1, len(got)):
            n = 0
            while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
                n += 1
            assert common[k] == n
