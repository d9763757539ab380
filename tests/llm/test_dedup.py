import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessella.operators.components import components
from tessella.llm.exact_dedup import exact_dedup, exact_groups
from tessella.llm.simhash import VantageTree, fingerprint, hamming_links, near_dedup, neighbourhood, shard_links, simhash_components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, digest int")


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "A", "a", "É", "é", "x" * 300_000, "B c", "b C"]
    rows = [(i, rng.choice(texts), "k", 1) for i in range(3000)]
    got = {r.doc_id: r for r in exact_groups(make(spark, rows).repartition(7)).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(AZ), []).append(i)
    assert len(got) == len(rows)
    for content, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(content.encode()).hexdigest()


@pytest.mark.parametrize("salts", [1, 64, 65, 200, 1024])
def test_any_number_of_salts_gives_the_same_groups(spark, salts):
    rows = [(i, f"t{i % 7}" if i % 3 else "hot", "k", 1) for i in range(2000)] + [(None, "Hot", "k", 1), (5, "t5", "k", 1)]
    plain = sorted(map(str, exact_groups(make(spark, rows), block=3).collect()))
    assert sorted(map(str, exact_groups(make(spark, rows), salts=salts, block=3).collect())) == plain
    with pytest.raises(ValueError):
        exact_groups(make(spark, rows), salts=5000)


def test_exact_edges(spark):
    empty = make(spark, [])
    assert exact_groups(empty).count() == 0 and exact_dedup(empty).count() == 0
    rows = [(None, "n", "a", 1), (None, "N", "b", 2), (7, "n", "c", 3), (None, "only", "d", None), (None, "only", "d", None), (5, "twice", "e", 1), (5, "twice", "e", 1)]
    out = exact_groups(make(spark, rows)).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == 3
    kept = exact_dedup(make(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "digest"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["5", "7", "None"]


def brute_components(fps, reach):
    up = {i: i for i in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= reach:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").translate(AZ).encode().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in [None, "", " \t", "One", "one two", "a b c", "a b a b a b c", "É x y z\x1cq w\x0bv", " ".join(map(str, range(5000)))]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_long_text_is_read_in_segments(monkeypatch):
    from tessella.llm import simhash

    text = " ".join(f"w{i % 97}é" for i in range(4000))
    whole = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "SEGMENT", 50)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert fingerprint(text) == whole


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(60)) for _ in range(40)]
    rows = [(None, "x", "k", 1), (10_000, None, "k", 1), (10_001, " ", "k", 1), (3, base[0], "k", 1)]
    for i in range(600):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = "zz"
        rows.append((i + 1, " ".join(words), "k", 1))
    got = simhash_components(make(spark, rows).repartition(5), shard=64)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()}
    by = {}
    for i, t, *_ in rows[4:] + rows[1:3]:
        by[i] = plain_fingerprint(t)
    assert {i: int(f, 16) for i, (f, _) in out.items() if i != 3} == {i: f for i, f in by.items() if i != 3}
    # id 3 stands twice, with two texts: both fingerprints count
    extra = plain_fingerprint(base[0])
    want = brute_components({**by, 3.0 if by[3] == extra else 3.5: extra}, 2)
    assert {i: c for i, (_, c) in out.items() if i != 3} == {i: (3 if c == 3.5 else c) for i, c in want.items() if i not in (3, 3.5)}
    assert got.count() == len(rows) - 1


def test_shards_find_every_link():
    """The tree and what goes on in its shards, against all pairs."""
    rng = np.random.default_rng(2)
    far = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1500, dtype=np.uint64)
    centre = far[:6]
    tight = centre[rng.integers(6, size=1500)]
    for _ in range(4):
        tight = tight ^ (np.uint64(1) << rng.integers(0, 14, 1500, dtype=np.uint64))
    fps = np.unique(np.concatenate([far, tight]))
    ids = rng.permutation(len(fps)) + 5
    for reach in (1, 2, 4):
        tree = VantageTree(rng.permutation(fps)[:800], len(fps), 300, reach)
        assert tree.shards > 3
        rows, shard, guest = tree.route(fps)
        edges = []
        for s in range(tree.shards):
            at = shard == s
            edges += zip(*(x.tolist() for x in shard_links(fps[rows[at]], ids[rows[at]], guest[at], reach, small=40)))
        assert sorted(zip(rows[~guest].tolist())) == [(i,) for i in range(len(fps))]
        up = {i: i for i in ids.tolist()}

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for a, b in edges:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        got = {i: root(i) for i in up}
        assert got == brute_components(dict(zip(ids.tolist(), map(int, fps))), reach)


def dense(n, bits, seed=0):
    """Fingerprints within a few bits of one centre, changed in ``bits`` places only."""
    rng = np.random.default_rng(seed)
    out = np.zeros(0, np.uint64)
    while len(out) < n:
        x = np.full(n, 0x5DEECE66D1234567, np.uint64)
        for _ in range(6):
            x ^= rng.integers(0, 2, n, dtype=np.uint64) << rng.integers(0, bits, n, dtype=np.uint64)
        out = np.unique(np.concatenate([out, x]))
    return rng.permutation(out)[:n]


def all_pairs_components(fps, ids, reach):
    """Smallest id reachable, by comparing all pairs once, in blocks."""
    order = np.argsort(ids)
    fps, ids = fps[order], ids[order].tolist()
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k in range(0, len(ids), 256):
        i, j = np.nonzero(np.bitwise_count(fps[k : k + 256, None] ^ fps[None, k:]) <= reach)
        for x, y in zip((i + k).tolist(), (j + k).tolist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    return {i: ids[root(k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_neighbourhoods_meet_exactly_within_reach(reach):
    fps = np.concatenate([dense(250, 11), dense(250, 60, 1)])
    ids = np.arange(len(fps)) + 7
    a, b = shard_links(fps, ids, np.zeros(len(fps), bool), reach, small=10)
    masks = neighbourhood(reach)
    assert len(set(masks.tolist())) == len(masks) == (65 if reach <= 2 else 2081)
    found = dict(zip(a.tolist(), b.tolist()))
    assert {i: found.get(i, i) for i in ids.tolist()} == all_pairs_components(fps, ids, reach)


@pytest.mark.parametrize("reach", [1, 2])
def test_dense_leaves_are_dealt_in_parts(spark, reach):
    fps = np.unique(np.concatenate([dense(3000, 15), np.random.default_rng(5).integers(0, 1 << 62, 1000, dtype=np.uint64)]))
    ids = np.random.default_rng(6).permutation(len(fps)) + 1
    tree = VantageTree(np.random.default_rng(7).permutation(fps)[:2000], len(fps), 20, reach)
    assert any(tree.parts) and not all(tree.parts)
    points = spark.createDataFrame(list(zip(fps.view(np.int64).tolist(), ids.tolist())), "fp long, rep long")
    found = {r.node: r.component for r in components(hamming_links(points, reach, shard=20)).collect()}
    assert {i: found.get(i, i) for i in ids.tolist()} == all_pairs_components(fps, ids, reach)


def test_fifty_thousand_within_a_few_bits(spark):
    """One dense group, many times a shard: no task gets more than a bounded share, no link is lost."""
    fps = dense(50_000, 22)
    ids = np.random.default_rng(8).permutation(len(fps)) + 1
    tree = VantageTree(np.random.default_rng(9).permutation(fps)[:4096], len(fps), 1024, 2)
    assert sum(tree.parts) * 8 * 1024 >= 0.5 * len(fps) * 65
    points = spark.createDataFrame(list(zip(fps.view(np.int64).tolist(), ids.tolist())), "fp long, rep long").repartition(8)
    want = all_pairs_components(fps, ids, 2)
    for shard in (1024, 16_384):
        found = {r.node: r.component for r in components(hamming_links(points, shard=shard)).collect()}
        assert {i: found.get(i, i) for i in ids.tolist()} == want


def test_near_dedup_edges(spark):
    assert near_dedup(make(spark, [])).count() == 0
    rows = [(None, "a", "k", 1), (1, "same text here now", "k", 1), (2, "same text here now", None, 1), (4, None, "k", 1), (5, "", "k", 1)]
    out = near_dedup(make(spark, rows))
    assert out.columns == ["doc_id", "text", "keep_id", "digest"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "None"]


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(300)], "mixed": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]}[shape]
    up = {i: i for e in edges for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}
