import numpy as np
import pytest

from tessella.llm import ann
from tessella.llm.ann import CentroidGraph, balanced_centroids, nearest, unit


def brute(ids, x, k=5):
    n = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x[i] * x).sum(1) / (np.sqrt((x[i] * x[i]).sum()) * np.sqrt((x * x).sum(1)))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1, "q") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, list int, id string")


def test_centroids_are_balanced_and_the_graph_finds_them():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(4000, 16)))
    c = balanced_centroids(x, 64, rng)
    assert c.shape == (64, 16)
    graph = CentroidGraph(c)
    ids, dist = graph.search(x[:200], 16)
    want = np.argsort(-(x[:200] @ c.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, want)]) > 0.95
    far = np.sqrt(2 - 2 * x[:200] @ c.T)
    pairs = {(int(r), int(l)) for rows, lists in graph.within(x[:200], 1.3) for r, l in zip(rows, lists)}
    true = {(i, j) for i in range(200) for j in range(64) if far[i, j] <= 1.3 * far[i].min()}
    assert len(pairs & true) / len(true) > 0.95


@pytest.mark.parametrize("common", [0, 700])
def test_recall_and_exact_scores(spark, common):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(20, size=3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32).astype(np.float64)
    x[rng.permutation(3000)[:common]] = x[0]
    ids = np.arange(3000)
    got = {}
    for r in nearest(frame(spark, ids, x), "vec_id % 50 = 0", per_list=64, part=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x)
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        true = dict(want[q])
        hits += len(set(true) & {v for _, v, _ in own})
        for _, v, s in own:
            exact = (x[q] * x[v]).sum() / (np.sqrt((x[q] ** 2).sum()) * np.sqrt((x[v] ** 2).sum()))
            assert s == pytest.approx(exact, abs=1e-12)
        assert own == sorted(own, key=lambda t: (-t[2], t[1]))
    assert hits / (5 * len(want)) >= 0.95


@pytest.mark.parametrize("copies", ["all four times", "one forty times"])
def test_repeated_ids_leave_room_for_others(spark, copies):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)).astype(np.float32).astype(np.float64)
    n = np.full(400, 4) if copies == "all four times" else np.where(np.arange(400) == 1, 40, 1)
    x[1] = x[0] + 0.01
    ids = np.arange(400).repeat(n)
    got = {}
    # one list in one part: everything is compared, so results are exact
    for r in nearest(frame(spark, ids, x[ids]), "vec_id % 50 = 0", per_list=100_000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(np.arange(400), x)
    assert {q: [v for _, v in sorted(own)] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, score double"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1.0), (50, [3.0, 4.0], 1.0), (1, None, 1.0), (2, [0.0, 0.0], 1.0), (3, [1.0, None], 1.0), (4, [nan, 1.0], 1.0), (5, [inf, 1.0], 1.0), (6, [1.0, 2.0, 3.0], 1.0), (7, [], 1.0), (None, [1.0, 1.0], 1.0), (8, [6.0, 8.0], 1.0), (8, [6.0, 8.0], 1.0), (100, None, 1.0)]
    out = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(spark.createDataFrame(rows, schema), "vec_id % 50 = 0").collect())
    # 3/5 and 6/10 are the same number, so the smaller id comes first
    assert out == [(0, 1, 8, 0.6), (0, 2, 50, 0.6), (50, 1, 8, 1.0), (50, 2, 0, 0.6)]
    assert nearest(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0
    assert nearest(spark.createDataFrame(rows[:1], schema), "vec_id % 50 = 0").count() == 0
