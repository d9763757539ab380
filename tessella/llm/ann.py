"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids of balanced lists are fitted to a bounded sample. A vector is filed under its nearest
centroid and, near a boundary, under further ones; a query searches the lists whose centroids
are at most a ratio farther than the nearest. Both find centroids by searching a graph of them
in memory. The ratio is calibrated on the sample for the recall wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, cut, ship

#: Vectors that the index is fitted on, at most (in expectation).
SAMPLE = 50_000
#: Vectors to a list, as long as the sample has so many vectors for each list; from then on (12,500 lists of 256) lists grow and are searched in parts.
LIST, LEAST_FITTED = 256, 4
#: Vectors or queries that one task compares, at most.
PART, QUERIES = 8_192, 8_192
#: Lists that a vector near a boundary is filed under, at most, and how much farther than the nearest they may be.
REPLICAS, REPLICA_RATIO = 3, 1.05
#: Centroids that a search for the lists of a vector keeps in view.
BEAM = 16


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def balanced_centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of lists of even size: parts are halved at the median between two means until there are k."""
    out, todo = [], [(np.arange(len(x)), k)]
    while todo:
        rows, n = todo.pop()
        own = x[rows]
        if n <= 1 or len(rows) < 2:
            mean = own.mean(0)
            out.append(mean if np.linalg.norm(mean) > 1e-6 else own[0])
            continue
        a, b = own[rng.integers(len(own))], own[rng.integers(len(own))]
        left = n // 2
        for _ in range(4):
            side = own @ (a - b)
            order = np.argsort(-side, kind="stable")
            cut_at = max(1, min(len(rows) - 1, len(rows) * left // n))
            a, b = own[order[:cut_at]].mean(0), own[order[cut_at:]].mean(0)
        todo += [(rows[order[:cut_at]], left), (rows[order[cut_at:]], n - left)]
    return unit(np.array(out))


class CentroidGraph:
    """Centroids joined with their nearest ones, searched best first for many vectors at a time."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.centroids, n = centroids, len(centroids)
        degree = min(degree, max(1, n - 1))
        near = np.zeros((n, degree), np.int32)
        for k in range(0, n, 1024):
            sims = centroids[k : k + 1024] @ centroids.T
            sims[np.arange(len(sims)), np.arange(k, k + len(sims))] = -9
            near[k : k + 1024] = np.argpartition(-sims, degree - 1, axis=1)[:, :degree] if n > 1 else 0
        # one random link for each node keeps distant parts within reach
        rng = np.random.default_rng(1)
        self.links = np.concatenate([near, rng.integers(0, n, (n, 2)).astype(np.int32)], 1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int32))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` centroids for each row of x, nearest first, and their distances (inf: none)."""
        n, c = len(x), self.centroids
        width = min(width, len(c))
        seen = np.zeros((n, len(c)), bool)
        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        dist = self._far(x, ids)
        seen[:, self.entry] = True
        done = np.zeros(ids.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            open_ = ~done & np.isfinite(dist)
            busy = np.flatnonzero(open_.any(1))
            if not len(busy):
                return ids, dist
            # the nearest few that aren't expanded yet
            at = np.argsort(~open_[busy], axis=1, kind="stable")[:, : max(1, width // 16)]
            ok = open_[busy[:, None], at]
            done[busy[:, None], at] = True
            new = self.links[ids[busy[:, None], at]].reshape(len(busy), -1)
            known = seen[busy[:, None], new] | ~np.repeat(ok, self.links.shape[1], axis=1)
            # a centroid reached twice in one step counts once
            pos = np.argsort(np.where(known, len(c) + 1, new), axis=1, kind="stable")
            sorted_new = np.take_along_axis(np.where(known, len(c) + 1, new), pos, 1)
            fresh = sorted_new <= len(c)
            fresh[:, 1:] &= sorted_new[:, 1:] != sorted_new[:, :-1]
            take = fresh.sum(1).max() if len(fresh) else 0
            cols = np.argsort(~fresh, axis=1, kind="stable")[:, :take]
            add, ok = np.take_along_axis(sorted_new, cols, 1), np.take_along_axis(fresh, cols, 1)
            add = np.where(ok, add, 0).astype(np.int32)
            d = np.where(ok, self._far(x[busy], add), np.inf)
            r, k = np.nonzero(ok)
            seen[busy[r], add[r, k]] = True
            grown_ids = np.zeros((n, take), np.int32)
            grown = np.full((n, take), np.inf, np.float32)
            grown_ids[busy], grown[busy] = add, d
            ids, dist = np.concatenate([ids, grown_ids], 1), np.concatenate([dist, grown], 1)
            done = np.concatenate([done, np.zeros((n, take), bool)], 1)

    def _far(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x, self.centroids[ids])))

    def within(self, x: np.ndarray, ratio: float, most: int | None = None, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, lists): the centroids of each row that are at most ``ratio`` times as far as its nearest."""
        for k in range(0, len(x), block):
            rows, width = np.arange(k, min(k + block, len(x))), 64 if most is None else max(most, BEAM)
            while len(rows):
                ids, dist = self.search(x[rows], width)
                near = dist <= np.maximum(dist[:, :1] * ratio, 1e-6)
                near[:, most:] &= most is None
                # a beam that is all within the ratio may be too narrow
                short = near.all(1) & (ids.shape[1] < len(self.centroids)) if most is None else np.zeros(len(rows), bool)
                r, c = np.nonzero(near & ~short[:, None])
                yield rows[r], ids[r, c]
                rows, width = rows[short], width * 4


class PostingIndex:
    """What is fitted on the driver: centroids, their graph, and, calibrated together, the search ratio and the number of replicas.

    Replicas let a query open fewer lists, but each list is longer. Where vectors have no
    structure, that costs more than it saves; so both ways are calibrated for the recall, and
    the one that compares fewer vectors a query is taken. ``share`` is that number, as
    estimated on the sample, over all vectors. Without replicas it is 1 at most.
    """

    def __init__(self, sample: np.ndarray, population: int, per_list: int = LIST, recall: float = 0.98, k: int = 5, seed: int = 0, ids: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        lists = int(max(1, min(population // per_list, max(1, len(x) // LEAST_FITTED))))
        self.graph = CentroidGraph(balanced_centroids(x, lists, rng))
        self.ratio, self.replicas, self.share = 10.0, 1, 1.0
        # copies of an id are no neighbours of each other
        self._calibrate(x if ids is None else x[np.unique(ids, return_index=True)[1]], recall, k, rng)

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = list(self.graph.within(x, REPLICA_RATIO, self.replicas))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _calibrate(self, x: np.ndarray, recall: float, k: int, rng) -> None:
        """The ratio at which sample queries find ``recall`` of their k nearest in the sample, and what it costs.

        For each true neighbour the least ratio that reaches one of its lists is known; their
        quantile is the answer.
        """
        if len(x) < 3:
            return
        q = rng.choice(len(x), min(300, len(x)), replace=False)
        sims = x[q] @ x.T
        sims[np.arange(len(q)), q] = -9
        k = min(k, len(x) - 1)
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        flat, some = np.unique(top), rng.choice(len(x), min(4096, len(x)), replace=False)
        far = np.sqrt(np.maximum(0, 2 - 2 * x[q] @ self.graph.centroids.T))
        nearest = np.maximum(far.min(1), 1e-6)
        found = []
        for self.replicas in (REPLICAS, 1):
            rows, lists = self.file(x[flat])
            where: dict[int, list[int]] = {}
            for r, c in zip(flat[rows].tolist(), lists.tolist()):
                where.setdefault(r, []).append(c)
            need = [min(far[i, where[int(t)]]) / nearest[i] for i in range(len(q)) for t in top[i]]
            ratio = float(np.quantile(need, recall)) + 1e-4
            length = np.bincount(self.file(x[some])[1], minlength=far.shape[1]) / len(some)
            found.append((float(((far <= nearest[:, None] * ratio) @ length).mean()), ratio, self.replicas))
        self.share, self.ratio, self.replicas = min(found)


def _usable(vec: Column) -> Column:
    """Neither null nor empty, all components finite, not all zero."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda c: c != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column | str,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample: int = SAMPLE,
    per_list: int = LIST,
    recall: float = 0.98,
    part: int = PART,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that ``is_query`` marks.

    Score is the cosine in double precision on the original vectors; ties go to the smaller id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null id, nor vectors that aren't of the most common length: a cosine is between
    vectors of one length. A row is never its own
    neighbour; rows that repeat an id count as one candidate. Fewer candidates than k give
    fewer rows, an empty table none.

    Every vector is indexed. A list of over ``part`` vectors (a very common vector fills its
    lists) is searched in parts, and the queries of a list are dealt out likewise, so that no
    task holds an unbounded group; parts return their k best, which are merged by query.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    mark = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vec_col).cast("array<double>").alias("v"), F.coalesce(mark, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v")))
    out_schema = "query_id long, rank int, vec_id long, score double"
    sizes = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    if not sizes:
        return spark.createDataFrame([], out_schema)
    (dim, population), = sizes.items()
    rows = rows.where(F.size("v") == dim)
    chosen = rows if population <= sample else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * sample / population)
    seen = chosen.select("id", F.col("v").cast("array<float>").alias("v")).toArrow().sort_by("id")
    fitted = np.asarray(seen.column("v").combine_chunks().flatten()).reshape(-1, dim).astype(np.float64)
    index = PostingIndex(fitted, population, per_list, recall, k, ids=seen.column("id").to_numpy())
    # bounded: a fourth of the sample's vectors as centroids, and their links, at most
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                x = unit(np.asarray(own.column(1).flatten()).reshape(-1, dim))
                r, lists = index.file(x)
                yield from _emit(own, r, lists, False)
                asks = np.flatnonzero(own.column(2).to_numpy(zero_copy_only=False))
                for r, lists in index.graph.within(x[asks], index.ratio):
                    yield from _emit(own, asks[r], lists, True)

    def _emit(b: pa.RecordBatch, r: np.ndarray, lists: np.ndarray, asks: bool) -> Iterator[pa.RecordBatch]:
        if len(r):
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array([asks] * len(r)), b.column(0).take(take), b.column(1).take(take)], ["list", "asks", "id", "v"])

    dealt = cut(rows.mapInArrow(deal, "list int, asks boolean, id long, v array<double>"))
    # one row for each list, whose number the sample bounds
    counts = dealt.groupBy("list").agg(F.count_if(~F.col("asks")).alias("n"), F.count_if("asks").alias("m")).where("n > 0 and m > 0")
    plan = F.broadcast(counts.select("list", F.ceil(F.col("n") / part).cast("int").alias("parts"), F.ceil(F.col("m") / QUERIES).cast("int").alias("turns")))
    both = dealt.join(plan, "list")

    def own_part(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    posted = both.where("not asks").select(F.col("list").alias("p_list"), own_part("parts").alias("p_part"), every("turns").alias("p_turn"), F.col("id").alias("p_id"), F.col("v").alias("p_v"))
    asked = both.where("asks").select(F.col("list").alias("q_list"), every("parts").alias("q_part"), own_part("turns").alias("q_turn"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))

    def score(asks: pa.Table, posts: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asks.num_rows and posts.num_rows:
            qi, pi = asks.column("q_id").to_numpy(), posts.column("p_id").to_numpy()
            q, p = (np.asarray(c.combine_chunks().flatten()).reshape(-1, dim) for c in (asks.column("q_v"), posts.column("p_v")))
            order = np.argsort(pi, kind="stable")
            pi, p = pi[order], p[order]
            starts = np.flatnonzero(np.append(True, pi[1:] != pi[:-1]))
            q_len, p_len = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))
            for at in range(0, len(qi), 256):
                rough = (q[at : at + 256] @ p.T) / q_len[at : at + 256, None] / p_len
                rough[qi[at : at + 256, None] == pi] = -np.inf
                # the best row of each id counts, so that as many ids as wanted lie above the floor
                each = np.maximum.reduceat(rough, starts, axis=1) if len(starts) < len(pi) else rough
                want = min(k + 8, len(starts))
                floor = np.partition(each, len(starts) - want, axis=1)[:, len(starts) - want] - 1e-9
                for i in range(len(rough)):
                    near = np.flatnonzero((rough[i] >= floor[i]) & np.isfinite(rough[i]))
                    exact = (q[at + i] * p[near]).sum(1) / (q_len[at + i] * p_len[near])
                    best = np.lexsort((pi[near], -exact))
                    _, first = np.unique(pi[near][best], return_index=True)
                    best = best[np.sort(first)[:k]]
                    out[0] += [qi[at + i]] * len(best)
                    out[1] += pi[near][best].tolist()
                    out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    asked, posted = asked.groupBy("q_list", "q_part", "q_turn"), posted.groupBy("p_list", "p_part", "p_turn")
    found = asked.cogroup(posted).applyInArrow(score, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
