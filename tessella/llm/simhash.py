"""SimHash near-duplicates: fingerprints, and exact pairs in Hamming space by a sharded vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import components

from .common import column, cut, fresh, ship

SEED = 42
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 1 << 16
#: Bytes of text that are split into words at a time.
SEGMENT = 1 << 20
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs; no word is cut."""
    at, end = 0, len(data)
    if end <= SEGMENT:
        yield data.split()
        return
    while at < end:
        to = min(at + SEGMENT, end)
        while to < end and data[to] not in WHITE:
            to += 1
        yield data[at:to].split()
        at = to


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it set; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for run in _words(data):
        tail += run
        for k in range(0, len(tail) - width + 1, BLOCK):
            part = tail[k : k + BLOCK + width - 1]
            shingles = list(map(b" ".join, zip(*(part[i:] for i in range(width)))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(shingles)
        if len(tail) >= width:
            tail = tail[-(width - 1) :] if width > 1 else []
    if not n and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    bits = ones * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def neighbourhood(reach: int) -> np.ndarray:
    """Masks of all changes of at most ``ceil(reach / 2)`` bits; those of at most ``floor(reach / 2)`` come first.

    Two fingerprints are within ``reach`` exactly if changes of those two sizes lead them to a
    common code. So the points of a code, among which one has it within the smaller size, are
    linked; as no two points are equal, a code has at most as many points as there are masks.
    """
    masks = [0]
    ring = {0}
    for _ in range(-(-reach // 2)):
        ring = {m | 1 << b for m in ring for b in range(64) if not m >> b & 1}
        masks += sorted(ring)
    return np.array(masks, np.uint64)


def _inner(reach: int) -> int:
    """Masks of at most ``floor(reach / 2)`` bits."""
    return len(neighbourhood(reach - 1)) if reach % 2 else len(neighbourhood(reach))


def _mixed(codes: np.ndarray) -> np.ndarray:
    return ((codes ^ (codes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


#: Shards that a group which can't be divided may be as large as before it is dealt by neighbourhoods.
DENSE = 8


class VantageTree:
    """The upper part of a vantage-point tree, fitted to a sample, that deals fingerprints to shards.

    An inner node holds a vantage point and a radius: a fingerprint goes inside when its
    distance is at most the radius, else outside. Two fingerprints within ``reach`` whose sides
    differ have distances within ``reach`` of each other (triangle inequality), so it is enough
    to send the inside one of such a boundary pair along as a guest of the outside as well.

    A group so dense that all of it lies near every boundary can't be divided by distances. Its
    leaf has several parts, and its rows are dealt to those by their :func:`neighbourhood`, in
    which a row stands a fixed number of times, however large the group is.
    """

    def __init__(self, sample: np.ndarray, population: int, shard: int, reach: int, depth: int = 20):
        self.reach, self.nodes, self.masks = reach, [], neighbourhood(reach)
        self.shards, self.parts = 0, []
        self._grow(sample, sample[:0], population / max(1, len(sample)), shard, depth)

    def _grow(self, x: np.ndarray, visit: np.ndarray, scale: float, shard: int, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        best, size = None, len(x) + len(visit)
        large = size * scale > shard and len(x) >= 16
        if depth and large:
            for v in x[:: max(1, len(x) // 12)][:12]:
                d, e = distance(x, v).astype(np.int64), distance(visit, v).astype(np.int64)
                r = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
                for radius in (r - 1, r):
                    inside = d <= radius
                    near = inside & (d > radius - self.reach)
                    a = int(inside.sum())
                    left, right = a + int((e <= radius + self.reach).sum()), len(x) - a + int(near.sum()) + int((e > radius - self.reach).sum())
                    cost = max(left, right) + 0.5 * (left + right - size)
                    if 0 < a < len(x) and cost < 0.95 * size and (best is None or cost < best[0]):
                        best = (cost, v, radius, inside, near, e)
        if best is None:
            self.nodes[me] = (self.shards,)
            self.shards += 1
            # what is several times a shard still is one task's work, whose memory is bounded; a part has as many rows
            many = large and size * scale > DENSE * shard
            self.parts.append(-(-int(size * scale) * len(self.masks) // (DENSE * shard)) if many else 0)
        else:
            _, v, radius, inside, near, e = best
            left = self._grow(x[inside], visit[e <= radius + self.reach], scale, shard, depth - 1)
            right = self._grow(x[~inside], np.concatenate([x[near], visit[e > radius - self.reach]]), scale, shard, depth - 1)
            self.nodes[me] = (v, radius, left, right)
        return me

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shard and whether it is a guest there, for every place a fingerprint goes to."""
        out, todo = [], [(0, np.arange(len(fps)), np.zeros(len(fps), bool))]
        while todo:
            at, rows, guest = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out.append((rows, np.full(len(rows), node[0], np.int32), guest))
                continue
            v, radius, left, right = node
            d = distance(fps[rows], v).astype(np.int64)
            inside, near = d <= radius, d > radius - self.reach
            # a guest looks for partners on either side that the bounds allow
            go_in = inside | (guest & (d <= radius + self.reach))
            go_out = ~inside | near
            todo.append((left, rows[go_in], guest[go_in]))
            todo.append((right, rows[go_out], guest[go_out] | inside[go_out]))
        return tuple(np.concatenate(x) for x in zip(*out))


class _Forest:
    """Union-find over arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _flat(self) -> None:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return
            self.up = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.up[i], self.up[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            self._flat()


#: Pairs, or rows of neighbourhoods, that are held at a time.
_AT_ONCE = 1 << 20


def shard_links(fps: np.ndarray, ids: np.ndarray, guest: np.ndarray, reach: int, small: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that a shard holds, as (id, smallest id) stars.

    The tree goes on inside the shard: a group of more than ``small`` residents is split at the
    median distance to one of them, with the same guests across the boundary, until it is small
    or too dense to be split. What is left is compared in blocks, and there too only where
    distances to one more vantage point differ by at most ``reach``; a dense group of many is
    linked through its neighbourhoods.
    """
    order = np.argsort(ids, kind="stable")
    fps, ids, guest = fps[order], ids[order], guest[order]
    forest, masks, inner = _Forest(len(ids)), neighbourhood(reach), _inner(reach)
    todo = [(np.flatnonzero(~guest), np.flatnonzero(guest))]
    while todo:
        home, visit = todo.pop()
        if len(home) + len(visit) < 2 or not len(home):
            continue
        d, e = (distance(fps[x], fps[home[len(home) // 2]]).astype(np.int64) for x in (home, visit))
        r = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        inside, near = d <= r, d > r - reach
        if len(home) > small and 0 < inside.sum() < 0.9 * len(home) and (inside & near).sum() < 0.5 * len(home):
            todo.append((home[inside], visit[e <= r + reach]))
            todo.append((home[~inside], np.concatenate([home[inside & near], visit[e > r - reach]])))
        elif len(home) + len(visit) > 40 * len(masks):
            _meet(forest, fps, np.concatenate([home, visit]), masks, inner)
        else:
            _compare(forest, fps, home, d, visit, e, reach)
    moved = np.flatnonzero(forest.up != np.arange(len(ids)))
    return ids[moved], ids[forest.up[moved]]


def _compare(forest: _Forest, fps: np.ndarray, home: np.ndarray, d: np.ndarray, visit: np.ndarray, e: np.ndarray, reach: int) -> None:
    order = np.argsort(d, kind="stable")
    home, d = home[order], d[order]
    order = np.argsort(e, kind="stable")
    visit, e = visit[order], e[order]
    own = fps[home]
    block = max(1, _AT_ONCE // len(home))
    for start in range(0, len(home), block):
        stop = min(start + block, len(home))
        to = int(np.searchsorted(d, d[stop - 1] + reach, side="right"))
        i, j = np.nonzero(distance(own[start:stop, None], own[None, start:to]) <= reach)
        later = j > i
        forest.link(home[start + i[later]], home[start + j[later]])
    for start in range(0, len(visit), block):
        stop = min(start + block, len(visit))
        lo, to = int(np.searchsorted(d, e[start] - reach, side="left")), int(np.searchsorted(d, e[stop - 1] + reach, side="right"))
        i, j = np.nonzero(distance(fps[visit[start:stop], None], own[None, lo:to]) <= reach)
        forest.link(visit[start + i], home[lo + j])


def _meet(forest: _Forest, fps: np.ndarray, rows: np.ndarray, masks: np.ndarray, inner: int) -> None:
    """Links rows that meet in a code of their neighbourhoods, so many codes at a time that memory stays bounded."""
    own = fps[rows]
    parts = -(-len(rows) * len(masks) // _AT_ONCE)
    for part in range(parts):
        codes, at, within = [], [], []
        for k, m in enumerate(masks):
            code = own ^ m
            here = np.flatnonzero(_mixed(code) % np.uint64(parts) == part) if parts > 1 else np.arange(len(rows))
            codes.append(code[here])
            at.append(rows[here])
            within.append(np.full(len(here), k < inner))
        _link_codes(forest, np.concatenate(codes), np.concatenate(at), np.concatenate(within))


def _link_codes(forest: _Forest, codes: np.ndarray, at: np.ndarray, within: np.ndarray) -> None:
    """Links the rows ``at`` of each code that a row has within the smaller change."""
    order = np.lexsort((~within, codes))
    codes, at, within = codes[order], at[order], within[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    n = np.diff(np.append(first, len(codes)))
    head = np.repeat(first, n)
    links = within[head] & (at != at[head])
    forest.link(at[head[links]], at[links])


def hamming_links(points: DataFrame, reach: int = 2, shard: int = 16_384, most: int = 1 << 21) -> DataFrame:
    """Edges (a, b) that join exactly the ``points`` (fp, rep; fp unique) whose distances chain within ``reach``.

    The tree is fitted to a sample of the fingerprints (those with the smallest hashes): 16 for
    each shard, 4,096 at least and ``most`` at most, and never more than half of them, in
    expectation. It decides only how rows are dealt to tasks; every point is dealt, and every
    pair within reach is compared in exactly one shard or, in a leaf too dense to be divided by
    distances, meets in a code of one of its parts. A task emits a spanning forest of its links,
    at most one edge for each of its rows.
    """
    population = points.count()
    share = min(0.5, min(most, max(4096, 16 * population // shard)) / max(1, population))
    chosen = points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share * (1 << 30))
    seen = sorted(r[0] for r in chosen.collect())
    mixed = np.random.default_rng(0).permutation(np.array(seen, np.int64))
    tree = VantageTree(mixed.view(np.uint64), population, shard, reach)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        parts, inner = np.array(tree.parts), _inner(reach)

        def emit(place, part, guest, fps, reps):
            arrays = [pa.array(place, pa.int32()), pa.array(part, pa.int32()), pa.array(guest), pa.array(fps, pa.int64()), pa.array(reps, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "part", "guest", "fp", "rep"])

        for b in batches:
            fps, reps = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, place, guest = tree.route(fps.view(np.uint64))
            plain = parts[place] == 0
            yield emit(place[plain], np.full(plain.sum(), -1), guest[plain], fps[rows[plain]], reps[rows[plain]])
            # in a dense leaf a row stands once for each of its codes, and "guest" marks the outer ones
            rows, place = rows[~plain], place[~plain]
            for k, m in enumerate(tree.masks if len(rows) else ()):
                codes = fps[rows].view(np.uint64) ^ m
                part = _mixed(codes) % parts[place].astype(np.uint64)
                yield emit(place, part.astype(np.int32), np.full(len(rows), k >= inner), codes.view(np.int64), reps[rows])

    def join(group: pa.Table) -> pa.Table:
        fps, reps = group.column("fp").to_numpy().view(np.uint64), group.column("rep").to_numpy()
        guest = group.column("guest").to_numpy(zero_copy_only=False)
        if group.column("part")[0].as_py() < 0:
            a, b = shard_links(fps, reps, guest, reach)
        else:
            ids, at = np.unique(reps, return_inverse=True)
            forest = _Forest(len(ids))
            _link_codes(forest, fps, at, ~guest)
            moved = np.flatnonzero(forest.up != np.arange(len(ids)))
            a, b = ids[moved], ids[forest.up[moved]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = points.select("fp", "rep").mapInArrow(deal, "shard int, part int, guest boolean, fp long, rep long")
    return dealt.groupBy("shard", "part").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 2, width: int = 3, shard: int = 16_384) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Fingerprints link at ``reach`` or fewer differing bits. Null and empty texts have the
    fingerprint zero and are linked like any other. Rows with a null id are not documents and
    are left out; repeated rows stay, each with the same component. An empty table gives no
    rows. Equal fingerprints collapse into one point before any search, so that groups of
    copies cost one point however large they are.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width).where("id is not null"))
    points = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(hamming_links(points, reach, shard)).select(F.col("node").alias("rep"), "component")
    named = points.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows with a null id have no group and stay. Of rows that repeat an id all stay. Null and
    empty texts are one group, with the fingerprint zero; an empty table gives no rows.
    """
    names = simhash_components(docs, id_col, text_col, **options)
    (mark,) = fresh(docs, "gone_id")
    gone = names.where(column(id_col) != F.col("component_id")).select(column(id_col).alias(mark)).distinct()
    return docs.join(gone, column(id_col) == F.col(mark), "left_anti")
