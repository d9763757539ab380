"""Joins on boxes and geometry predicates, as equi-joins on grid cells."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import bbox_overlap, geo
from tessella.session import column

#: How much wider the cells of each level are than those of the one below, and the most levels above the lowest.
_STEP, _MOST = 8, 6
_AXES, _KEYS, _WIDTHS = "xy", ["_level", "_cx", "_cy"], ["_wx", "_wy"]


def with_bbox(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df if "bbox" in df.columns else df.withColumn("bbox", geo("bbox", F.col(geom)))


def _extent(axis: str) -> Column:
    return F.col(f"bbox.{axis}max") - F.col(f"bbox.{axis}min")


def _sizes(df: DataFrame) -> list[tuple[float | None, float | None]]:
    """For each axis the geometric mean of the extents that aren't 0, which a few long boxes hardly move, and the largest extent."""
    own = df.where("bbox is not null")
    found = own.agg(*[f for a in _AXES for f in (F.exp(F.avg(F.when(_extent(a) > 0, F.log(_extent(a))))), F.max(_extent(a)))]).first()
    return [tuple(found[2 * i : 2 * i + 2]) for i in range(len(_AXES))]


def _own_level(axis: str, cell: float, top: int, reach: float) -> Column:
    """The level whose cells are at least as wide as a box; there a box meets two cells at most, however large it is."""
    size = _extent(axis) + 2 * reach
    level = F.when(size <= cell, 0).otherwise(F.ceil(F.log(size / cell) / math.log(_STEP) - 1e-9)).cast("int")
    return F.least(level, F.lit(top))


def _cells(df: DataFrame, name: str, cells: list[float], own: list[Column], others: list[tuple[int, ...]], reach: float) -> DataFrame:
    """A row for each pair of levels that the other side has, and each cell there that a box meets, columns named ``name_*``."""
    base = _MOST + 1
    dealt = df.withColumn("_own", F.array(*own)).withColumn("_other", F.explode(F.array(*[F.array(*map(F.lit, o)) for o in others])))
    for i, a in enumerate(_AXES):
        width = F.lit(cells[i]) * F.pow(F.lit(float(_STEP)), F.greatest(F.col("_own")[i], F.col("_other")[i]))
        dealt = dealt.withColumn(f"_w{a}", width)
        dealt = dealt.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((F.col(f"bbox.{a}min") - reach) / F.col(f"_w{a}")), F.floor((F.col(f"bbox.{a}max") + reach) / F.col(f"_w{a}")))))
    first, second = ("_own", "_other") if name == "a" else ("_other", "_own")
    levels = functools.reduce(lambda x, y: x * base + y, [F.col(c)[i] for c in (first, second) for i in range(len(_AXES))])
    return dealt.withColumn("_level", levels).select(*[column(c).alias(f"{name}_{c}") for c in df.columns], *[F.col(c).alias(f"_{name}{c}") for c in _KEYS + _WIDTHS])


def _dealt(left: DataFrame, right: DataFrame, cell: float | list[float], top: int | list[int], reach: float) -> list[tuple[DataFrame, DataFrame]]:
    """Sides to be joined by level and cell, such that every pair meets on the coarser of its own levels along each axis and nowhere else.

    A box is dealt once for each pair of levels that boxes of the other side have, and the key
    holds the levels of both. So two small boxes never meet in coarse cells, however many large
    boxes there are, and long boxes only meet along their length. ``cell`` and ``top`` hold for
    both axes, or are one value for each.
    """
    cells, tops = (x if isinstance(x, list) else [x] * len(_AXES) for x in (cell, top))
    sides = [(df.where("bbox is not null"), r, [_own_level(a, c, t, r) for a, c, t in zip(_AXES, cells, tops)]) for df, r in ((left, reach), (right, 0.0))]
    # a few levels at most, whatever the layers hold
    present = [sorted({tuple(r) for r in df.select(*own).distinct().collect() if None not in tuple(r)}) or [(0, 0)] for df, _, own in sides] if any(tops) else [[(0, 0)]] * 2
    return [tuple(_cells(df, n, cells, own, others, r) for (df, r, own), n, others in zip(sides, "ab", present[::-1]))]


def bbox_pairs(left: DataFrame, right: DataFrame, cell: float | None = None, reach: float = 0.0, ordered: bool = False, predicate: str | None = None) -> DataFrame:
    """All pairs of rows whose boxes meet (or, with ``reach``, come that near), each once.

    Columns come back as ``a_*`` and ``b_*``; both sides need a ``bbox``. Rows with a null box
    have no partners. With ``ordered`` only pairs with a_fid < b_fid are kept, which is decided
    before any geometry is looked at.

    Along each axis the cell size is twice the geometric mean of the extents, averaged over both
    sides, unless given. Boxes of any size meet at most four cells on the levels that suit them,
    one for each axis; a pair is found on the coarser levels of the two (:func:`_dealt`), and
    kept only in the cell that has the lower left corner of the common part.
    """
    sizes = [_sizes(df) for df in (left, right)]
    tops = [max([s[i][1] for s in sizes if s[i][1]], default=0.0) + 2 * reach for i in range(len(_AXES))]
    if cell is None or cell <= 0:
        means = [[s[i][0] for s in sizes if s[i][0]] for i in range(len(_AXES))]
        cells = [2 * sum(m) / len(m) if m else 0.0 for m in means]
        # an axis without extents takes the other one's cells; very small boxes share a level
        cells = [max(c or max(cells) or 1.0, t / _STEP**_MOST) for c, t in zip(cells, tops)]
    else:
        cells = [max(cell, t / _STEP**_MOST) for t in tops]
    cells = [max(c, 2.001 * reach, 1e-12) for c in cells]
    levels = [min(_MOST, max(0, math.ceil(math.log(t / c) / math.log(_STEP) - 1e-9))) if t > c else 0 for t, c in zip(tops, cells)]

    on = functools.reduce(lambda x, y: x & y, [F.col(f"_a{k}") == F.col(f"_b{k}") for k in _KEYS])
    if ordered:
        on = on & (F.col("a_fid") < F.col("b_fid"))
    p, q = F.col("a_bbox"), F.col("b_bbox")
    meet = (p.xmin - reach <= q.xmax) & (p.xmax + reach >= q.xmin) & (p.ymin - reach <= q.ymax) & (p.ymax + reach >= q.ymin)
    once = (F.floor(F.greatest(p.xmin - reach, q.xmin) / F.col("_a_wx")) == F.col("_a_cx")) & (F.floor(F.greatest(p.ymin - reach, q.ymin) / F.col("_a_wy")) == F.col("_a_cy"))
    on = on & meet & once
    if predicate:  # last, so that cheap tests come before it
        on = on & geo(predicate, "a_geom", "b_geom")
    parts = [a.join(b, on).drop(*[f"_{n}{c}" for n in "ab" for c in _KEYS + _WIDTHS]) for a, b in _dealt(left, right, cells, levels, reach)]
    return functools.reduce(DataFrame.union, parts)


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner", key: str = "fid", **options) -> DataFrame:
    """Pairs for which ``predicate(a_geom, b_geom)`` holds, or the left rows that have (``semi``) or lack (``anti``) a partner.

    Predicates are ``intersects``, ``within`` and ``contains``. ``semi`` and ``anti`` tell left
    rows apart by ``key``, and return them as they are; a left row without geometry has no partner.
    """
    pairs = bbox_pairs(with_bbox(left), with_bbox(right), predicate=predicate, **options)
    if how == "inner":
        return pairs
    found = pairs.select(F.col(f"a_{key}").alias(key)).distinct()
    return left.join(found, key, f"left_{how}")


__all__ = ["bbox_overlap", "bbox_pairs", "spatial_join", "with_bbox"]
