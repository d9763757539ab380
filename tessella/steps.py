"""Queries for single functions, steps of the plans, and files, each with a closed form as DuckDB SQL.

``tessella.queries`` imports this module at its end, which registers what is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import units
from tessella.functions.geometry import geo, register
from tessella.plans import change, clean, extend
from tessella.queries import _CELLS, _SHIFTED, _WIDE, query
from tessella.session import cut, numbered, scratch, table
from tessella.sources import rects
from tessella.sources.layers import load_clip, load_layer
from tessella.sources.sinks import EXPORTS, export, list_formats, stem


def _box(name: str = "bbox") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{name}.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))


def _pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _r(c: Column, name: str, places: int = 6) -> Column:
    return F.round(c, places).alias(name)


# functions of one geometry


@query(f"WITH {_WIDE} SELECT fid, round(sqrt(pow(x0 + 3, 2) + pow(y0 + 4, 2)), 6) AS far, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, CAST(0.5 AS DOUBLE) AS radius FROM wide")
def point_functions(spark, sf_dir):
    """Distance to a point outside, centre of mass, and radius of the widest circle within."""
    rows = rects.wide_cells(spark, sf_dir)
    mid = geo("centroid", "geom")
    return rows.select("fid", _r(geo("distance", "geom", geo("make_point", F.lit(-3.0), F.lit(-4.0))), "far"), _r(geo("x", mid), "cx"), _r(geo("y", mid), "cy"), _r(geo("inscribed_circle", "geom").radius, "radius", 2))


@query(
    f"""WITH {_WIDE} SELECT fid, x0 AS start_x, x1 AS end_x, CAST(3 AS INTEGER) AS points, CAST(floor((x1 - x0 + 1) / 0.25 + 1e-9) AS INTEGER) AS steps, x0 + 0.25 AS first_x FROM wide"""
)
def line_functions(spark, sf_dir):
    """A line along two sides of each cell, with repeated points: its ends, its points once those are gone, and points along it."""
    x0, y0, x1, y1 = _box()
    line = geo("make_line", F.array(_pt(x0, y0), _pt(x0, y0), _pt(x1, y0), _pt(x1, y0), _pt(x1, y1)))
    rows = rects.wide_cells(spark, sf_dir).select("fid", line.alias("g"))
    rows = rows.withColumn("along", geo("interpolate_points", "g", F.lit(0.25)))
    return rows.select(
        "fid", geo("x", geo("start_point", "g")).alias("start_x"), geo("x", geo("end_point", "g")).alias("end_x"),
        geo("count_of", geo("remove_repeated", "g"), F.lit("points")).alias("points"), F.size("along").alias("steps"), geo("x", F.element_at("along", 1)).alias("first_x"),
    )


@query(f"WITH {_WIDE} SELECT fid, round((x1 - x0) + 2 * (x1 - x0 + 1) * 0.25 + 16 * 0.0625 * sin(pi() / 16), 6) AS area FROM wide")
def buffer_areas(spark, sf_dir):
    """Cells widened by a quarter; their corners become quarters of a regular polygon of 32 sides."""
    return rects.wide_cells(spark, sf_dir).select("fid", _r(geo("area", geo("buffer", "geom", F.lit(0.25))), "area"))


@query(
    f"""WITH {_WIDE} SELECT fid, CAST(4 AS INTEGER) AS faces, round((x1 - x0) / 4, 6) AS least, round((x1 - x0) / 4, 6) AS most, round(2 * (x1 - x0 + 1) + 2 * sqrt(pow(x1 - x0, 2) + 1), 6) AS length FROM wide"""
)
def noded_faces(spark, sf_dir):
    """Outline and diagonals of each cell, collected and cut where they cross, and the four faces that they enclose."""
    x0, y0, x1, y1 = _box()
    lines = F.array(geo("boundary", "geom"), geo("make_line", F.array(_pt(x0, y0), _pt(x1, y1))), geo("make_line", F.array(_pt(x0, y1), _pt(x1, y0))))
    rows = rects.wide_cells(spark, sf_dir).select("fid", geo("node", F.array(geo("collect", lines))).alias("net"))
    faces = rows.select("fid", "net", F.transform(geo("polygonize", F.array("net")), lambda g: geo("area", g)).alias("a"))
    return faces.select("fid", F.size("a").alias("faces"), _r(F.array_min("a"), "least"), _r(F.array_max("a"), "most"), _r(geo("length", "net"), "length"))


@query(f"WITH {_WIDE} SELECT fid, CAST(9 AS INTEGER) AS cells, round(x1 - x0, 6) AS area FROM wide")
def voronoi_cells(spark, sf_dir):
    """Nine points, a cell's size apart: the middle one's part of the plane has that size."""
    x0, y0, x1, y1 = _box()
    sites = F.array(*(geo("make_point", (x0 + x1) / 2 + i * (x1 - x0), (y0 + y1) / 2 + j * (y1 - y0)) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    rows = rects.wide_cells(spark, sf_dir).select("fid", geo("make_point", (x0 + x1) / 2, (y0 + y1) / 2).alias("mid"), geo("voronoi", sites).alias("v"))
    held = F.filter("v", lambda g: geo("contains", g, F.col("mid")))
    return rows.select("fid", F.size("v").alias("cells"), _r(geo("area", F.element_at(held, 1)), "area"))


@query(f"WITH {_WIDE} SELECT fid, CAST(1 AS DOUBLE) AS reduced, round(x1 - x0, 6) AS flat, round(x1 - x0 - 0.0625, 6) AS holed, CAST(1 AS INTEGER) AS holes, round(x1 - x0, 6) AS filled, round(2 * (x1 - x0 + 1), 6) AS outline, CAST(1 AS DOUBLE) AS hole_outline FROM wide")
def shape_functions(spark, sf_dir):
    """Cells snapped to halves, without heights, and with a square hole that is counted, measured and filled."""
    x0, y0, x1, y1 = _box()
    hole = geo("make_envelope", F.array(x0 + 0.25, y0 + 0.25, x0 + 0.5, y0 + 0.5))
    rows = rects.wide_cells(spark, sf_dir).withColumn("h", geo("difference", "geom", hole))
    inner = geo("interior_rings", "h")
    return rows.select(
        "fid", _r(geo("area", geo("reduce_precision", "geom", F.lit(0.5))), "reduced"), _r(geo("area", geo("force_2d", "geom")), "flat"), _r(geo("area", "h"), "holed"),
        F.size(inner).alias("holes"), _r(geo("area", geo("filled", "h")), "filled"), _r(geo("length", geo("exterior_ring", "h")), "outline"), _r(geo("length", F.element_at(inner, 1)), "hole_outline"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_retailprice * 900 >= 1e6 THEN printf('%.2f km²', p_retailprice * 900 / 1e6) ELSE printf('%.0f m²', p_retailprice * 900) END AS area,
        CASE WHEN p_retailprice >= 1000 THEN printf('%.2f km', p_retailprice / 1000) ELSE printf('%.1f m', p_retailprice) END AS length, CAST(round(p_size * 111320.0, 3) AS DOUBLE) AS metres FROM part"""
)
def display_labels(spark, sf_dir):
    """Areas and lengths as they are shown, and degrees in metres."""
    price = F.col("p_retailprice").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", units.area_label(price * 900).alias("area"), units.length_label(price).alias("length"), _r(units.degrees_to_m(F.col("p_size").cast("double")), "metres", 3))


# edits of vertices

_VERTICES = f"""{_WIDE}, v AS (
    SELECT fid, i, CASE WHEN i IN (0, 1, 4) THEN x0 ELSE x1 END AS x, CASE WHEN i IN (0, 3, 4) THEN y0 ELSE y1 END AS y FROM wide, unnest(range(5)) AS u(i))"""
_SPOT = (0.9, 0.9, 1.1, 1.1)
_IN_SPOT = "x BETWEEN 0.9 AND 1.1 AND y BETWEEN 0.9 AND 1.1"


@query(f"WITH {_VERTICES} SELECT fid, count(*) AS n, round(min(x), 6) AS x FROM v WHERE {_IN_SPOT} GROUP BY fid")
def box_vertices(spark, sf_dir):
    """Vertices in a box, closing ones included."""
    found = clean.vertices_in_box(rects.wide_cells(spark, sf_dir), _SPOT)
    return found.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), _r(F.min("x"), "x"))


@query(
    f"""WITH {_VERTICES}, m AS (SELECT avg(x) AS mx, avg(y) AS my FROM v WHERE {_IN_SPOT}),
    w AS (SELECT fid, i, CASE WHEN {_IN_SPOT} THEN mx ELSE x END AS x, CASE WHEN {_IN_SPOT} THEN my ELSE y END AS y FROM v, m),
    s AS (SELECT fid, x * lead(y) OVER (PARTITION BY fid ORDER BY i) - y * lead(x) OVER (PARTITION BY fid ORDER BY i) AS part FROM w)
    SELECT fid, round(abs(sum(part)) / 2, 6) AS area FROM s GROUP BY fid"""
)
def pinched_areas(spark, sf_dir):
    """Areas of all units once the vertices in a box have met at their mean."""
    moved, _ = clean.pinch_vertices(rects.wide_cells(spark, sf_dir).select("fid", "geom"), _SPOT)
    return moved.select("fid", _r(geo("area", "geom"), "area"))


@query(f"WITH {_WIDE} SELECT fid, round(x1 - x0, 6) AS area FROM wide")
def undone_edits(spark, sf_dir):
    """Areas of all units after a pinch and a deletion that are undone again."""
    held = clean.CleanSession(rects.wide_cells(spark, sf_dir).select("fid", "geom"))
    held.pinch(*_SPOT)
    held.delete(4.9, 0.9, 5.1, 1.1)
    while held.undo():
        pass
    return held.layer.select("fid", _r(geo("area", "geom"), "area"))


@query(f"WITH {_VERTICES} SELECT DISTINCT round(x, 6) AS x, round(y, 6) AS y FROM v WHERE sqrt(pow(greatest(2.5 - x, 0, x - 3.5), 2) + pow(y - 0.99, 2)) <= 4000 / 111320.0")
def near_sliver_vertices(spark, sf_dir):
    """Vertices within four tolerances, of a kilometre each, of a line."""
    line = spark.createDataFrame([(1,)], "n long").select("n", geo("make_line", F.array(_pt(F.lit(2.5), F.lit(0.99)), _pt(F.lit(3.5), F.lit(0.99)))).alias("geom"))
    found = clean.sliver_vertices(rects.wide_cells(spark, sf_dir), line, 1000.0)
    return found.select(_r(F.col("x"), "x"), _r(F.col("y"), "y")).distinct()


# gaps, overlaps and their repair on blocks of four units round a gap

_GAP = "((s_suppkey % 3 + 1) / CAST(1024 AS DOUBLE))"


def _blocks(spark, sf_dir) -> DataFrame:
    """For each supplier a square of three by three: two plates, and between them two units that leave a gap of 1/1024 to 3/1024 in width."""
    k = F.col("s_suppkey")
    at = F.lit(4.0) * k
    gap = (k % 3 + 1) / 1024
    boxes = F.array(*(F.struct(F.lit(i).alias("i"), *(c.cast("double").alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1")))) for i, b in enumerate(((at, F.lit(0), at + 3, F.lit(1)), (at, F.lit(2), at + 3, F.lit(3)), (at, F.lit(1), at + 1, F.lit(2)), (at + 1 + gap, F.lit(1), at + 3, F.lit(2))))))
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), F.explode(boxes).alias("b"))
    return rects.rectangles(rows, F.col("k") * 4 + F.col("b.i"), F.col("k"), F.col("k"), *(F.col(f"b.{n}") for n in ("x0", "y0", "x1", "y1")))


def _block_issues(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    layer = cut(clean.frozen(_blocks(spark, sf_dir)))
    gaps = cut(clean.gap_regions(layer))
    found = clean.issues(gaps, clean.overlap_regions(layer), spark.createDataFrame([], clean.SLIVER_SCHEMA))
    return layer, cut(numbered(found, "at", *clean.issue_order()))


@query(
    f"""WITH g AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, {_GAP} AS w FROM supplier)
    SELECT 'gap-' || n AS key, 'gap' AS kind, row_number() OVER (ORDER BY w, length(n::VARCHAR), n::VARCHAR) AS at, round(w, 6) AS area_deg, round(w * 111320.0, 0) AS width_m FROM g"""
)
def gap_issues(spark, sf_dir):
    """The issue table of gaps in its order: the narrowest first, each with its width."""
    found = _block_issues(spark, sf_dir)[1]
    return found.select("key", "kind", "at", _r(F.col("area_deg"), "area_deg"), _r(F.col("max_width_m"), "width_m", 0))


@query("SELECT s_suppkey AS k, CAST(9 AS DOUBLE) AS area, CAST(4 AS BIGINT) AS units, true AS valid FROM supplier")
def gap_repair(spark, sf_dir):
    """Blocks whose gaps, all narrower than the width given, have gone to their neighbours."""
    done = clean.clean_coverage(clean.frozen(_blocks(spark, sf_dir)), 0.01)
    return done.groupBy(F.floor(F.col("fid") / 4).alias("k")).agg(_r(F.sum(geo("area", "geom")), "area"), F.count(F.lit(1)).alias("units"), F.bool_and(geo("is_valid", "geom")).alias("valid"))


@query(f"SELECT s_suppkey AS k, round(9 - CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE {_GAP} END, 6) AS area FROM supplier")
def narrow_gap_repair(spark, sf_dir):
    """The same for a width of 1.5/1024, which only a third of the gaps are below."""
    done = clean.clean_coverage(clean.frozen(_blocks(spark, sf_dir)), 1.5 / 1024)
    return done.groupBy(F.floor(F.col("fid") / 4).alias("k")).agg(_r(F.sum(geo("area", "geom")), "area"))


@query("SELECT 'gap' AS kind, count(*) AS issues, CAST(count_if(s_suppkey % 3 = 0) AS BIGINT) AS fixed, CAST(1000 AS DOUBLE) AS slider_top, CAST(10 AS DOUBLE) AS slider_step FROM supplier")
def fixed_issues(spark, sf_dir):
    """Issues of each kind, how many a narrow repair settles, and the widths to offer."""
    layer, found = _block_issues(spark, sf_dir)
    fixed = clean.fixed_keys(found, cut(clean.clean_coverage(layer, 1.5 / 1024)))
    top, step = clean.gap_slider(found)
    return clean.issue_counts(found, fixed).select("kind", "issues", "fixed", F.lit(top).alias("slider_top"), F.lit(step).alias("slider_step"))


@query(
    """SELECT CAST(1000 AS DOUBLE) AS gap_width_m, 4 * count(*) AS total, 4 * count(*) AS kept, CAST(0 AS BIGINT) AS collapsed, CAST(0 AS BIGINT) AS gaps_left, CAST(0 AS BIGINT) AS overlaps_left, count(*) AS fixed,
        4 * max(s_suppkey) + CAST(3 AS DOUBLE) AS xmax, CAST(count_if(s_suppkey % 3 > 0) AS BIGINT) AS gaps_left_narrow FROM supplier"""
)
def clean_session(spark, sf_dir):
    """A run from the start, which takes a round width of twice the widest gap, and a second repair with a narrower one."""
    held = clean.CleanSession(_blocks(spark, sf_dir))
    whole = held.run(0.0)
    again = held.reclean(1.5 / 1024 * units.DEGREE_M * units.cos_latitude(held.latitude), 0.0)
    row = (whole.gap_width_m, whole.total, whole.kept, whole.collapsed, whole.check.gaps, whole.check.overlaps, whole.fixed.count(), whole.bounds[2], again.check.gaps)
    return spark.createDataFrame([row], "gap_width_m double, total long, kept long, collapsed long, gaps_left long, overlaps_left long, fixed long, xmax double, gaps_left_narrow long")


@query(
    """WITH r AS (SELECT s_suppkey + 1 AS fid, s_suppkey % 20 AS c, s_suppkey // 20 AS y, (s_suppkey % 3) AS d, s_suppkey AS k FROM supplier)
    SELECT a.fid FROM r a LEFT JOIN r n ON n.k = a.k + 1 AND n.y = a.y LEFT JOIN r p ON p.k = a.k - 1 AND p.y = a.y WHERE (a.d > 0 AND n.k IS NOT NULL) OR (p.d > 0)"""
)
def invalid_units(spark, sf_dir):
    """Units with an edge that doesn't match their neighbours': those that overlap in rows that stand apart."""
    k = F.col("s_suppkey")
    col, row = k % 20, F.floor(k / 20) * 2
    layer = rects.rectangles(table(spark, sf_dir, "supplier"), k + 1, k, k, col, row, col + 1 + (k % 3) / 64, row + 1)
    return clean.invalid_edges(layer).select("fid")


# growing

_SQUARES = "sq AS (SELECT s_suppkey AS k, s_suppkey % 10 AS c, s_suppkey // 10 AS r FROM supplier), inner_sq AS (SELECT a.k FROM sq a WHERE c BETWEEN 1 AND 8 AND r >= 1 AND EXISTS (SELECT 1 FROM sq b WHERE b.k = a.k + 11))"


def _squares(spark, sf_dir) -> DataFrame:
    """Unit squares three apart in rows of ten, one for each supplier."""
    k = F.col("s_suppkey")
    x, y = k % 10 * 3, F.floor(k / 10) * 3
    return rects.rectangles(table(spark, sf_dir, "supplier"), k + 1, k, k, x, y, x + 1, y + 1)


def _inside(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of the squares that have eight neighbours."""
    k = F.col("fid") - 1
    known = own.select((F.col("fid") - 11).alias("fid"))
    return rows.where((k % 10).between(1, 8) & (F.floor(k / 10) >= 1)).join(known, "fid", "left_semi").select("fid", _r(geo("area", "geom"), "area", 4))


@query(f"WITH {_SQUARES} SELECT k + 1 AS fid, CAST(9 AS DOUBLE) AS area FROM inner_sq")
def territory_areas(spark, sf_dir):
    """The part of the plane that is nearest to each square among others, by a diagram of points along its border."""
    own = cut(clean.frozen(_squares(spark, sf_dir)))
    outer, _ = extend.boundary_lines(own)
    pts = extend.generators(outer, extend.junction_zone(outer), 0.25)
    return _inside(extend.territories(cut(pts), own), own)


@query(f"WITH {_SQUARES} SELECT k + 1 AS fid, CAST(9 AS DOUBLE) AS area FROM inner_sq")
def extended_areas(spark, sf_dir):
    """Squares among others, grown until they meet."""
    own = cut(clean.frozen(_squares(spark, sf_dir)))
    return _inside(extend.extend(own, 0.25).extended, own)


_EDGE = "(CAST(l.k IS NULL AS INTEGER) + CAST(r.k IS NULL AS INTEGER) + CAST(d.k IS NULL AS INTEGER) + CAST(u.k IS NULL AS INTEGER))"


@query(
    f"""WITH c AS (SELECT p_partkey AS k, p_partkey % 50 AS x, p_partkey // 50 AS y FROM part), s AS (
        SELECT c.k, {_EDGE} AS sides FROM c LEFT JOIN c l ON l.k = c.k - 1 AND l.y = c.y LEFT JOIN c r ON r.k = c.k + 1 AND r.y = c.y LEFT JOIN c d ON d.k = c.k - 50 LEFT JOIN c u ON u.k = c.k + 50)
    SELECT k + 1 AS fid, CAST(sides AS DOUBLE) AS length FROM s WHERE sides > 0 UNION ALL SELECT 0, CAST(sum(4 - sides) AS DOUBLE) FROM s"""
)
def outer_lines(spark, sf_dir):
    """The length of each cell's outer lines, and under 0 that of all shared lines, which count from both sides."""
    outer, shared = extend.boundary_lines(clean.frozen(rects.cells(spark, sf_dir)))
    both = outer.unionByName(shared.select(F.lit(0).cast("long").alias("fid"), "geom"))
    return both.groupBy("fid").agg(_r(F.sum(geo("length", "geom")), "length"))


@query("SELECT s_suppkey + 1 AS fid, CAST(round(4 - 2e-8, 6) AS DOUBLE) AS length, CAST(17 AS BIGINT) AS points FROM supplier")
def junction_points(spark, sf_dir):
    """Points at every quarter along the outline of single squares, its ends included, without the junction zone at its one end."""
    own = clean.frozen(_squares(spark, sf_dir))
    outer = cut(own.select("fid", geo("make_line", F.array(_pt(*_box()[:2]), _pt(_box()[0], _box()[3]), _pt(*_box()[2:]), _pt(_box()[2], _box()[1]), _pt(_box()[0] + 1e-7, _box()[1]))).alias("geom")))
    zone = extend.junction_zone(outer)
    pts = extend.generators(outer, zone, 0.25).groupBy("fid").agg(F.count(F.lit(1)).alias("points"))
    return outer.join(pts, "fid").select("fid", _r(geo("length", "geom"), "length"), "points")


@query("SELECT s_suppkey + 1 AS fid, CAST(1 AS DOUBLE) AS area FROM supplier WHERE s_suppkey % 20 < 10")
def nearest_mask_clip(spark, sf_dir):
    """Cells within the one of two masks that has the lowest unit's middle in it."""
    k = F.col("s_suppkey")
    cells = rects.rectangles(table(spark, sf_dir, "supplier"), k + 1, k, k, k % 20, F.floor(k / 20), k % 20 + 1, F.floor(k / 20) + 1)
    masks = spark.createDataFrame([([0.0, 0.0, 10.0, 1e6],), ([10.0, 0.0, 20.0, 1e6],)], "b array<double>").select(geo("make_envelope", "b").alias("geom"))
    out = extend.clip(cells, cells, masks)
    return out.where(geo("area", "geom") > 0).select("fid", _r(geo("area", "geom"), "area"))


@query("SELECT s_suppkey + 1 AS n, s_suppkey * CAST(1 AS DOUBLE) AS x0, s_suppkey + CAST(0.5 AS DOUBLE) AS x1 FROM supplier")
def snapped_ends(spark, sf_dir):
    """Lines whose starts lie 1e-8 beside the end of a shared line move there; their other ends, which nothing is near, stay."""
    k = F.col("s_suppkey").cast("double")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("fid"), k.alias("k"))
    register(spark)
    lines = rows.select("fid", geo("make_line", F.array(_pt(F.col("k") + 1e-8, F.lit(0)), _pt(F.col("k") + 0.25, F.lit(1)), _pt(F.col("k") + 0.5, F.lit(0)))).alias("geom"))
    shared = rows.select(geo("make_line", F.array(_pt(F.col("k"), F.lit(0)), _pt(F.col("k"), F.lit(-1)))).alias("geom"))
    out = extend.snapped(lines, shared)
    return out.select((F.floor(geo("x", geo("start_point", "geom")) + 0.5) + 1).cast("long").alias("n"), geo("x", geo("start_point", "geom")).alias("x0"), geo("x", geo("end_point", "geom")).alias("x1"))


# comparing


def _chains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """For each supplier two units of A and two of B that overlap by halves in a chain."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    i, y = F.col("i"), k * 2
    a = rects.rectangles(rows, k * 2 + i + 1, k * 2 + i, k * 2 + i, i * 2, y, i * 2 + 2, y + 1)
    b = rects.rectangles(rows, k * 2 + i + 1, k * 2 + i, k * 2 + i, i * 2 + 1, y, i * 2 + 3, y + 1)
    return a, b


@query(
    """SELECT side, 2 * s_suppkey + i + 1 AS fid, CAST(s_suppkey + 1 AS INTEGER) AS cluster_id, 'complex' AS relationship_class
    FROM supplier, (VALUES ('a'), ('b')) AS t(side), (VALUES (0), (1)) AS u(i)"""
)
def classify_complex(spark, sf_dir):
    """Two units of either side in one cluster."""
    a, b = _chains(spark, sf_dir)
    return change.classify(a, b, change.exact_pairs(a, b, change.planar_area), change.ChangeOptions(match=0.5)).units


@query(
    """SELECT 'a' AS side, 2 * s_suppkey + 1 AS fid, 'modified' AS relationship_class FROM supplier UNION ALL SELECT 'b', 2 * s_suppkey + 1, 'modified' FROM supplier
    UNION ALL SELECT 'a', 2 * s_suppkey + 2, 'modified' FROM supplier UNION ALL SELECT 'b', 2 * s_suppkey + 2, 'modified' FROM supplier"""
)
def classify_claims(spark, sf_dir):
    """The same once codes decide: each unit claims the one with its own code, and the overlap with the other is no link."""
    a, b = _chains(spark, sf_dir)
    pairs = cut(change.exact_pairs(a, b, change.planar_area))
    change.classify(a, b, pairs, change.ChangeOptions(match=0.5))
    return change.classify(a, b, pairs, change.ChangeOptions(match=0.5, by_code=True)).units.select("side", "fid", "relationship_class")


@query(
    f"""WITH {_CELLS}, {_SHIFTED}, l AS (SELECT i % 16 AS c, i // 16 AS r FROM range(256) AS t(i)),
    pa AS (SELECT fid, x0 + (c + 0.5) * (x1 - x0) / 16 AS x, y0 + (r + 0.5) * (y1 - y0) / 16 AS y, y0 FROM cells, l UNION ALL SELECT fid, (x0 + x1) / 2, (y0 + y1) / 2, y0 FROM cells),
    pb AS (SELECT fid, x0 + (c + 0.5) * (x1 - x0) / 16 AS x, y0 + (r + 0.5) * (y1 - y0) / 16 AS y, y0 FROM shifted, l UNION ALL SELECT fid, (x0 + x1) / 2, (y0 + y1) / 2, y0 FROM shifted),
    ha AS (SELECT p.fid AS a_fid, s.fid AS b_fid, count(*) AS n FROM pa p JOIN shifted s ON p.y0 = s.y0 AND p.x > s.x0 AND p.x < s.x1 GROUP BY ALL),
    hb AS (SELECT s.fid AS a_fid, p.fid AS b_fid, count(*) AS n FROM pb p JOIN cells s ON p.y0 = s.y0 AND p.x > s.x0 AND p.x < s.x1 GROUP BY ALL)
    SELECT a_fid, b_fid, round(coalesce(ha.n, 0) / 257, 6) AS coverage_a, round(coalesce(hb.n, 0) / 257, 6) AS coverage_b FROM ha FULL JOIN hb USING (a_fid, b_fid)"""
)
def sampled_coverages(spark, sf_dir):
    """The pair table from sample points, point by point what a plain count gives."""
    rows = change.sampled_pairs(rects.cells(spark, sf_dir), rects.shifted_cells(spark, sf_dir), 16, change.planar_area)
    return rows.select("a_fid", "b_fid", _r(F.col("coverage_a"), "coverage_a"), _r(F.col("coverage_b"), "coverage_b"))


@query(f"WITH {_SHIFTED}, {_CELLS} SELECT 'b' AS side, b.fid, round((b.x1 - b.x0) * (b.y1 - b.y0), 6) AS area FROM shifted b UNION ALL SELECT 'a', a.fid, round((a.x1 - a.x0) * (a.y1 - a.y0), 6) FROM cells a WHERE a.fid NOT IN (SELECT fid FROM shifted)")
def render_areas(spark, sf_dir):
    """The areas of what is drawn: all of B, and what is gone of A."""
    a, b = rects.cells(spark, sf_dir), rects.shifted_cells(spark, sf_dir)
    done = change.classify(a, b, change.exact_pairs(a, b, change.planar_area))
    return change.render_layer(done, a, b).select(F.col("piece_side").alias("side"), F.coalesce("a_fid", "b_fid").alias("fid"), _r(geo("area", "geom"), "area"))


@query(f"WITH {_CELLS} SELECT fid, code, round((x1 - x0) * (y1 - y0), 6) AS area, 'a' AS side FROM cells")
def outline_layer(spark, sf_dir):
    a, b = rects.cells(spark, sf_dir), rects.shifted_cells(spark, sf_dir)
    done = change.classify(a, b, change.exact_pairs(a, b, change.planar_area))
    return change.outlines(done, "a", a).join(a.select("fid", "code"), "fid").select("fid", "code", _r(geo("area", "geom"), "area"), "side")


@query(
    """WITH m AS (SELECT p_partkey // 2 AS pair, p_partkey + 1 AS a_fid, CAST(p_partkey AS VARCHAR) AS code FROM part)
    SELECT row_number() OVER (ORDER BY pair, code) AS at, CAST(pair + 1 AS INTEGER) AS cluster_id, a_fid, 'b' AS span_side FROM m WHERE pair IN (SELECT pair FROM m GROUP BY pair HAVING count(*) = 2)"""
)
def ordered_rows(spark, sf_dir):
    """Rows of the table in their order, with the side that spans a cluster's rows."""
    a, b = rects.cells(spark, sf_dir), rects.merged_cells(spark, sf_dir)
    done = change.classify(a, b, change.exact_pairs(a, b, change.planar_area))
    rows = change.visible_rows(change.table_rows(done, a, b), ["merge"]).where("span_side is not null")
    return numbered(rows, "at").select("at", "cluster_id", "a_fid", "span_side")


@query(
    """SELECT row_number() OVER (ORDER BY CAST(p_partkey // 2 * 2 AS VARCHAR) IS NULL, CAST(p_partkey AS VARCHAR), CAST(p_partkey // 2 * 2 AS VARCHAR)) AS at, CAST(p_partkey AS VARCHAR) AS code_a, CAST(p_partkey // 2 * 2 AS VARCHAR) AS code_b,
        CAST(1 AS DOUBLE) AS a_in_b, CAST(0.5 AS DOUBLE) AS similarity FROM part"""
)
def ordered_changelog(spark, sf_dir):
    """The change log of merged pairs, in its order."""
    a, b = rects.cells(spark, sf_dir), rects.merged_cells(spark, sf_dir)
    done = change.classify(a, b, change.exact_pairs(a, b, change.planar_area))
    return numbered(done.changelog, "at").select("at", "code_a", "code_b", "a_in_b", "similarity")


# files


def _saved(spark, sf_dir, extension: str) -> DataFrame:
    """All cells, saved as a file and loaded again."""
    cells = rects.cells(spark, sf_dir)
    path = export("cleaned", extension, scratch(spark), cells.select("fid", "geom"), cells.select("fid", "code", "name"), "cells")
    back = load_layer(spark, path).joined()
    return back.select("fid", F.col("code").cast("string").alias("code"), "name", _r(geo("area", "geom"), "area"), _r(geo("x", geo("centroid", "geom")), "x"))


_SAVED = f"WITH {_CELLS} SELECT row_number() OVER (ORDER BY fid) AS fid, code, name, CAST(1 AS DOUBLE) AS area, round((x0 + x1) / 2, 6) AS x FROM cells"


def _format_query(name: str, extension: str) -> None:
    def run(spark, sf_dir):
        return _saved(spark, sf_dir, extension)

    run.__name__, run.__doc__ = f"saved_{name}", f"All cells, saved as {extension} and loaded again."
    query(_SAVED)(run)


for _name, _extension in (("geopackage", ".gpkg"), ("shapefile", ".shp.zip"), ("geoparquet", ".parquet"), ("flatgeobuf", ".fgb"), ("kml", ".kml"), ("gml", ".gml"), ("geojson", ".geojson")):
    _format_query(_name, _extension)


@query(_SAVED)
def saved_geojsonl(spark, sf_dir):
    """All cells as lines of features, written by all tasks and read line by line."""
    from tessella.sources.sinks import feature_rows

    path = f"{scratch(spark)}/cells.geojsonl"
    # one file, so that lines keep the order of the cells
    feature_rows(rects.cells(spark, sf_dir).orderBy("fid").drop("bbox")).coalesce(1).write.text(path)
    return load_layer(spark, path).joined().select("fid", F.col("code").cast("string").alias("code"), "name", _r(geo("area", "geom"), "area"), _r(geo("x", geo("centroid", "geom")), "x"))


@query(
    f"""WITH {_CELLS}, b AS (SELECT max(x1) AS x1 FROM (SELECT s_suppkey % 20 + 1 AS x1, s_suppkey // 20 + 1 AS y1 FROM supplier)), h AS (SELECT max(s_suppkey // 20 + 1) AS y1 FROM supplier)
    SELECT count(*) AS n, round(sum((x1 - x0) * (y1 - y0)), 6) AS area FROM cells WHERE x0 <= (SELECT x1 FROM b) AND y0 <= (SELECT y1 FROM h)"""
)
def clip_layer(spark, sf_dir):
    """Shapes of a second layer that meet the first one's extent."""
    k = F.col("s_suppkey")
    own = rects.rectangles(table(spark, sf_dir, "supplier"), k + 1, k, k, k % 20, F.floor(k / 20), k % 20 + 1, F.floor(k / 20) + 1)
    cells = rects.cells(spark, sf_dir)
    base = scratch(spark)
    first = load_layer(spark, export("cleaned", ".parquet", base, own.select("fid", "geom"), own.select("fid", "code"), "own"))
    second = export("cleaned", ".parquet", base, cells.select("fid", "geom"), cells.select("fid", "code"), "mask")
    return load_clip(spark, first, second).agg(F.count(F.lit(1)).alias("n"), _r(F.sum(geo("area", "geom")), "area"))


@query("SELECT s_suppkey AS key, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def saved_csv(spark, sf_dir):
    """A table saved as CSV and read again."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    path = export("changelog", ".csv", scratch(spark), rows, name="suppliers")
    back = spark.read.csv(path, header=True, schema="key long, name string, balance double")
    return back.select("key", "name", F.round("balance", 2).alias("balance"))


@query(
    """SELECT 'cleaned' AS source, CAST(0 AS BIGINT) AS at, 'GeoPackage' AS label, '.gpkg' AS extension UNION ALL SELECT 'cleaned', 1, 'Shapefile', '.shp.zip' UNION ALL SELECT 'cleaned', 2, 'GeoParquet', '.parquet'
    UNION ALL SELECT 'cleaned', 3, 'FlatGeobuf', '.fgb' UNION ALL SELECT 'cleaned', 4, 'KML', '.kml' UNION ALL SELECT 'cleaned', 5, 'GML', '.gml' UNION ALL SELECT 'cleaned', 6, 'GeoJSON', '.geojson'
    UNION ALL SELECT 'changelog', 0, 'CSV', '.csv' UNION ALL SELECT 'changelog', 1, 'Parquet', '.parquet'"""
)
def format_list(spark, sf_dir):
    rows = [(s, at, label, ext) for s in ("cleaned", "changelog") for at, (label, ext) in enumerate(list_formats(s))]
    return spark.createDataFrame(rows, "source string, at long, label string, extension string")


@query("SELECT 'old_new_cw_overlay' AS name, 'overlay' AS source UNION ALL SELECT 'old_cleaned', 'cleaned' UNION ALL SELECT 'old_ee', 'extended' UNION ALL SELECT 'old_issues', 'issues'")
def file_names(spark, sf_dir):
    rows = [(stem("a/old.gpkg", "new.zip") + EXPORTS["overlay"].suffix, "overlay"), *((stem("old.geojson") + EXPORTS[s].suffix, s) for s in ("cleaned", "extended", "issues"))]
    return spark.createDataFrame(rows, "name string, source string")

