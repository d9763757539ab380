"""One query for each operator, on rectangle coverages made from the tables, and DuckDB SQL for those with a closed form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import units
from tessella.functions.geometry import equal_earth_area, geo
from tessella.operators.components import components
from tessella.operators.spatial_join import bbox_pairs, spatial_join
from tessella.plans import change, clean, extend
from tessella.sources import rects
from tessella.sources.columns import detect_columns
from tessella.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CELLS = """cells AS (
    SELECT p_partkey + 1 AS fid, CAST(p_partkey AS VARCHAR) AS code, 'unit-' || p_partkey AS name,
        CAST(p_partkey % 50 AS DOUBLE) AS x0, CAST(p_partkey // 50 AS DOUBLE) AS y0, CAST(p_partkey % 50 + 1 AS DOUBLE) AS x1, CAST(p_partkey // 50 + 1 AS DOUBLE) AS y1
    FROM part)"""
_SHIFTED = """shifted AS (
    SELECT p_partkey + 1 AS fid, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 11 = 0 THEN 'new-' ELSE 'unit-' END || p_partkey AS name,
        p_partkey % 50 + (p_size % 4) / CAST(64 AS DOUBLE) AS x0, CAST(p_partkey // 50 AS DOUBLE) AS y0, p_partkey % 50 + 1 + (p_size % 4) / CAST(64 AS DOUBLE) AS x1, CAST(p_partkey // 50 + 1 AS DOUBLE) AS y1
    FROM part WHERE p_partkey % 7 <> 0
    UNION ALL
    SELECT p_partkey + 10000000, 'n' || p_partkey, 'added-' || p_partkey, CAST(p_partkey % 50 AS DOUBLE), CAST(-(p_partkey // 50 + 3) AS DOUBLE), CAST(p_partkey % 50 + 1 AS DOUBLE), CAST(-(p_partkey // 50 + 2) AS DOUBLE)
    FROM part WHERE p_partkey % 97 = 0)"""
_WIDE = """wide AS (
    SELECT s_suppkey + 1 AS fid, CAST(s_suppkey % 20 AS DOUBLE) AS x0, CAST(s_suppkey // 20 AS DOUBLE) AS y0, s_suppkey % 20 + 1 + (s_suppkey % 3) / CAST(64 AS DOUBLE) AS x1, CAST(s_suppkey // 20 + 1 AS DOUBLE) AS y1
    FROM supplier)"""
_POINTS = """points AS (
    SELECT event_id AS fid, event_type AS name, user_id % 50 + (event_id % 31 + 1) / CAST(64 AS DOUBLE) AS x, (event_id // 50) % 45 + (event_id % 29 + 1) / CAST(64 AS DOUBLE) AS y
    FROM events)"""
_PAIRS = """pairs AS (
    SELECT a.fid AS a_fid, b.fid AS b_fid, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s,
        (a.x1 - a.x0) * (a.y1 - a.y0) AS pa, (b.x1 - b.x0) * (b.y1 - b.y0) AS pb
    FROM cells a JOIN shifted b ON a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)"""
_RATIOS = f"""WITH {_CELLS}, {_SHIFTED}, {_PAIRS}, r AS (
    SELECT a_fid, b_fid, s AS shared_area, s / pa AS coverage_a, s / pb AS coverage_b, s / (pa + pb - s) AS iou FROM pairs)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = rects.cells(spark, sf_dir), rects.shifted_cells(spark, sf_dir)
    return a, b, change.exact_pairs(a, b, change.planar_area)


def _rounded(*names: str, places: int = 6) -> list[Column]:
    return [F.round(n, places).alias(n) for n in names]


@query(f"WITH {_CELLS}, {_SHIFTED}, u AS (SELECT * FROM cells UNION ALL SELECT * FROM shifted) SELECT min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM u")
def layer_bounds(spark, sf_dir):
    both = rects.cells(spark, sf_dir).unionByName(rects.shifted_cells(spark, sf_dir))
    return both.agg(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))


@query(
    f"""WITH {_WIDE} SELECT row_number() OVER (ORDER BY a.fid, b.fid) AS n, a.fid AS fa, b.fid AS fb, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 1.0, 6) AS area
    FROM wide a JOIN wide b ON a.fid < b.fid AND a.y0 = b.y0 AND least(a.x1, b.x1) > greatest(a.x0, b.x0)"""
)
def overlap_regions(spark, sf_dir):
    found = clean.overlap_regions(rects.wide_cells(spark, sf_dir))
    return found.select("n", "fa", "fb", F.round(geo("area", "geom"), 6).alias("area"))


@query(f"{_RATIOS} SELECT a_fid, b_fid, round(shared_area, 6) AS shared_area, round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b, round(iou, 6) AS iou FROM r")
def pair_ratios(spark, sf_dir):
    return _measured(spark, sf_dir)[2].select("a_fid", "b_fid", *_rounded("shared_area", "coverage_a", "coverage_b", "iou"))


@query(f"WITH {_CELLS}, {_POINTS} SELECT c.fid, count(*) AS n FROM points p JOIN cells c ON p.x > c.x0 AND p.x < c.x1 AND p.y > c.y0 AND p.y < c.y1 GROUP BY c.fid")
def point_in_polygon(spark, sf_dir):
    found = spatial_join(rects.points(spark, sf_dir), rects.cells(spark, sf_dir), "within")
    return found.groupBy(F.col("b_fid").alias("fid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SHIFTED}, {_POINTS} SELECT p.fid, p.name FROM points p WHERE NOT EXISTS (SELECT 1 FROM shifted c WHERE p.x > c.x0 AND p.x < c.x1 AND p.y > c.y0 AND p.y < c.y1)")
def points_outside(spark, sf_dir):
    return spatial_join(rects.points(spark, sf_dir), rects.shifted_cells(spark, sf_dir), "within", how="anti").select("fid", "name")


@query(f"WITH {_CELLS}, {_POINTS} SELECT c.fid, c.code FROM cells c WHERE EXISTS (SELECT 1 FROM points p WHERE p.x > c.x0 AND p.x < c.x1 AND p.y > c.y0 AND p.y < c.y1)")
def cells_with_points(spark, sf_dir):
    return spatial_join(rects.cells(spark, sf_dir), rects.points(spark, sf_dir), "contains", how="semi").select("fid", "code")


@query(f"WITH {_CELLS} SELECT a.fid, count(*) AS n FROM cells a JOIN cells b ON a.fid <> b.fid AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 GROUP BY a.fid")
def neighbour_fanout(spark, sf_dir):
    cells = rects.cells(spark, sf_dir)
    return bbox_pairs(cells, cells).where("a_fid != b_fid").groupBy(F.col("a_fid").alias("fid")).agg(F.count(F.lit(1)).alias("n"))


def _nearest_corner(spark, sf_dir, pts: DataFrame) -> DataFrame:
    corner = F.struct(F.col("bbox.xmin").alias("xmin"), F.col("bbox.ymin").alias("ymin"), F.col("bbox.xmin").alias("xmax"), F.col("bbox.ymin").alias("ymax"))
    corners = rects.cells(spark, sf_dir).select("fid", corner.alias("bbox"))
    far = F.hypot(F.col("a_bbox.xmin") - F.col("b_bbox.xmin"), F.col("a_bbox.ymin") - F.col("b_bbox.ymin"))
    near = bbox_pairs(pts, corners, reach=0.5).withColumn("far", far).where("far < 0.5")
    return near.groupBy(F.col("a_fid").alias("fid")).agg(F.min_by("b_fid", F.struct("far", "b_fid")).alias("corner"))


@query(
    f"""WITH {_CELLS}, {_POINTS} SELECT p.fid, c.fid AS corner FROM points p JOIN cells c ON c.x0 = floor(p.x + 0.5) AND c.y0 = floor(p.y + 0.5) WHERE sqrt(pow(p.x - c.x0, 2) + pow(p.y - c.y0, 2)) < 0.5"""
)
def nearest_corner(spark, sf_dir):
    """The nearest corner of every point; no two corners are within half a unit of one point."""
    return _nearest_corner(spark, sf_dir, rects.points(spark, sf_dir))


@query("SELECT p_brand AS code FROM part GROUP BY p_brand HAVING count(*) = 1 UNION ALL SELECT s_name FROM supplier GROUP BY s_name HAVING count(*) = 1")
def unique_codes(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("code"))
    return change.unique_values(brands, "code").unionByName(change.unique_values(names, "code"))


@query(f"{_RATIOS} SELECT r.a_fid, r.b_fid, a.code = b.code OR a.name = b.name AS \"identity\" FROM r JOIN cells a ON a.fid = a_fid JOIN shifted b ON b.fid = b_fid")
def identity_match(spark, sf_dir):
    a, b, pairs = _measured(spark, sf_dir)
    return change.identity_match(a, b, pairs, change.ChangeOptions(by_code=True, by_name=True)).select("a_fid", "b_fid", "identity")


@query(f"{_RATIOS} SELECT a_fid, b_fid FROM r WHERE greatest(coverage_a, coverage_b) >= 0.8")
def spatial_neighbours(spark, sf_dir):
    return _measured(spark, sf_dir)[2].where(F.greatest("coverage_a", "coverage_b") >= 0.8).select("a_fid", "b_fid")


@query(
    f"""WITH RECURSIVE {_WIDE}, e AS (SELECT a.fid AS a, b.fid AS b FROM wide a JOIN wide b ON a.fid < b.fid AND a.y0 = b.y0 AND least(a.x1, b.x1) > greatest(a.x0, b.x0)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(node, seen) AS (SELECT a, a FROM u UNION SELECT c.node, u.b FROM c JOIN u ON c.seen = u.a)
    SELECT node, min(seen) AS component FROM c GROUP BY node"""
)
def connected_components(spark, sf_dir):
    pairs = clean.overlap_regions(rects.wide_cells(spark, sf_dir))
    return components(pairs.select(F.col("fa").alias("a"), F.col("fb").alias("b")))


def _classes(match: float, names: bool) -> str:
    """Classes of the comparison of cells and shifted cells, whose matches are pairs at most."""
    renamed = f"WHEN a.name <> b.name AND {names} AND iou >= 0.98 THEN 'renamed'"
    return f"""{_RATIOS}, m AS (
        SELECT r.*, CASE WHEN greatest(coverage_a, coverage_b) < {match} THEN 'relocated' {renamed} WHEN iou >= 0.98 THEN 'unchanged' ELSE 'modified' END AS kind,
            CASE WHEN greatest(coverage_a, coverage_b) < {match} THEN 'identity' ELSE 'spatial' END AS method, a.code AS code_a, a.name AS name_a, b.code AS code_b, b.name AS name_b
        FROM r JOIN cells a ON a.fid = a_fid JOIN shifted b ON b.fid = b_fid WHERE a_fid = b_fid AND (greatest(coverage_a, coverage_b) >= {match} OR {names})
    ), lone AS (
        SELECT 'a' AS side, fid, code, name, 'removed' AS kind, 0 AS place FROM cells WHERE fid NOT IN (SELECT a_fid FROM m)
        UNION ALL SELECT 'b', fid, code, name, 'created', 1 FROM shifted WHERE fid NOT IN (SELECT b_fid FROM m)
    ), ids AS (
        SELECT place, fid, CAST(row_number() OVER (ORDER BY place, fid) AS INTEGER) AS cluster_id FROM (SELECT 0 AS place, a_fid AS fid FROM m UNION ALL SELECT place, fid FROM lone)
    )"""


_UNITS = """ SELECT 'a' AS side, a_fid AS fid, cluster_id, kind AS relationship_class FROM m JOIN ids ON place = 0 AND ids.fid = a_fid
    UNION ALL SELECT 'b', b_fid, cluster_id, kind FROM m JOIN ids ON place = 0 AND ids.fid = a_fid
    UNION ALL SELECT side, lone.fid, cluster_id, kind FROM lone JOIN ids ON ids.place = lone.place AND ids.fid = lone.fid"""
_IDENTITY = dict(by_code=True, by_name=True, match=0.97)


def _change(spark, sf_dir, **options) -> tuple[change.Change, DataFrame, DataFrame]:
    a, b, pairs = _measured(spark, sf_dir)
    return change.classify(a, b, pairs, change.ChangeOptions(**options)), a, b


@query(_classes(0.8, False) + _UNITS)
def classify_geometry(spark, sf_dir):
    return _change(spark, sf_dir)[0].units


@query(_classes(0.97, True) + _UNITS)
def classify_identity_either(spark, sf_dir):
    return _change(spark, sf_dir, **_IDENTITY)[0].units


@query(_classes(0.97, True).replace("OR True)", "OR (a.code = b.code AND a.name = b.name))") + _UNITS)
def classify_identity_both(spark, sf_dir):
    return _change(spark, sf_dir, link="both", **_IDENTITY)[0].units


_MERGED = """WITH m AS (SELECT p_partkey AS k, p_partkey // 2 * 2 AS pair, p_partkey // 2 + 1 AS cluster_id FROM part)"""


@query(f"{_MERGED} SELECT 'a' AS side, k + 1 AS fid, CAST(cluster_id AS INTEGER) AS cluster_id, 'merge' AS relationship_class FROM m UNION ALL SELECT 'b', k + 1, CAST(cluster_id AS INTEGER), 'merge' FROM m WHERE k % 2 = 0")
def classify_merge(spark, sf_dir):
    a, b = rects.cells(spark, sf_dir), rects.merged_cells(spark, sf_dir)
    return change.classify(a, b, change.exact_pairs(a, b, change.planar_area)).units


@query(f"{_MERGED} SELECT 'b' AS side, k + 1 AS fid, CAST(cluster_id AS INTEGER) AS cluster_id, 'split' AS relationship_class FROM m UNION ALL SELECT 'a', k + 1, CAST(cluster_id AS INTEGER), 'split' FROM m WHERE k % 2 = 0")
def classify_split(spark, sf_dir):
    a, b = rects.merged_cells(spark, sf_dir), rects.cells(spark, sf_dir)
    return change.classify(a, b, change.exact_pairs(a, b, change.planar_area)).units


@query(
    _classes(0.97, True)
    + """ SELECT code_a, name_a, code_b, name_b, kind AS relationship_class, method AS match_method, round(coverage_a, 3) AS a_in_b, round(coverage_b, 3) AS b_in_a, round(iou, 3) AS similarity,
        CAST(0.97 AS DOUBLE) AS threshold_match, CAST(0.98 AS DOUBLE) AS threshold_unchanged, true AS link_by_code, true AS link_by_name, 'either' AS link_mode FROM m
    UNION ALL SELECT CASE WHEN side = 'a' THEN code END, CASE WHEN side = 'a' THEN name END, CASE WHEN side = 'b' THEN code END, CASE WHEN side = 'b' THEN name END, kind, NULL, NULL, NULL, NULL,
        CAST(0.97 AS DOUBLE), CAST(0.98 AS DOUBLE), true, true, 'either' FROM lone"""
)
def changelog(spark, sf_dir):
    return _change(spark, sf_dir, **_IDENTITY)[0].changelog


@query(
    _classes(0.97, True)
    + """ SELECT cluster_id, kind AS relationship_class, a_fid, b_fid, round(iou, 6) AS iou, code_a AS a_code, code_b AS b_code FROM m JOIN ids ON place = 0 AND ids.fid = a_fid
    UNION ALL SELECT cluster_id, kind, CASE WHEN side = 'a' THEN lone.fid ELSE -1 END, CASE WHEN side = 'b' THEN lone.fid ELSE -1 END, NULL, CASE WHEN side = 'a' THEN code END, CASE WHEN side = 'b' THEN code END
    FROM lone JOIN ids ON ids.place = lone.place AND ids.fid = lone.fid"""
)
def table_rows(spark, sf_dir):
    rows = change.table_rows(*_change(spark, sf_dir, **_IDENTITY))
    return rows.select("cluster_id", "relationship_class", F.coalesce("a_fid", F.lit(-1)).alias("a_fid"), F.coalesce("b_fid", F.lit(-1)).alias("b_fid"), F.round("iou", 6).alias("iou"), "a_code", "b_code")


@query(_classes(0.97, True) + " SELECT cluster_id, code_a AS a_code, code_b AS b_code FROM m JOIN ids ON place = 0 AND ids.fid = a_fid WHERE kind IN ('renamed', 'relocated') AND contains(lower(concat_ws(' ', code_a, name_a, code_b, name_b)), '-11')")
def visible_rows(spark, sf_dir):
    rows = change.table_rows(*_change(spark, sf_dir, **_IDENTITY))
    return change.visible_rows(rows, ["renamed", "relocated"], "-11").select("cluster_id", "a_code", "b_code")


@query(_classes(0.97, True) + " SELECT kind AS relationship_class, count(*) AS clusters FROM (SELECT kind FROM m UNION ALL SELECT kind FROM lone) GROUP BY kind")
def cluster_summary(spark, sf_dir):
    return change.cluster_summary(_change(spark, sf_dir, **_IDENTITY)[0])


@query(
    _classes(0.97, True)
    + """ SELECT 'b' AS piece_side, kind AS relationship_class, b_fid AS fid, 'MultiPolygon' AS kind FROM m
    UNION ALL SELECT side, kind, fid, 'MultiPolygon' FROM lone"""
)
def render_layer(spark, sf_dir):
    rows = change.render_layer(*_change(spark, sf_dir, **_IDENTITY))
    return rows.select("piece_side", "relationship_class", F.coalesce("a_fid", "b_fid").alias("fid"), geo("kind", "geom").alias("kind"))


@query(f"WITH {_WIDE} SELECT fid, CAST(65 AS BIGINT) AS n, round(x0 + (x1 - x0) / 16, 6) AS first_x, round(y0 + (y1 - y0) / 16, 6) AS first_y FROM wide")
def sample_lattice(spark, sf_dir):
    pts = change.sample_points(rects.wide_cells(spark, sf_dir), 8)
    return pts.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("first_x"), F.round(F.min("y"), 6).alias("first_y"))


@query(f"{_RATIOS} SELECT a_fid, b_fid, true AS close FROM r WHERE iou > 0.5")
def sampled_pairs(spark, sf_dir):
    """Whether sampled ratios of matching cells come within 0.04 of the exact ones."""
    a, b, exact = _measured(spark, sf_dir)
    drawn = change.sampled_pairs(a, b, 16, change.planar_area)
    rows = exact.where("iou > 0.5").join(drawn.select("a_fid", "b_fid", F.col("coverage_a").alias("ca"), F.col("iou").alias("i")), ["a_fid", "b_fid"])
    return rows.select("a_fid", "b_fid", ((F.abs(F.col("ca") - F.col("coverage_a")) < 0.04) & (F.abs(F.col("i") - F.col("iou")) < 0.06)).alias("close"))


@query(
    f"""WITH {_WIDE}, o AS (SELECT row_number() OVER (ORDER BY a.fid, b.fid) AS n, a.fid AS fa, b.fid AS fb, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w
        FROM wide a JOIN wide b ON a.fid < b.fid AND a.y0 = b.y0 AND least(a.x1, b.x1) > greatest(a.x0, b.x0))
    SELECT 'overlap-' || n AS key, 'overlap' AS kind, round(w, 6) AS area_deg, round(w * 111320.0 * 111320.0 / 1e6, 3) AS area_km2, fa AS unit_a, fb AS unit_b FROM o"""
)
def issues(spark, sf_dir):
    wide = rects.wide_cells(spark, sf_dir)
    gaps = spark.createDataFrame([], clean.GAP_SCHEMA)
    found = clean.issues(gaps, clean.overlap_regions(wide), spark.createDataFrame([], clean.SLIVER_SCHEMA))
    return found.select("key", "kind", F.round("area_deg", 6).alias("area_deg"), F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"), "unit_a", "unit_b")


_HOLES = "p_partkey % 50 BETWEEN 1 AND 48 AND (p_partkey % 50) % 5 = 2 AND (p_partkey // 50) % 5 = 2 AND p_partkey // 50 < (SELECT max(p_partkey) // 50 - 1 FROM part)"


@query(f"SELECT row_number() OVER (ORDER BY p_partkey % 50, p_partkey // 50) AS n, CAST(p_partkey % 50 AS DOUBLE) AS xmin, CAST(p_partkey // 50 AS DOUBLE) AS ymin, CAST(1 AS DOUBLE) AS area FROM part WHERE {_HOLES}")
def gap_regions(spark, sf_dir):
    cells = rects.cells(spark, sf_dir)
    top = cells.agg(F.max("bbox.ymin")).first()[0] or 0.0
    x, y = F.col("bbox.xmin"), F.col("bbox.ymin")
    hole = x.between(1, 48) & (x % 5 == 2) & (y % 5 == 2) & (y < top - 1)
    found = clean.gap_regions(cells.where(~hole)).withColumn("bbox", geo("bbox", "geom"))
    return found.select("n", "bbox.xmin", "bbox.ymin", F.round(geo("area", "geom"), 6).alias("area"))


@query(
    """SELECT p_partkey, round(CASE WHEN p_retailprice < 0 THEN -1 ELSE p_retailprice / (111320.0 * greatest(cos(radians(p_size)), 0.05)) END, 9) AS degrees,
        round(p_retailprice * 111320.0 * 111320.0 * greatest(cos(radians(p_size)), 0.05) / 1e9, 3) AS area FROM part"""
)
def unit_conversions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cos = F.greatest(F.cos(F.radians("p_size")), F.lit(units.LEAST_COS))
    degrees = F.when(F.col("p_retailprice") < 0, F.lit(-1.0)).otherwise(units.metres_to_degrees(F.col("p_retailprice")) / cos)
    return part.select("p_partkey", F.round(degrees, 9).alias("degrees"), F.round(units.square_degrees_to_m2(F.col("p_retailprice")) * cos / 1e9, 3).alias("area"))


@query(
    """WITH v AS (SELECT c_custkey, c_acctbal AS x FROM customer), p AS (SELECT *, pow(10.0, floor(log10(CASE WHEN x > 0 THEN x END))) AS t FROM v)
    SELECT c_custkey, CAST(CASE WHEN x <= 0 THEN 100 WHEN x / t <= 1 THEN t WHEN x / t <= 2 THEN 2 * t WHEN x / t <= 5 THEN 5 * t ELSE 10 * t END AS DOUBLE) AS nice FROM p"""
)
def nice_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", units.nice_number(F.col("c_acctbal")).alias("nice"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, sin(radians(s_suppkey % 80)) AS s0, sin(radians(s_suppkey % 80 + 1)) AS s1, CAST(0.0818191908426215 AS DOUBLE) AS e FROM supplier), q AS (
        SELECT k, (1 - e * e) * (s0 / (1 - e * e * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0, (1 - e * e) * (s1 / (1 - e * e * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) AS q1,
            (1 - e * e) * (1 / (1 - e * e) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp FROM s), t AS (
        SELECT k, asin(sqrt(3.0) / 2 * sin(asin(q0 / qp))) AS t0, asin(sqrt(3.0) / 2 * sin(asin(q1 / qp))) AS t1, 6378137.0 * sqrt(qp / 2) AS r FROM q), p AS (
        SELECT k, r * t0 * (0.003796 * pow(t0, 8) + 0.000893 * pow(t0, 6) - 0.081106 * pow(t0, 2) + 1.340264) AS y0, r * t1 * (0.003796 * pow(t1, 8) + 0.000893 * pow(t1, 6) - 0.081106 * pow(t1, 2) + 1.340264) AS y1,
            2 * sqrt(3.0) * r * radians(1) * cos(t0) / (3 * (9 * 0.003796 * pow(t0, 8) + 7 * 0.000893 * pow(t0, 6) - 3 * 0.081106 * pow(t0, 2) + 1.340264)) AS w0,
            2 * sqrt(3.0) * r * radians(1) * cos(t1) / (3 * (9 * 0.003796 * pow(t1, 8) + 7 * 0.000893 * pow(t1, 6) - 3 * 0.081106 * pow(t1, 2) + 1.340264)) AS w1 FROM t)
    SELECT k AS fid, round((w0 + w1) / 2 * (y1 - y0) / 1e6, 4) AS km2 FROM p"""
)
def equal_earth(spark, sf_dir):
    k = F.col("s_suppkey")
    boxes = rects.rectangles(table(spark, sf_dir, "supplier"), k, k, k, k % 20, k % 80, k % 20 + 1, k % 80 + 1)
    return boxes.select("fid", F.round(equal_earth_area("geom") / 1e6, 4).alias("km2"))


_GONE = "(CAST({x} BETWEEN 0.9 AND 5.1 AND {y} BETWEEN 0.9 AND 1.1 AS INTEGER))"


@query(
    f"""WITH {_WIDE}, n AS (SELECT fid, 4 - {" - ".join(_GONE.format(x=x, y=y) for x in ("x0", "x1") for y in ("y0", "y1"))} AS n FROM wide)
    SELECT fid, CAST(CASE WHEN n >= 3 THEN n ELSE 4 END AS INTEGER) AS corners FROM n"""
)
def vertex_delete(spark, sf_dir):
    """Corners of all cells once those in a box are deleted; a cell that would lose two stays."""
    edited, _ = clean.delete_vertices(rects.wide_cells(spark, sf_dir), (0.9, 0.9, 5.1, 1.1))
    return edited.select("fid", (geo("count_of", "geom", F.lit("points")) - 1).alias("corners"))


@query(f"WITH {_CELLS} SELECT fid, round((x1 - x0) * (y1 - y0), 6) AS area, CAST(5 AS INTEGER) AS points, true AS same FROM cells")
def ring_rebuild(spark, sf_dir):
    cells = rects.cells(spark, sf_dir).select("fid", "geom", geo("from_rings", geo("rings", "geom")).alias("again"))
    return cells.select("fid", F.round(geo("area", "again"), 6).alias("area"), geo("count_of", "again", F.lit("points")).alias("points"), (F.col("geom") == F.col("again")).alias("same"))


@query("SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def export_attributes(spark, sf_dir):
    from tessella.sources.sinks import portable

    rows = portable(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding"))
    return rows.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).alias("n"))


@query("SELECT 'part' AS layer, NULL AS code, 'p_name' AS name UNION ALL SELECT 'nation', NULL, 'n_name' UNION ALL SELECT 'admin', 'adm2_pcode', 'adm2_en'")
def column_detection(spark, sf_dir):
    rows = [(n, *detect_columns(c)) for n, c in (("part", table(spark, sf_dir, "part").columns), ("nation", table(spark, sf_dir, "nation").columns), ("admin", ["adm1_en", "adm2_en", "adm2_pcode", "geom", "fid"][1:]))]
    return spark.createDataFrame(rows, "layer string, code string, name string")


@query(
    f"""WITH {_WIDE} SELECT w.fid, round(w.x1 - w.x0 - greatest(0, coalesce(p.x1 - w.x0, 0)), 6) AS area, true AS valid
    FROM wide w LEFT JOIN wide p ON p.fid = w.fid - 1 AND p.y0 = w.y0"""
)
def clean_coverage(spark, sf_dir):
    rows = clean.clean_coverage(clean.frozen(rects.wide_cells(spark, sf_dir)))
    return rows.select("fid", F.round(geo("area", "geom"), 6).alias("area"), geo("is_valid", "geom").alias("valid"))


@query("SELECT CAST(count(*) AS BIGINT) AS \"rows\", CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS overlaps, false AS failed FROM supplier")
def export_check(spark, sf_dir):
    rows = clean.clean_coverage(clean.frozen(rects.wide_cells(spark, sf_dir)))
    c = clean.export_check(rows)
    return spark.createDataFrame([(c.rows, c.invalid, c.gaps, c.overlaps, c.failed)], "rows long, invalid long, gaps long, overlaps long, failed boolean")


def _regions(spark, sf_dir) -> DataFrame:
    """A tiling of five by five, one unit for each nation."""
    k = F.col("n_nationkey")
    return rects.rectangles(table(spark, sf_dir, "nation"), k + 1, k, F.col("n_name"), k % 5, F.floor(k / 5), k % 5 + 1, F.floor(k / 5) + 1)


_SIDES = "(CAST(n_nationkey % 5 = 0 AS INTEGER) + CAST(n_nationkey % 5 = 4 AS INTEGER) + CAST(n_nationkey // 5 = 0 AS INTEGER) + CAST(n_nationkey // 5 = 4 AS INTEGER))"


@query(f"SELECT CAST(n_nationkey + 1 AS BIGINT) AS fid, CAST({_SIDES} AS DOUBLE) AS length FROM nation WHERE {_SIDES} > 0 UNION ALL SELECT 0, CAST(sum(4 - {_SIDES}) AS DOUBLE) FROM nation")
def boundary_lines(spark, sf_dir):
    """The length of each unit's outer lines, and under 0 that of all shared lines, which count from both sides."""
    outer, shared = extend.boundary_lines(clean.frozen(_regions(spark, sf_dir)))
    both = outer.unionByName(shared.select(F.lit(0).cast("long").alias("fid"), "geom"))
    return both.groupBy("fid").agg(F.round(F.sum(geo("length", "geom")), 6).alias("length"))


@query(f"WITH t AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS fid, {_SIDES} AS sides FROM nation) SELECT fid, sides > 0 AS has_points FROM t WHERE sides > 0")
def generator_points(spark, sf_dir):
    """Units that boundary points are made for: those with an outer line."""
    outer, _ = extend.boundary_lines(clean.frozen(_regions(spark, sf_dir)))
    points = extend.generators(outer, extend.junction_zone(outer), 0.25)
    return points.groupBy("fid").agg((F.count(F.lit(1)) >= 4).alias("has_points"))


@query(
    """WITH d AS (SELECT p_partkey AS k, p_partkey % 50 AS col, p_partkey % 7 = 0 AS gone, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE (p_size % 4) / CAST(64 AS DOUBLE) END AS dx FROM part), r AS (
        SELECT d.k + 1 AS fid, CASE WHEN d.gone THEN 1 - coalesce(l.dx, 0) ELSE greatest(0, d.dx - coalesce(l.dx, 0)) END AS area FROM d LEFT JOIN d l ON l.k = d.k - 1 AND d.col > 0)
    SELECT fid, round(area, 6) AS area FROM r WHERE area > 0"""
)
def uncovered_parts(spark, sf_dir):
    rest = change.only(rects.cells(spark, sf_dir), rects.shifted_cells(spark, sf_dir))
    return rest.select("fid", F.round(geo("area", "geom"), 6).alias("area"))


@query(
    f"""WITH {_CELLS} SELECT printf('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f]]]}},"properties":{{"fid":%d,"code":"%s","name":"%s"}}}}',
        x0, y0, x0, y1, x1, y1, x1, y0, x0, y0, fid, code, name) AS value FROM cells"""
)
def feature_text(spark, sf_dir):
    from tessella.sources.sinks import feature_rows

    return feature_rows(rects.cells(spark, sf_dir))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS fid, true AS covers, true AS valid FROM nation")
def extend_coverage(spark, sf_dir):
    own = _regions(spark, sf_dir)
    grown = extend.extend(own, 0.1).extended
    rows = grown.join(own.select("fid", F.col("geom").alias("g0")), "fid")
    return rows.select("fid", (geo("area", geo("difference", "g0", "geom")) < 1e-9).alias("covers"), geo("is_valid", "geom").alias("valid"))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS fid, CAST(1 AS DOUBLE) AS area FROM nation")
def clip_coverage(spark, sf_dir):
    own = _regions(spark, sf_dir)
    mask = own.agg(geo("union_list", F.collect_list("geom")).alias("geom"))
    out = extend.clip(own, extend.extend(own, 0.1).extended, mask)
    return out.select("fid", F.round(geo("area", "geom"), 4).alias("area"))


@query()
def sliver_regions(spark, sf_dir):
    """Near misses of 1/1024 degree between cells; the validator decides how far an edge reaches, so there is no closed form."""
    k = F.col("s_suppkey")
    boxes = rects.rectangles(table(spark, sf_dir, "supplier"), k + 1, k, k, k % 20, F.floor(k / 20), k % 20 + 1 - (k % 2) / 1024, F.floor(k / 20) + 1)
    none = spark.createDataFrame([], clean.GAP_SCHEMA)
    return clean.sliver_regions(boxes, none, none, 200.0).select("n", F.round(geo("length", "geom"), 6).alias("length"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, spatial join, overlay, components, classes: clusters of each class between two versions of a layer."""
    return cluster_summary(spark, sf_dir).orderBy("relationship_class")


from tessella import steps  # noqa: E402, F401  registers its queries
