import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import units
from tessella.functions.geometry import equal_earth_area, geo, register
from tessella.operators.components import components
from tessella.operators.spatial_join import bbox_pairs, spatial_join, with_bbox
from tessella.plans import change, clean, extend
from tessella.plans.change import ChangeOptions
from tessella.session import numbered


def boxes(spark, rows, code=None, name=None):
    """A keyed layer of rectangles (x0, y0, x1, y1)."""
    register(spark)
    df = spark.createDataFrame([(i + 1, code(i) if code else str(i + 1), name(i) if name else f"u{i + 1}", list(map(float, b))) for i, b in enumerate(rows)], "fid long, code string, name string, b array<double>")
    return with_bbox(df.select("fid", "code", "name", geo("make_envelope", "b").alias("geom")))


MATRIX_A = ([0, 0, 2, 2], [2, 0, 4, 2], [4, 0, 6, 2], [4, 2, 6, 4], [6, 0, 10, 2], [0, 2, 2, 4])
MATRIX_B = ([0, 0, 2, 2], [2.3, 0, 4.3, 2], [4, 0, 6, 4], [6, 0, 8, 2], [8, 0, 10, 2], [0, 4, 2, 6])
CODES_A, CODES_B = ("1", "2", "3", "4", "5", "6"), ("1", "2", "7", "81", "82", "9")
TINY = ([10, 48, 11.0001, 49], [11, 48, 12, 49], [12.001, 48, 13, 49], [10, 49, 11.0001, 50], [11, 49, 12, 50], [12.001, 49, 13, 50])


def matrix(spark):
    return boxes(spark, MATRIX_A, CODES_A.__getitem__), boxes(spark, MATRIX_B, CODES_B.__getitem__, lambda i: "moved" if i == 1 else f"u{i + 1}")


def classes(result):
    rows = {}
    for r in result.units.collect():
        rows.setdefault((r.cluster_id, r.relationship_class), ([], []))[r.side == "b"].append(r.fid)
    return {k: (sorted(a), sorted(b)) for k, (a, b) in rows.items()}


def test_pairs_and_clusters_of_the_matrix(spark):
    a, b = matrix(spark)
    pairs = {(r.a_fid, r.b_fid): r for r in change.exact_pairs(a, b).collect()}
    want = {(1, 1): (49224190916, 1, 1, 1), (2, 2): (41840562278, 0.85, 0.85, 0.7391), (3, 2): (7383628637, 0.15, 0.15, 0.0811), (3, 3): (49224190916, 1, 0.5004, 0.5004), (4, 3): (49165817805, 1, 0.4998, 0.4998), (5, 4): (49224190916, 0.5, 1, 0.5), (5, 5): (49224190916, 0.5, 1, 0.5)}
    assert set(pairs) == set(want)
    for k, (area, p, q, iou) in want.items():
        r = pairs[k]
        assert r.shared_area == pytest.approx(area, rel=1e-7) and (r.coverage_a, r.coverage_b, r.iou) == pytest.approx((p, q, iou), abs=6e-5)
    result, method = change.compare(a, b)
    assert method == "exact"
    assert classes(result) == {(1, "unchanged"): ([1], [1]), (2, "modified"): ([2], [2]), (3, "merge"): ([3, 4], [3]), (4, "split"): ([5], [4, 5]), (5, "removed"): ([6], []), (6, "created"): ([], [6])}
    assert result.changelog.count() == 8
    rows = change.table_rows(result, a, b)
    assert [r.cluster_id for r in rows.collect()] == [1, 2, 3, 3, 4, 4, 5, 6]
    spans = {r.cluster_id: r.span_side for r in change.visible_rows(rows, list(change.CLASSES)).collect()}
    assert spans[3] == "b" and spans[4] == "a" and spans[1] is None
    assert change.render_layer(result, a, b).count() == 7 and change.outlines(result, "a", a).count() == 6


def test_relocated_and_renamed(spark):
    a, b = matrix(spark)
    high = classes(change.classify(a, b, change.exact_pairs(a, b), ChangeOptions(match=0.9)))
    assert (2, "removed") in high and ([], [2]) in high.values()
    moved = classes(change.classify(a, b, change.exact_pairs(a, b), ChangeOptions(match=0.9, by_code=True)))
    assert moved[2, "relocated"] == ([2], [2])
    same = boxes(spark, MATRIX_A, CODES_A.__getitem__, lambda i: "other" if i == 0 else f"u{i + 1}")
    renamed = change.classify(a, same, change.exact_pairs(a, same), change.matching_mode("identity", True, True))
    assert classes(renamed)[1, "renamed"] == ([1], [1])
    assert (1, "unchanged") in classes(change.classify(a, same, change.exact_pairs(a, same), change.matching_mode("geometry", True, True)))


def test_complex_clusters_and_codes_that_repeat(spark):
    a = boxes(spark, ([0, 0, 2, 1], [0, 1, 2, 2]), lambda i: "same")
    b = boxes(spark, ([0, 0, 1, 2], [1, 0, 2, 2]), lambda i: "same")
    pairs = change.exact_pairs(a, b)
    assert classes(change.classify(a, b, pairs, ChangeOptions(match=0.4))) == {(1, "complex"): ([1, 2], [1, 2])}
    assert change.identity_match(a, b, pairs, ChangeOptions(by_code=True)).where("identity").count() == 0
    alone = classes(change.classify(a, b, pairs, ChangeOptions(match=0.9, by_code=True)))
    assert sorted(k for _, k in alone) == ["created", "created", "removed", "removed"]


def test_swap_mirrors_classes_and_identical_layers_are_unchanged(spark):
    a, b = matrix(spark)
    kinds = [sorted(k for _, k in classes(change.compare(x, y)[0])) for x, y in ((a, b), (b, a), (a, a))]
    mirror = {"split": "merge", "merge": "split", "removed": "created", "created": "removed"}
    assert kinds[1] == sorted(mirror.get(k, k) for k in kinds[0]) and kinds[2] == ["unchanged"] * 6


def greedy(pairs, same_code, same_name, tau):
    """Claims taken one after the other, as in a plain reading of the rule."""
    identity = {p for p in pairs if same_code(p) or same_name(p)}
    spatial = {p for p, (x, y) in pairs.items() if max(x, y) >= tau}
    out, left, right = set(), set(), set()
    for p, q in sorted(identity):
        if p in left or q in right:
            continue
        others = {y for x, y in spatial if x == p and y != q}, {x for x, y in spatial if y == q and x != p}
        if all(any(y == o for _, y in identity) for o in others[0]) and all(any(x == o for x, _ in identity) for o in others[1]):
            out.add((p, q))
            left.add(p)
            right.add(q)
    return out


def test_conflicting_claims_match_a_sequential_reading(spark):
    rng = random.Random(3)
    for _ in range(4):
        n = 12
        codes, names = (random.Random(rng.random()).sample(range(n), n) for _ in range(2))
        a = boxes(spark, [[0, 0, 1, 1]] * n, lambda i: f"c{i}", lambda i: f"n{i}")
        b = boxes(spark, [[0, 0, 1, 1]] * n, lambda i: f"c{codes[i]}", lambda i: f"n{names[i]}")
        pairs = {(p + 1, q + 1): (rng.random(), rng.random()) for p in range(n) for q in range(n) if rng.random() < 0.6}
        df = spark.createDataFrame([(p, q, 1.0, x, y, 0.5) for (p, q), (x, y) in pairs.items()], "a_fid long, b_fid long, shared_area double, coverage_a double, coverage_b double, iou double")
        options = ChangeOptions(match=0.93, by_code=True, by_name=True)
        got = {(r.a_fid, r.b_fid) for r in change.claims(change.identity_match(a, b, df, options), options).collect()}
        assert got == greedy(pairs, lambda p: codes[p[1] - 1] == p[0] - 1, lambda p: names[p[1] - 1] == p[0] - 1, 0.93)


def test_sampling_is_close_to_exact(spark):
    a, b = matrix(spark)
    exact = {(r.a_fid, r.b_fid): r.iou for r in change.exact_pairs(a, b).collect()}
    for r in change.sampled_pairs(a, b).collect():
        assert abs(exact.get((r.a_fid, r.b_fid), 0.0) - r.iou) < 0.02
    with pytest.raises(ValueError):
        change.compare(a, b, ChangeOptions(same=0.995), "sampling")


def test_sampling_joins_units_and_counts_points_as_a_plain_join_does(spark, monkeypatch):
    register(spark)
    shapes = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))", "POLYGON ((1 1, 9 1, 5 8, 1 1))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((6 6, 8 6, 8 8, 6 6)))", "POLYGON EMPTY", None, "POLYGON ((4 0, 5 0, 5 4, 4 4, 4 0))"]
    df = spark.createDataFrame(list(enumerate(shapes)), "fid long, t string").select("fid", geo("from_text", "t").alias("geom")).withColumn("bbox", geo("bbox", "geom"))
    a, b = df.where("fid != 1"), df.withColumn("fid", F.col("fid") + 10).where("fid != 10")
    wanted = {}
    for n, x, y in (("a", a, b), ("b", b, a)):
        points = change.sample_points(x, 7)
        total = {r.fid: r["count"] for r in points.groupBy("fid").count().collect()}
        pairs = points.crossJoin(y.select(F.col("fid").alias("o"), "geom")).where(geo("within", geo("make_point", "x", "y"), "geom")).groupBy("fid", "o").count()
        for r in pairs.collect():
            key = (r.fid, r.o) if n == "a" else (r.o, r.fid)
            wanted.setdefault(key, {"a": 0.0, "b": 0.0})[n] = r["count"] / total[r.fid]
    held, before = [], change.cut
    monkeypatch.setattr(change, "cut", lambda x: held.append(before(x)) or held[-1])
    rows = change.sampled_pairs(a, b, 7, change.planar_area).collect()
    assert {(r.a_fid, r.b_fid): {"a": r.coverage_a, "b": r.coverage_b} for r in rows} == wanted and len(wanted) > 5
    # points are never rows: what is kept on the way has a row for each unit
    assert max(x.count() for x in held) <= df.count()


def test_pairs_are_measured_once_and_neighbours_not_at_all(spark):
    a = boxes(spark, [[i, j, i + 1, j + 1] for i in range(6) for j in range(6)])
    b = boxes(spark, [[i + 0.25, j, i + 1.25, j + 1] for i in range(6) for j in range(6)])
    for rows, names in ((change.exact_pairs(a, b, change.planar_area), ("intersection", "common_part")), (change.sampled_pairs(a, b, 8, change.planar_area), ("sample_hits",))):
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert sum(text.count(f"tess_{n}(") for n in names) == 1 and "tess_intersects(" not in text
        # one of 65 samples lies on the surface
        assert {(r.a_fid, r.b_fid): r.shared_area for r in rows.collect()} == pytest.approx({(x, y): 0.75 if x == y else 0.25 for x in range(1, 37) for y in (x, x - 6) if y > 0}, abs=1 / 65)
    # an edge is no common area, of shapes whose boxes have one as well; a part without polygons is none
    shapes = ["POLYGON ((0 0, 4 0, 0 4, 0 0))", "POLYGON ((4 0, 4 4, 0 4, 4 0))", "POLYGON ((2 0, 6 0, 2 4, 2 0))", "LINESTRING (0 0, 4 4)", "POLYGON EMPTY", None]
    df = spark.createDataFrame(list(enumerate(shapes)), "fid long, t string").select("fid", geo("from_text", "t").alias("geom")).withColumn("bbox", geo("bbox", "geom"))
    found = {(r.a_fid, r.b_fid): r.area for r in change.overlay(df, df).select("a_fid", "b_fid", geo("area", "geom").alias("area")).collect()}
    assert found == pytest.approx({(0, 0): 8.0, (1, 1): 8.0, (2, 2): 8.0, (0, 2): 2.0, (2, 0): 2.0, (1, 2): 4.0, (2, 1): 4.0})


def test_overlay_and_only(spark):
    a, b = matrix(spark)
    rest = {r.fid: r.area for r in change.only(a, b).select("fid", geo("area", "geom").alias("area")).collect()}
    assert rest == pytest.approx({2: 0.6, 6: 4.0})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.sampled_from([None, 0.3, 5.0]), st.sampled_from([0.0, 0.4]))
def test_join_on_cells_is_a_plain_join(spark, seed, cell, reach):
    rng = random.Random(seed)

    def some(n):
        out = []
        for _ in range(n):
            x, y, w = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0, 0.1, 1, 1, 3, 30])
            out.append([x, y, x + w * rng.random(), y + w])
        return out

    left, right = some(60), some(60)
    found = [(r.a_fid, r.b_fid) for r in bbox_pairs(boxes(spark, left), boxes(spark, right), cell=cell, reach=reach).select("a_fid", "b_fid").collect()]
    want = {(i + 1, j + 1) for i, p in enumerate(left) for j, q in enumerate(right) if p[0] - reach <= q[2] and p[2] + reach >= q[0] and p[1] - reach <= q[3] and p[3] + reach >= q[1]}
    assert len(found) == len(set(found)) and set(found) == want


def test_small_boxes_never_meet_above_their_level(spark):
    """Candidates grow by what a large box really meets, not with the square of the small ones."""
    from tessella.operators import spatial_join as sj

    small = [(float(i % 60), float(i // 60), float(i % 60) + 0.9, float(i // 60) + 0.9) for i in range(3600)]
    layers = [boxes(spark, small + more) for more in ([], [(0, 0, 60, 60)], [(0, 0, 60, 60), (10, 10, 30, 30)])]

    def candidates(layer):
        pairs = sj._dealt(layer, layer, 1.8, 2, 0.0)
        on = [F.col(f"_a_{c}") == F.col(f"_b_{c}") for c in ("level", "cx", "cy")]
        return sum(a.join(b, on).count() for a, b in pairs)

    alone, one, two = map(candidates, layers)
    assert one <= alone + 4 * 2 * len(small) * 1.3 and two <= one + 4 * 2 * len(small) * 1.3
    got = {tuple(r) for r in bbox_pairs(layers[2], layers[2], ordered=True).select("a_fid", "b_fid").collect()}
    every = small + [(0, 0, 60, 60), (10, 10, 30, 30)]
    want = {(i + 1, j + 1) for i in range(3600, 3602) for j in range(i) if every[j][0] <= every[i][2] and every[j][2] >= every[i][0] and every[j][1] <= every[i][3] and every[j][3] >= every[i][1]}
    assert got == {(min(p), max(p)) for p in want}


def test_long_boxes_raise_no_candidates_across_them(spark, monkeypatch):
    """Many long boxes among small ones, as at the rim of a grown coverage: candidates stay near the pairs that meet."""
    from tessella.operators import spatial_join as sj

    layer = boxes(spark, [(x, y, x + 3, y + 3) if x else (-900, y, 3, y + 3) for y in range(0, 900, 3) for x in range(0, 30, 3)])
    joined, dealt = [], sj._dealt
    monkeypatch.setattr(sj, "_dealt", lambda *a: joined.extend(dealt(*a)) or joined)
    met = bbox_pairs(layer, layer).count()
    candidates = sum(a.join(b, [F.col(f"_a_{c}") == F.col(f"_b_{c}") for c in ("level", "cx", "cy")]).count() for a, b in joined)
    assert met == 10 * 300 + 2 * (9 * 300 + 10 * 299 + 2 * 9 * 299) and candidates < 20 * met


def test_joins_without_geometry(spark):
    a, none = boxes(spark, MATRIX_A), boxes(spark, MATRIX_A).limit(0)
    lost = a.withColumn("geom", F.lit(None).cast("binary")).withColumn("bbox", geo("bbox", "geom"))
    assert bbox_pairs(a, none).count() == 0 and spatial_join(lost, a, how="anti").count() == 6 and spatial_join(a, a, how="semi").count() == 6


def test_numbers_are_consecutive(spark):
    rows = numbered(spark.range(1000).repartition(7).withColumn("k", F.xxhash64("id")), "n", "k").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001)) and [r.k for r in rows] == sorted(r.k for r in rows)
    assert numbered(spark.range(0), "n").count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clean_of_the_small_layer(spark):
    session = clean.CleanSession(boxes(spark, TINY))
    result = session.run(10.0)
    kinds = {r.kind: (r.issues, r.fixed) for r in clean.issue_counts(result.issues, result.fixed).collect()}
    assert session.latitude == 49.0 and kinds["overlap"] == (2, 2) and "gap" not in kinds and kinds["sliver"][0] >= 1
    over = [r for r in result.issues.collect() if r.kind == "overlap"]
    assert [(r.unit_a, r.unit_b) for r in over] == [(1, 2), (4, 5)] and over[0].area_m2 == pytest.approx(812998, rel=1e-5) and over[0].max_width_m == pytest.approx(11.132, rel=1e-3)
    assert result.check == clean.ExportCheck(6, 0, 0, 0) and result.collapsed == 0
    again = clean.CleanSession(result.cleaned).run(0)
    areas = [sorted((r.fid, round(r.a, 9)) for r in x.cleaned.select("fid", geo("area", "geom").alias("a")).collect()) for x in (result, again)]
    assert areas[0] == areas[1] and again.issues.count() == 0


def test_gaps_are_filled_up_to_a_width(spark):
    ring = ([0, 0, 3, 1], [0, 2, 3, 3], [0, 1, 1, 2], [2, 1, 3, 2])
    session = clean.CleanSession(boxes(spark, ring))
    result = session.run(0)
    assert [r.key for r in result.fixed.collect()] == ["gap-1"] and result.cleaned.select(F.sum(geo("area", "geom"))).first()[0] == pytest.approx(9)
    narrow = session.reclean(1000.0, 0)
    assert narrow.fixed.count() == 0 and narrow.check.gaps == 1 and clean.gap_slider(narrow.issues)[0] == 500_000
    filled = clean.CleanSession(boxes(spark, [*ring, [1, 1, 2, 2]])).run(0)
    assert filled.issues.count() == 0
    with pytest.raises(clean.CleanError):
        clean.CleanSession(boxes(spark, ring).limit(0)).run()


def test_edits_and_undo(spark):
    session = clean.CleanSession(boxes(spark, ([0, 0, 1, 1], [1.01, 0, 2, 1])))
    assert clean.vertices_in_box(session.layer, (0.9, 0.9, 1.1, 1.1)).count() == 2
    assert session.pinch(0.9, 0.9, 1.1, 1.1) == 2
    tops = {r[0] for r in session.layer.select(F.explode(geo("rings", "geom")).alias("r")).select(F.explode("r.points").alias("p")).where("p.y = 1 and p.x between 0.9 and 1.1").select("p.x").collect()}
    assert tops == {1.005}
    assert session.delete(0.9, 0.9, 1.1, 1.1) == 2
    assert [r[0] for r in session.layer.orderBy("fid").select(geo("count_of", "geom", F.lit("points"))).collect()] == [4, 4]
    with pytest.raises(clean.CleanError):
        session.pinch(50, 50, 51, 51)
    assert session.undo() and session.undo() and not session.undo()
    assert session.layer.select(F.sum(geo("area", "geom"))).first()[0] == pytest.approx(1.99)


def test_sliver_vertices(spark):
    layer = boxes(spark, ([0, 0, 1, 1], [1.00005, 0, 2, 1]))
    none = spark.createDataFrame([], clean.GAP_SCHEMA)
    slivers = clean.sliver_regions(layer, none, none, 10.0)
    assert slivers.count() >= 1 and clean.sliver_regions(layer, none, none, 0).count() == 0
    xs = {r.x for r in clean.sliver_vertices(layer, slivers, 10.0).collect()}
    assert {1.0, 1.00005} <= xs


@pytest.mark.parametrize("shape", ["tiling", "corner"])
def test_extend(spark, shape):
    rows = [[10 + i, 48 + j, 11 + i, 49 + j] for j in range(2) for i in range(3)]
    if shape == "corner":
        rows = rows[:4]
    layer = boxes(spark, rows)
    result = extend.extend(layer, 0.07)
    got = result.extended.join(layer.select("fid", F.col("geom").alias("g0")), "fid")
    checks = got.select(geo("area", geo("difference", "g0", "geom")).alias("lost"), geo("is_valid", "geom").alias("ok")).collect()
    assert len(checks) == len(rows) and all(c.ok and c.lost < 1e-9 for c in checks) and result.warnings == []
    b = result.bounds
    assert b[0] < 10 and b[1] < 48 and b[2] > 13 and b[3] > 49
    mask = layer.agg(geo("union_list", F.collect_list("geom")).alias("geom"))
    clipped = extend.clip(layer, result.extended, mask)
    if shape == "tiling":
        assert all(r[0] == pytest.approx(1.0, abs=1e-6) for r in clipped.select(geo("area", "geom")).collect())
    with pytest.raises(extend.ExtendError):
        extend.clip(layer, result.extended, mask.limit(0))


def test_units():
    assert units.metres_to_degrees(-5) == -1 and units.metres_to_degrees(0) == 0
    assert units.metres_to_degrees(10, 49.0) == pytest.approx(1.369e-4, rel=1e-3)
    assert units.m2_to_square_degrees(units.square_degrees_to_m2(2.0, 60), 60) == pytest.approx(2.0)
    assert [units.nice_number(n) for n in (0, -1, 1, 1.1, 2, 3, 5.5, 22, 0.03)] == pytest.approx([100, 100, 1, 2, 2, 5, 10, 50, 0.05])
    assert units.cos_latitude(90) == 0.05 and units.cos_latitude(math.nan) == 1.0


def test_geometry_functions(spark):
    register(spark)
    g = lambda wkt: geo("from_text", F.lit(wkt))
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(geo("as_text", geo("line_merge", g("MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))")))) == "LINESTRING (0 0, 1 0, 2 0)"
    assert [one(geo("as_text", p)) for p in [F.element_at(geo("interpolate_points", g("LINESTRING (0 0, 4 0)"), F.lit(1.0)), i) for i in (1, 4)]] == ["POINT (1 0)", "POINT (4 0)"]
    assert one(F.size(geo("interpolate_points", g("LINESTRING (0 0, 1 0)"), F.lit(9.0)))) == 1
    assert one(geo("inscribed_circle", g("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))")).radius) == pytest.approx(1.0, abs=0.01)
    assert one(F.size(geo("polygonize", F.array(geo("node", F.array(g("LINESTRING (0 0, 2 0, 2 2, 0 2, 0 0)"), g("LINESTRING (1 -1, 1 3)"))))))) == 2
    assert one(geo("is_valid", geo("make_valid", g("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))")))) is True
    assert one(geo("as_text", geo("remove_repeated", g("LINESTRING (0 0, 0 0, 1 1)")))) == "LINESTRING (0 0, 1 1)"
    assert one(geo("as_text", geo("extract", g("GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 1 1))"), F.lit(3)))) == "MULTIPOLYGON EMPTY"
    assert one(geo("within", g("POINT (0 0)"), g("POLYGON ((0 0, 1 0, 1 1, 0 0))"))) is False
    assert one(geo("area", F.lit(None).cast("binary"))) is None
    assert json.loads(one(geo("as_geojson", g("POINT (1 2.5)")))) == {"type": "Point", "coordinates": [1.0, 2.5]}
    assert one(equal_earth_area(g("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"))) == pytest.approx(49224190916, rel=1e-8)
