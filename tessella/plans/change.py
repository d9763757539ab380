"""What changed between two versions of a layer: measured overlap, matching, classes, change log."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import equal_earth_area, geo, polygonal, register, union_agg
from tessella.operators.components import components
from tessella.operators.spatial_join import bbox_pairs, with_bbox
from tessella.session import column, computation_failed, cut, numbered

#: Overlay parts below this many square degrees are residue (fixed value).
CRUMB = 1e-12
#: Samples along each side of a unit's box.
LATTICE = 32
PAIRS = ("a_fid", "b_fid", "shared_area", "coverage_a", "coverage_b", "iou")
#: Classes in display order.
CLASSES = ("unchanged", "renamed", "modified", "relocated", "split", "merge", "complex", "removed", "created")
#: B's nodes follow all of A's in the graph of matches.
_B = 1 << 40


@dataclass(frozen=True)
class ChangeOptions:
    """Thresholds, and how identity counts.

    ``link`` joins matches by code and by name when both are on: ``either`` or ``both``. With
    neither flag, only geometry counts.
    """

    match: float = 0.8
    same: float = 0.98
    by_code: bool = False
    by_name: bool = False
    link: str = "either"

    def __post_init__(self):
        if self.link not in ("either", "both"):
            raise ValueError("link must be 'either' or 'both'")
        if not (0 <= self.match <= 1 and 0 <= self.same <= 1):
            raise ValueError("thresholds must lie between 0 and 1")


def matching_mode(mode: str, code_on_both: bool, name_on_both: bool, **options) -> ChangeOptions:
    """Options for matching by ``geometry``, or by ``identity`` with the attributes that both sides have."""
    identity = mode == "identity"
    return ChangeOptions(by_code=identity and code_on_both, by_name=identity and name_on_both, **options)


def code_expression(columns: list[str]) -> Column:
    """No column gives null, one its text, several their texts one after the other (nulls left out)."""
    cols = [column(c).cast("string") for c in columns]
    return F.lit(None).cast("string") if not cols else cols[0] if len(cols) == 1 else F.concat_ws("", *cols)


def keyed(geom: DataFrame, attrs: DataFrame, codes: list[str], name: str | None) -> DataFrame:
    """(fid, code, name, geom, bbox) of a layer; rows without geometry are left out."""
    register(geom.sparkSession)
    own = attrs.select("fid", code_expression(codes).alias("code"), code_expression([name] if name else []).alias("name"))
    return with_bbox(geom.where("geom is not null").join(own, "fid", "left").select("fid", "code", "name", "geom"))


def planar_area(geom: Column | str) -> Column:
    return geo("area", geom)


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_fid, b_fid, geom): the polygonal common part of every pair that has one.

    Boxes that only touch, as those of all neighbours in a tiling do, have no area in common.
    """
    pairs = bbox_pairs(a.select("fid", "geom", "bbox"), b.select("fid", "geom", "bbox"))
    p, q = F.col("a_bbox"), F.col("b_bbox")
    deep = (F.greatest(p.xmin, q.xmin) < F.least(p.xmax, q.xmax)) & (F.greatest(p.ymin, q.ymin) < F.least(p.ymax, q.ymax))
    # a generator, as a filter on a part would be pushed below and compute it twice
    return pairs.where(deep).select("a_fid", "b_fid", F.explode(geo("common_part", "a_geom", "b_geom", F.lit(CRUMB))).alias("geom"))


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fid, geom): what of each unit of ``a`` no unit of ``b`` covers."""
    pairs = bbox_pairs(a.select("fid", "geom", "bbox"), b.select("fid", "geom", "bbox"), predicate="intersects")
    partners = pairs.groupBy(F.col("a_fid").alias("fid")).agg(union_agg("b_geom").alias("cover"))
    rest = F.when(F.col("cover").isNull(), F.col("geom")).otherwise(polygonal(geo("difference", "geom", "cover")))
    return a.join(partners, "fid", "left").select("fid", rest.alias("geom")).where(geo("area", "geom") >= CRUMB)


def _ratios(shared: DataFrame, a: DataFrame, b: DataFrame, area) -> DataFrame:
    own = [x.select(F.col("fid").alias(f"{n}_fid"), area("geom").alias(f"area_{n}")) for n, x in (("a", a), ("b", b))]
    s, p, q = F.col("shared_area"), F.col("area_a"), F.col("area_b")
    return shared.join(own[0], "a_fid").join(own[1], "b_fid").select(
        "a_fid", "b_fid", "shared_area", (s / F.nullif(p, F.lit(0.0))).alias("coverage_a"), (s / F.nullif(q, F.lit(0.0))).alias("coverage_b"), (s / F.nullif(p + q - s, F.lit(0.0))).alias("iou")
    )


def exact_pairs(a: DataFrame, b: DataFrame, area=equal_earth_area) -> DataFrame:
    """The pair table by overlay: shared area (by default in square metres), coverage of either unit, and IoU."""
    shared = overlay(a, b).groupBy("a_fid", "b_fid").agg(F.sum(area("geom")).alias("shared_area"))
    return _ratios(shared, a, b, area)


def sample_points(a: DataFrame, lattice: int = LATTICE) -> DataFrame:
    """(fid, x, y): the centres of a lattice over each unit's box that lie within it, and one point on its surface."""
    box, n = F.col("bbox"), F.lit(lattice)
    steps = F.sequence(F.lit(0), F.lit(lattice * lattice - 1))
    xs = F.transform(steps, lambda i: box.xmin + (i % n + 0.5) * (box.xmax - box.xmin) / n)
    ys = F.transform(steps, lambda i: box.ymin + (F.floor(i / n) + 0.5) * (box.ymax - box.ymin) / n)
    own = a.where("geom is not null and bbox is not null").select("fid", "geom", xs.alias("xs"), ys.alias("ys"), geo("point_on_surface", "geom").alias("p"))
    own = own.withColumn("inside", geo("points_within", "xs", "ys", "geom"))
    kept = F.filter(F.arrays_zip("xs", "ys", "inside"), lambda z: z["inside"])
    extra = F.array(F.struct(geo("x", "p").alias("x"), geo("y", "p").alias("y")))
    every = F.concat(F.transform(kept, lambda z: F.struct(z["xs"].alias("x"), z["ys"].alias("y"))), extra)
    return own.select("fid", F.explode(every).alias("p")).select("fid", "p.x", "p.y")


def _sampled(x: DataFrame, lattice: int, area) -> DataFrame:
    """(fid, geom, bbox, lattice, n, area): a unit with what its sample points are drawn from, their number, and its area."""
    box, p = F.col("bbox"), geo("point_on_surface", "geom")
    corners = [box.xmin, box.ymin, box.xmax, box.ymax]
    # dealt anew, as a file may hold all units in a few row groups
    own = x.where("geom is not null and bbox is not null").select("fid", "geom", "bbox").repartition("fid")
    own = own.select("fid", "geom", "bbox", F.array(*corners, geo("x", p), geo("y", p)).alias("lattice"), area("geom").alias("area"))
    # a unit stands in up to four cells and has many partners, and is to be counted once
    return cut(own.withColumn("n", geo("samples", "geom", "lattice", F.lit(lattice))))


def sampled_pairs(a: DataFrame, b: DataFrame, lattice: int = LATTICE, area=equal_earth_area) -> DataFrame:
    """The pair table estimated from sample points of both sides; the shared area is A's coverage times A's area, or else B's.

    Units whose boxes meet are joined, not points: a pair draws the points of its two units and
    counts those that lie in the other one, so that no point is ever a row.
    """
    register(a.sparkSession)
    pairs = bbox_pairs(_sampled(a, lattice, area), _sampled(b, lattice, area))
    # a generator, as a filter on the hits would be pushed below and count them twice
    hits = F.explode(geo("sample_hits", "a_geom", "a_lattice", "b_geom", "b_lattice", F.lit(lattice)))
    rows = pairs.select("a_fid", "b_fid", F.col("a_area").alias("area_a"), F.col("b_area").alias("area_b"), "a_n", "b_n", hits.alias("hits"))
    rows = rows.withColumn("cov_a", F.col("hits.a") / F.col("a_n")).withColumn("cov_b", F.col("hits.b") / F.col("b_n"))
    shared = F.col("cov_a") * F.col("area_a")
    return rows.select("a_fid", "b_fid", shared.alias("shared_area"), F.col("cov_a").alias("coverage_a"), F.col("cov_b").alias("coverage_b"), (shared / F.nullif(F.col("area_a") + F.col("area_b") - shared, F.lit(0.0))).alias("iou"))


def measured_pairs(a: DataFrame, b: DataFrame, method: str = "auto") -> tuple[DataFrame, str]:
    """The pair table, and whether it is ``exact`` or from ``sampling``; ``auto`` samples only if the overlay fails."""
    if method in ("exact", "auto"):
        try:
            return cut(exact_pairs(a, b)), "exact"
        except Exception as e:
            if method == "exact" or not computation_failed(e):
                raise
    return cut(sampled_pairs(a, b)), "sampling"


def unique_values(side: DataFrame, column: str) -> DataFrame:
    """The values of a column that one row alone has; nulls are left out."""
    return side.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(column)


def identity_match(a: DataFrame, b: DataFrame, pairs: DataFrame, options: ChangeOptions) -> DataFrame:
    """The pair table with ``identity``: equal in code or name (as the options say), by values that are unique on both sides."""
    out = pairs
    tests = []
    for column, on in (("code", options.by_code), ("name", options.by_name)):
        if on:
            good = unique_values(a, column).join(unique_values(b, column), column)
            same = a.select(column, F.col("fid").alias("a_fid")).join(good, column).join(b.select(column, F.col("fid").alias("b_fid")), column)
            out = out.join(same.select("a_fid", "b_fid", F.lit(True).alias(f"_{column}")), ["a_fid", "b_fid"], "left")
            tests.append(F.coalesce(F.col(f"_{column}"), F.lit(False)))
    match = F.lit(False)
    if tests:
        match = tests[0] if len(tests) == 1 else (tests[0] & tests[1]) if options.link == "both" else (tests[0] | tests[1])
    return out.withColumn("identity", match).drop("_code", "_name")


def claims(marked: DataFrame, options: ChangeOptions) -> DataFrame:
    """(a_fid, b_fid): the identity pairs that are settled before geometry.

    Such a pair is claimed if every other spatial neighbour of either unit has an identity
    match of its own. Where two claims want one unit (code and name may point to different
    partners), the lower (a_fid, b_fid) goes first; only those conflicts, which are paths of
    few units, are taken one after the other.
    """
    marked = marked.withColumn("spatial", F.greatest("coverage_a", "coverage_b") >= options.match)
    has_a = marked.where("identity").select("a_fid", F.lit(True).alias("a_has")).distinct()
    has_b = marked.where("identity").select("b_fid", F.lit(True).alias("b_has")).distinct()
    near = marked.where("spatial").join(has_a, "a_fid", "left").join(has_b, "b_fid", "left")
    # neighbours without an identity match stand against a unit; at most one of them may be the partner, which has one
    lone_b = near.where("b_has is null").select("a_fid").distinct()
    lone_a = near.where("a_has is null").select("b_fid").distinct()
    good = marked.where("identity").join(lone_b, "a_fid", "left_anti").join(lone_a, "b_fid", "left_anti").select("a_fid", "b_fid")
    if not (options.by_code and options.by_name and options.link == "either"):
        return good
    for n in "ab":
        good = good.join(good.groupBy(f"{n}_fid").agg(F.count(F.lit(1)).alias(f"_{n}")), f"{n}_fid")
    good = cut(good.select("a_fid", "b_fid", ((F.col("_a") > 1) | (F.col("_b") > 1)).alias("tangled")))
    clear, tangled = good.where("not tangled").select("a_fid", "b_fid"), good.where("tangled").select("a_fid", "b_fid")
    found = components(tangled.select(F.col("a_fid").alias("a"), (F.col("b_fid") + _B).alias("b"))).withColumnRenamed("node", "a_fid")
    dealt = tangled.join(found, "a_fid")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, out = set(), set(), []
        for p, q in sorted(zip(rows["a_fid"], rows["b_fid"])):
            if p not in left and q not in right:
                left.add(p)
                right.add(q)
                out.append((p, q))
        return pd.DataFrame(out, columns=["a_fid", "b_fid"])

    return clear.unionByName(dealt.select("a_fid", "b_fid", "component").groupBy("component").applyInPandas(greedy, "a_fid long, b_fid long"))


@dataclass
class Change:
    """All results of a comparison; each is a DataFrame."""

    pairs: DataFrame  # PAIRS, cluster_id, relationship_class, match_method
    units: DataFrame  # side, fid, cluster_id, relationship_class
    changelog: DataFrame
    options: ChangeOptions


def classify(a: DataFrame, b: DataFrame, pairs: DataFrame, options: ChangeOptions = ChangeOptions()) -> Change:
    """Clusters of matched units and their classes, from a pair table; run it again on the same pairs for other options."""
    marked = cut(identity_match(a, b, pairs.select(*PAIRS), options))
    claimed = cut(claims(marked, options).withColumn("claimed", F.lit(True)))
    taken = [claimed.select(f"{n}_fid").distinct() for n in "ab"]
    passing = F.greatest("coverage_a", "coverage_b") >= options.match
    first = marked.join(claimed, ["a_fid", "b_fid"]).withColumn("rescued", ~F.coalesce(passing, F.lit(False)))
    rest = marked.where(passing).join(taken[0], "a_fid", "left_anti").join(taken[1], "b_fid", "left_anti").withColumn("claimed", F.lit(False)).withColumn("rescued", F.lit(False))
    edges = cut(first.unionByName(rest))

    nodes = a.select(F.lit("a").alias("side"), "fid", F.col("fid").alias("node")).union(b.select(F.lit("b"), "fid", F.col("fid") + _B))
    found = components(edges.select(F.col("a_fid").alias("a"), (F.col("b_fid") + _B).alias("b")))
    nodes = cut(nodes.join(found, "node", "left").select("side", "fid", F.coalesce("component", "node").alias("component")))
    # in the order in which the first member appears, A's before B's
    ids = numbered(nodes.select("component").distinct(), "cluster_id", "component")
    nodes = nodes.join(ids, "component").select("side", "fid", F.col("cluster_id").cast("int").alias("cluster_id"))
    in_a = nodes.where("side = 'a'").select(F.col("fid").alias("a_fid"), "cluster_id")
    linked = edges.join(in_a, "a_fid")

    names = [x.select(F.col("fid").alias(f"{n}_fid"), F.col("code").alias(f"code_{n}"), F.col("name").alias(f"name_{n}")) for n, x in (("a", a), ("b", b))]
    changed = F.lit(False)
    for column, on in (("code", options.by_code), ("name", options.by_name)):
        if on:
            changed = changed | F.coalesce(F.col(f"{column}_a") != F.col(f"{column}_b"), F.lit(False))
    facts = linked.join(names[0], "a_fid", "left").join(names[1], "b_fid", "left").groupBy("cluster_id")
    facts = facts.agg(F.max("iou").alias("best"), F.bool_and("rescued").alias("all_rescued"), F.bool_or(changed).alias("attr_changed"))
    sizes = nodes.groupBy("cluster_id").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    kind = (
        F.when(F.col("n_b") == 0, "removed").when(F.col("n_a") == 0, "created")
        .when((F.col("n_a") == 1) & (F.col("n_b") == 1), F.when(F.col("all_rescued"), "relocated").when((F.col("best") >= options.same) & F.col("attr_changed"), "renamed").when(F.col("best") >= options.same, "unchanged").otherwise("modified"))
        .when(F.col("n_a") == 1, "split").when(F.col("n_b") == 1, "merge").otherwise("complex")
    )
    classes = cut(sizes.join(facts, "cluster_id", "left").select("cluster_id", kind.alias("relationship_class")))
    units = nodes.join(classes, "cluster_id").select("side", "fid", "cluster_id", "relationship_class")
    own = linked.select("a_fid", "b_fid", "cluster_id", F.when(F.col("rescued"), "identity").otherwise("spatial").alias("match_method")).join(classes, "cluster_id")
    rows = pairs.select(*PAIRS).join(own, ["a_fid", "b_fid"], "left").select(*PAIRS, "cluster_id", "relationship_class", "match_method")
    return Change(rows, units, _changelog(rows, units, names, options), options)


def _changelog(pairs: DataFrame, units: DataFrame, names: list[DataFrame], options: ChangeOptions) -> DataFrame:
    linked = pairs.where("match_method is not null").join(names[0], "a_fid", "left").join(names[1], "b_fid", "left")
    none = F.lit(None)

    def ratio(c: str) -> Column:
        return F.round(c, 3)

    cols = ["code_a", "name_a", "code_b", "name_b", "relationship_class", "match_method", "a_in_b", "b_in_a", "similarity"]
    rows = linked.select("code_a", "name_a", "code_b", "name_b", "relationship_class", "match_method", ratio("coverage_a").alias("a_in_b"), ratio("coverage_b").alias("b_in_a"), ratio("iou").alias("similarity"))
    for n, kind in (("a", "removed"), ("b", "created")):
        other = "b" if n == "a" else "a"
        lone = units.where((F.col("side") == n) & (F.col("relationship_class") == kind)).withColumnRenamed("fid", f"{n}_fid").join(names[0] if n == "a" else names[1], f"{n}_fid", "left")
        lone = lone.withColumn(f"code_{other}", none.cast("string")).withColumn(f"name_{other}", none.cast("string")).withColumn("match_method", none.cast("string"))
        for c in ("a_in_b", "b_in_a", "similarity"):
            lone = lone.withColumn(c, none.cast("double"))
        rows = rows.unionByName(lone.select(*cols))
    mode = options.link if options.by_code and options.by_name else None
    rows = rows.select(
        *cols, F.lit(options.match).alias("threshold_match"), F.lit(options.same).alias("threshold_unchanged"), F.lit(options.by_code).alias("link_by_code"), F.lit(options.by_name).alias("link_by_name"), F.lit(mode).cast("string").alias("link_mode")
    )
    return rows.orderBy("relationship_class", F.asc_nulls_last("code_a"), F.asc_nulls_last("code_b"))


def compare(a: DataFrame, b: DataFrame, options: ChangeOptions = ChangeOptions(), method: str = "auto") -> tuple[Change, str]:
    """Compares two keyed layers; returns the results and the method that measured the pairs."""
    pairs, used = measured_pairs(a, b, method)
    if used == "sampling" and options.same > 0.99:
        raise ValueError("a sampled comparison cannot tell similarities above 0.99 apart")
    return classify(a, b, pairs, options), used


def table_rows(change: Change, a: DataFrame, b: DataFrame) -> DataFrame:
    """Matched pairs and single units with their names, by cluster and codes (null as empty)."""
    names = [x.select(F.col("fid").alias(f"{n}_fid"), F.col("code").alias(f"{n}_code"), F.col("name").alias(f"{n}_name")) for n, x in (("a", a), ("b", b))]
    cols = ["cluster_id", "relationship_class", "match_method", "a_fid", "b_fid", "coverage_a", "coverage_b", "iou"]
    rows = change.pairs.where("match_method is not null").select(*cols)
    for n, kind in (("a", "removed"), ("b", "created")):
        lone = change.units.where((F.col("side") == n) & (F.col("relationship_class") == kind))
        own = {f"{n}_fid": F.col("fid"), "cluster_id": F.col("cluster_id"), "relationship_class": F.col("relationship_class")}
        rows = rows.unionByName(lone.select(*[own.get(c, F.lit(None).cast("string" if c == "match_method" else "long" if c.endswith("fid") else "double")).alias(c) for c in cols]))
    rows = rows.join(names[0], "a_fid", "left").join(names[1], "b_fid", "left").select(*cols, "a_code", "a_name", "b_code", "b_name")
    return rows.orderBy("cluster_id", F.coalesce("a_code", F.lit("")), F.coalesce("b_code", F.lit("")))


def visible_rows(rows: DataFrame, classes: list[str], search: str = "") -> DataFrame:
    """The rows of given classes whose codes and names hold a text (in any case), in display order, with the side that spans a cluster's rows."""
    text = F.lower(F.concat_ws(" ", "a_code", "a_name", "b_code", "b_name"))
    kept = rows.where(F.col("relationship_class").isin(*classes) & text.contains(search.strip().lower()))
    sides = kept.groupBy("cluster_id").agg(F.countDistinct("a_fid").alias("na"), F.countDistinct("b_fid").alias("nb"))
    span = F.when((F.col("na") == 1) & (F.col("nb") > 1), "a").when((F.col("nb") == 1) & (F.col("na") > 1), "b")
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("relationship_class"))
    return kept.join(sides.select("cluster_id", span.alias("span_side")), "cluster_id").orderBy(place, "cluster_id", F.coalesce("a_code", F.lit("")), F.coalesce("b_code", F.lit("")))


def cluster_summary(change: Change) -> DataFrame:
    """Clusters of each class."""
    return change.units.groupBy("relationship_class").agg(F.countDistinct("cluster_id").alias("clusters"))


def render_layer(change: Change, a: DataFrame, b: DataFrame) -> DataFrame:
    """Every unit of B and the removed ones of A, as multipolygons with class and side."""
    out = None
    for n, side, units in (("b", b, change.units.where("side = 'b'")), ("a", a, change.units.where("side = 'a' and relationship_class = 'removed'"))):
        rows = units.join(side.select("fid", "geom"), "fid").select(
            "cluster_id", "relationship_class", F.lit(n).alias("piece_side"), (F.col("fid") if n == "a" else F.lit(None).cast("long")).alias("a_fid"), (F.col("fid") if n == "b" else F.lit(None).cast("long")).alias("b_fid"), geo("multi", "geom").alias("geom")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def outlines(change: Change, side: str, layer: DataFrame) -> DataFrame:
    """(fid, cluster_id, relationship_class, side, geom) of all units of a side."""
    own = change.units.where(F.col("side") == side).select("fid", "cluster_id", "relationship_class", "side")
    return layer.select("fid", "geom").join(own, "fid", "left").select("fid", "cluster_id", "relationship_class", F.lit(side).alias("side"), "geom")


