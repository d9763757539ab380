"""Topology problems of a polygon coverage, its repair, and edits of single vertices."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import geo, polygonal, register, union_agg
from tessella.functions.units import degrees_to_m, m2_to_square_degrees, metres_to_degrees, nice_number, square_degrees_to_m2
from tessella.operators.components import components
from tessella.operators.spatial_join import bbox_pairs, spatial_join, with_bbox
from tessella.session import computation_failed, cut, numbered

#: Regions of up to a square centimetre are residue; the grid that a failing layer is snapped to; undo steps kept (fixed values).
LEAST_AREA_M2, REDUCED_GRID, UNDO_STEPS = 1e-4, 1e-10, 20
GAP_SCHEMA = "n long, geom binary"
OVERLAP_SCHEMA = "n long, fa long, fb long, geom binary"
SLIVER_SCHEMA = "n long, geom binary, area_deg2 double, mic_radius_deg double, xmin double, ymin double, xmax double, ymax double"


class CleanError(RuntimeError):
    """A failure, with the number of the stage that failed."""

    def __init__(self, message: str, stage: int):
        super().__init__(message)
        self.stage = stage


def frozen(layer: DataFrame) -> DataFrame:
    """(fid, geom, bbox) of the rows that have a shape."""
    register(layer.sparkSession)
    return with_bbox(layer.select("fid", "geom").where(F.col("geom").isNotNull() & ~geo("is_empty", "geom")))


def bounds(layer: DataFrame) -> tuple[float, float, float, float] | None:
    """xmin, ymin, xmax, ymax of a layer, or None if nothing has a place."""
    register(layer.sparkSession)
    box = with_bbox(layer).agg(F.min("bbox.xmin"), F.min("bbox.ymin"), F.max("bbox.xmax"), F.max("bbox.ymax")).first()
    return None if box[0] is None else tuple(box)


def latitude_of(box: tuple[float, float, float, float] | None) -> float:
    return (box[1] + box[3]) / 2 if box else 0.0


def reduced(layer: DataFrame) -> DataFrame:
    """The layer snapped to a grid of 1e-10 degrees and made valid: what is tried when an overlay fails."""
    return layer.select("fid", geo("make_valid", geo("reduce_precision", "geom", F.lit(REDUCED_GRID))).alias("geom")).transform(with_bbox)


def _grouped_union(layer: DataFrame) -> DataFrame:
    """(component, geom): the union of every group of units that touch.

    Units that touch nothing in common cannot enclose a gap together, so groups are taken apart
    first. Within a group a first union joins the units of a neighbourhood, a second the rest.
    """
    pairs = bbox_pairs(layer, layer, ordered=True, predicate="intersects").select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))
    found = components(pairs).withColumnRenamed("node", "fid")
    own = layer.join(found, "fid", "left").withColumn("component", F.coalesce("component", "fid"))
    tile = F.xxhash64(F.floor(F.col("bbox.xmin") * 4), F.floor(F.col("bbox.ymin") * 4))
    near = own.groupBy("component", tile.alias("tile")).agg(union_agg("geom").alias("geom"))
    return near.groupBy("component").agg(union_agg("geom").alias("geom"))


def gap_regions(layer: DataFrame, latitude: float = 0.0) -> DataFrame:
    """(n, geom): areas that the coverage encloses without covering them; gaps with an outlet don't count."""
    parts = _grouped_union(layer).select("component", F.explode(geo("parts", "geom")).alias("part"))
    holes = parts.where(geo("count_of", "part", F.lit("rings")) > 0).select("component", F.explode(geo("parts", geo("difference", geo("filled", "part"), "part"))).alias("geom"))
    # a group of units inside a hole of another fills it, wholly or in part
    inner = _filled_from_within(holes, layer)
    kept = inner.where(geo("area", "geom") > m2_to_square_degrees(LEAST_AREA_M2, latitude)).withColumn("bbox", geo("bbox", "geom"))
    return numbered(kept, "n", F.col("bbox.xmin"), F.col("bbox.ymin"), F.col("bbox.xmax"), F.col("bbox.ymax")).select("n", "geom")


def _filled_from_within(holes: DataFrame, layer: DataFrame) -> DataFrame:
    holes = cut(numbered(with_bbox(holes), "fid", "component", F.col("bbox.xmin"), F.col("bbox.ymin")).select("fid", "geom", "bbox"))
    hit = bbox_pairs(holes, layer.select("fid", "geom", "bbox"), predicate="intersects").groupBy(F.col("a_fid").alias("fid")).agg(union_agg("b_geom").alias("cover"))
    rest = holes.join(hit, "fid", "left").select(F.when(F.col("cover").isNull(), F.col("geom")).otherwise(polygonal(geo("difference", "geom", "cover"))).alias("geom"))
    return rest.select(F.explode(geo("parts", "geom")).alias("geom"))


def overlap_regions(layer: DataFrame, latitude: float = 0.0) -> DataFrame:
    """(n, fa, fb, geom): the polygonal common part of every two units, one row for each pair."""
    pairs = bbox_pairs(layer, layer, ordered=True, predicate="intersects")
    common = pairs.select(F.col("a_fid").alias("fa"), F.col("b_fid").alias("fb"), polygonal(geo("intersection", "a_geom", "b_geom")).alias("geom"))
    kept = common.where(~geo("is_empty", "geom") & (geo("area", "geom") > m2_to_square_degrees(LEAST_AREA_M2, latitude)))
    return numbered(kept, "n", "fa", "fb").select("n", "fa", "fb", "geom")


def invalid_edges(layer: DataFrame, width: float = 0.0) -> DataFrame:
    """(fid, geom): the edges of each unit where it overlaps or misses its neighbours, or leaves a gap narrower than ``width`` degrees."""
    pairs = bbox_pairs(layer, layer, reach=width).where("a_fid != b_fid")
    near = pairs.groupBy(F.col("a_fid").alias("fid")).agg(F.collect_list("b_geom").alias("others"))
    found = layer.join(near, "fid").select("fid", geo("invalid_edges", "geom", "others", F.lit(float(width))).alias("geom"))
    return found.where("geom is not null")


def sliver_regions(layer: DataFrame, gaps: DataFrame, overlaps: DataFrame, tolerance_m: float, latitude: float = 0.0) -> DataFrame:
    """(n, geom, area_deg2, mic_radius_deg, xmin, ymin, xmax, ymax): near misses, as lines, the longest first.

    Invalid edges are clustered by buffers of the tolerance that touch; what lies near an
    overlap or a gap is theirs and is left out. A tolerance of 0 or less finds none.
    """
    spark = layer.sparkSession
    if tolerance_m <= 0:
        return spark.createDataFrame([], SLIVER_SCHEMA)
    tol = metres_to_degrees(tolerance_m, latitude)
    edges = with_bbox(invalid_edges(layer, tol))
    edges = cut(edges.withColumn("area", geo("buffer", "geom", F.lit(tol))).select("fid", "geom", "area"))
    zones = with_bbox(edges.select("fid", F.col("area").alias("geom")))
    touching = bbox_pairs(zones, zones, ordered=True, predicate="intersects").select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))
    found = components(touching).withColumnRenamed("node", "fid")
    own = edges.join(found, "fid", "left").withColumn("component", F.coalesce("component", "fid"))
    groups = own.groupBy("component").agg(union_agg("geom").alias("lines"), union_agg("area").alias("zone"))
    clusters = groups.select("lines", F.explode(geo("parts", "zone")).alias("zone"))
    lines = clusters.select(geo("intersection", "lines", "zone").alias("geom"))
    lines = cut(numbered(with_bbox(lines), "fid", F.col("bbox.xmin"), F.col("bbox.ymin"), F.col("bbox.xmax"), F.col("bbox.ymax")))
    for mask in (overlaps, gaps):
        zone = with_bbox(mask.select(F.col("n").alias("fid"), geo("buffer", "geom", F.lit(tol)).alias("geom")))
        hit = bbox_pairs(lines, zone, predicate="intersects").groupBy(F.col("a_fid").alias("fid")).agg(union_agg("b_geom").alias("zone"))
        lines = lines.join(hit, "fid", "left").select("fid", F.when(F.col("zone").isNull(), F.col("geom")).otherwise(geo("difference", "geom", "zone")).alias("geom"))
        lines = cut(with_bbox(lines.where(~geo("is_empty", "geom"))))
    lines = lines.withColumn("length", geo("length", "geom")).where("length > 0")
    out = numbered(lines, "n", F.desc("length"), "fid")
    return out.select("n", "geom", F.lit(0.0).alias("area_deg2"), F.lit(0.0).alias("mic_radius_deg"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")


def issues(gaps: DataFrame, overlaps: DataFrame, slivers: DataFrame, latitude: float = 0.0) -> DataFrame:
    """All problems in one table: overlaps by width, the widest first, gaps by width, the narrowest first, then slivers."""

    def region(df: DataFrame, kind: str, fa: Column, fb: Column) -> DataFrame:
        d = with_bbox(df).withColumn("area_deg", geo("area", "geom")).withColumn("mic_radius_deg", geo("inscribed_circle", "geom").radius)
        return d.select(
            F.concat(F.lit(f"{kind}-"), F.col("n")).alias("key"), F.lit(kind).alias("kind"), "area_deg", "mic_radius_deg",
            square_degrees_to_m2(F.col("area_deg"), latitude).alias("area_m2"), degrees_to_m(F.col("mic_radius_deg") * 2).alias("max_width_m"),
            fa.cast("long").alias("unit_a"), fb.cast("long").alias("unit_b"), "geom", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax",
        )

    none, empty = F.lit(None).cast("long"), F.lit(None).cast("double")
    lines = slivers.select(
        F.concat(F.lit("sliver-"), F.col("n")).alias("key"), F.lit("sliver").alias("kind"), F.col("area_deg2").alias("area_deg"), "mic_radius_deg",
        empty.alias("area_m2"), empty.alias("max_width_m"), none.alias("unit_a"), none.alias("unit_b"), "geom", "xmin", "ymin", "xmax", "ymax",
    )
    rows = region(overlaps, "overlap", F.col("fa"), F.col("fb")).unionByName(region(gaps, "gap", none, none)).unionByName(lines)
    return rows.orderBy(*issue_order())


def issue_order() -> list[Column]:
    rank = F.when(F.col("kind") == "overlap", 0).when(F.col("kind") == "gap", 1).otherwise(2)
    width = F.when(F.col("kind") == "overlap", -F.col("max_width_m")).when(F.col("kind") == "gap", F.col("max_width_m"))
    return [rank, width.asc_nulls_last(), F.length("key"), F.col("key")]


def clean_coverage(layer: DataFrame, gap_deg: float = 0.0, snap: float = -1.0) -> DataFrame:
    """(fid, geom): the repaired coverage. Overlaps go to the owner with the longest border, gaps up to a width to their neighbour; units that collapse are gone.

    Groups of units that touch, or come within the gap width, are repaired on their own, each
    in one task; so a group has to fit into a task's memory.
    """
    near = max(gap_deg, 0.0)
    pairs = bbox_pairs(layer, layer, reach=near, ordered=True)
    pairs = pairs.where(geo("dwithin", "a_geom", "b_geom", F.lit(float(near)))).select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))
    found = components(pairs).withColumnRenamed("node", "fid")
    own = layer.join(found, "fid", "left").withColumn("component", F.coalesce("component", "fid"))
    lists = own.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("fid", "geom"))).alias("units"))
    done = lists.select("units", geo("coverage_clean", F.col("units.geom"), F.lit(float(snap)), F.lit(float(gap_deg))).alias("cleaned"))
    rows = done.select(F.explode(F.arrays_zip(F.col("units.fid").alias("fid"), F.col("cleaned").alias("geom"))).alias("u")).select("u.fid", "u.geom")
    return rows.where(F.col("geom").isNotNull() & ~geo("is_empty", "geom")).select("fid", geo("make_valid", "geom").alias("geom"))


def fixed_keys(found: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(key): the issues that the repair settled: all overlaps, no slivers, and gaps that a unit covers now."""
    gaps = numbered(found.where("kind = 'gap'").select("key", geo("point_on_surface", "geom").alias("geom")), "fid", "key")
    covered = spatial_join(gaps, cleaned.select("fid", "geom"), "within", how="semi")
    return found.where("kind = 'overlap'").select("key").union(covered.select("key"))


@dataclass
class ExportCheck:
    """What is left to find in a repaired layer; ``failed`` if that could not be told."""

    rows: int
    invalid: int
    gaps: int
    overlaps: int
    failed: bool = False


def export_check(cleaned: DataFrame, latitude: float = 0.0) -> ExportCheck:
    own = frozen(cleaned)
    counts = own.agg(F.count(F.lit(1)), F.count_if(~geo("is_valid", "geom"))).first()
    out = ExportCheck(counts[0], counts[1], 0, 0)
    for name, detect in (("gaps", gap_regions), ("overlaps", overlap_regions)):
        rows, ok = _attempt(lambda layer, f=detect: f(layer, latitude), own, GAP_SCHEMA)
        setattr(out, name, rows.count())
        out.failed |= not ok
    return out


def _attempt(detect, layer: DataFrame, schema: str) -> tuple[DataFrame, bool]:
    """A detector's rows; if shapes make it fail, those on reduced precision, and then none. Other errors, such as lost executors, are not caught."""
    for source in (lambda: layer, lambda: reduced(layer)):
        try:
            return cut(detect(source())), True
        except Exception as e:
            if not computation_failed(e):
                raise
    return layer.sparkSession.createDataFrame([], schema), False


@dataclass
class CleanResult:
    issues: DataFrame
    cleaned: DataFrame
    fixed: DataFrame
    check: ExportCheck
    bounds: tuple | None
    gap_width_m: float
    total: int
    kept: int
    failed_kinds: frozenset = frozenset()

    @property
    def collapsed(self) -> int:
        return max(0, self.total - self.kept)


@dataclass
class CleanSession:
    """A layer under repair: what was found in it, and earlier states for undo."""

    layer: DataFrame
    undo_stack: list[DataFrame] = field(default_factory=list)
    gaps: DataFrame | None = None
    overlaps: DataFrame | None = None
    latitude: float = 0.0
    failed: frozenset = frozenset()

    def run(self, sliver_tolerance_m: float = 10.0) -> CleanResult:
        """Everything from the start. The gap width is chosen from the gaps found: a round number of at least twice the widest."""
        own = cut(frozen(self.layer))
        if not own.count():
            raise CleanError("No polygons found to clean.", 2)
        box = bounds(own)
        self.latitude = latitude_of(box)
        self.gaps, ok_gaps = _attempt(lambda x: gap_regions(x, self.latitude), own, GAP_SCHEMA)
        self.overlaps, ok_overlaps = _attempt(lambda x: overlap_regions(x, self.latitude), own, OVERLAP_SCHEMA)
        self.failed = frozenset(k for k, ok in (("gap", ok_gaps), ("overlap", ok_overlaps)) if not ok)
        widest = self.gaps.select(F.max(degrees_to_m(geo("inscribed_circle", "geom").radius * 2))).first()[0]
        return self._finish(own, box, nice_number(2 * widest) if widest and widest > 0 else 0.0, sliver_tolerance_m)

    def reclean(self, gap_width_m: float, sliver_tolerance_m: float) -> CleanResult:
        """Slivers and repair for other settings; gaps and overlaps are those found before."""
        if self.gaps is None:
            raise CleanError("Run a full clean first.", 1)
        own = cut(frozen(self.layer))
        return self._finish(own, bounds(own), gap_width_m, sliver_tolerance_m)

    def _finish(self, own: DataFrame, box, gap_width_m: float, tolerance_m: float) -> CleanResult:
        def slivers_of(layer: DataFrame) -> DataFrame:
            return sliver_regions(layer, self.gaps, self.overlaps, tolerance_m, self.latitude)

        slivers, ok = _attempt(slivers_of, own, SLIVER_SCHEMA)
        gap_deg = metres_to_degrees(gap_width_m, self.latitude)
        try:
            cleaned = cut(clean_coverage(own, gap_deg))
        except Exception as e:
            if not computation_failed(e):
                raise
            cleaned = cut(clean_coverage(cut(reduced(own)), gap_deg))
        if not ok:
            slivers, ok = _attempt(slivers_of, frozen(cleaned), SLIVER_SCHEMA)
        found = cut(issues(self.gaps, self.overlaps, slivers, self.latitude))
        failed = self.failed | (frozenset() if ok else {"sliver"})
        return CleanResult(found, cleaned, fixed_keys(found, cleaned), export_check(cleaned, self.latitude), box, gap_width_m, own.count(), cleaned.count(), failed)

    def pinch(self, xmin: float, ymin: float, xmax: float, ymax: float) -> int:
        """Moves all vertices in a box to their mean; returns how many moved."""
        return self._edit(pinch_vertices, (xmin, ymin, xmax, ymax))

    def delete(self, xmin: float, ymin: float, xmax: float, ymax: float) -> int:
        """Removes all vertices in a box; returns how many went."""
        return self._edit(delete_vertices, (xmin, ymin, xmax, ymax))

    def _edit(self, edit, box) -> int:
        changed, n = edit(self.layer, box)
        self.undo_stack = [*self.undo_stack, self.layer][-UNDO_STEPS:]
        self.layer = changed
        return n

    def undo(self) -> bool:
        if not self.undo_stack:
            return False
        self.layer = self.undo_stack.pop()
        return True


def _in_box(p: Column, box) -> Column:
    return p.x.between(box[0], box[2]) & p.y.between(box[1], box[3])


def _apply(layer: DataFrame, edited: DataFrame, moved: int, what: str) -> tuple[DataFrame, int]:
    edited = cut(edited)
    bad = edited.where(F.col("geom").isNotNull() & (~geo("is_valid", "geom") | geo("is_empty", "geom"))).count()
    if not moved:
        raise CleanError(f"No vertices in the box to {what}.", 0)
    if bad:
        raise CleanError(f"To {what} these vertices would leave an invalid polygon.", 0)
    new = edited.where("geom is not null").select("fid", F.col("geom").alias("_new"))
    out = layer.drop("bbox").join(new, "fid", "left").withColumn("geom", F.coalesce("_new", "geom")).drop("_new")
    return cut(out), moved


def _boxed(layer: DataFrame, box) -> DataFrame:
    register(layer.sparkSession)
    own = with_bbox(layer.select("fid", "geom").where("geom is not null"))
    b = F.col("bbox")
    near = own.where((b.xmin <= box[2]) & (b.xmax >= box[0]) & (b.ymin <= box[3]) & (b.ymax >= box[1]))
    return near.select("fid", F.explode(geo("rings", "geom")).alias("r")).select("fid", "r.part", "r.ring", F.col("r.points").alias("points"))


def _rebuild(rings: DataFrame) -> DataFrame:
    ring = F.struct("part", "ring", "points")
    return rings.groupBy("fid").agg(F.sort_array(F.collect_list(ring)).alias("rings")).select("fid", geo("from_rings", "rings").alias("geom"))


def vertices_in_box(layer: DataFrame, box) -> DataFrame:
    """(fid, part, ring, x, y) of the vertices in a box, closing ones included."""
    return _boxed(layer, box).select("fid", "part", "ring", F.explode("points").alias("p")).where(_in_box(F.col("p"), box)).select("fid", "part", "ring", "p.x", "p.y")


def pinch_vertices(layer: DataFrame, box) -> tuple[DataFrame, int]:
    """Vertices in the box meet at their mean (closing ones count); repeated ones go. The layer is left alone if nothing is in the box or a shape would become invalid."""
    rings = cut(_boxed(layer, box))
    at = rings.select(F.explode("points").alias("p")).where(_in_box(F.col("p"), box)).agg(F.avg("p.x"), F.avg("p.y"), F.count(F.lit(1))).first()
    anchor = F.struct(F.lit(at[0]).cast("double").alias("x"), F.lit(at[1]).cast("double").alias("y"))
    moved = F.transform("points", lambda p: F.when(_in_box(p, box), anchor).otherwise(p))
    kept = F.filter(moved, lambda p, i: (i == 0) | (p != F.element_at(moved, F.greatest(i, F.lit(1)))))
    touched = rings.where(F.exists("points", lambda p: _in_box(p, box))).select("fid").distinct()
    return _apply(layer, _rebuild(rings.join(touched, "fid", "left_semi").withColumn("points", kept)), at[2], "pinch")


def delete_vertices(layer: DataFrame, box) -> tuple[DataFrame, int]:
    """Vertices in the box go; rings of under three points and parts without an exterior go with them, but a unit that would vanish stays as it is."""
    rings = cut(_boxed(layer, box))
    size = F.size("points")
    closed = (size > 1) & (F.element_at("points", 1) == F.element_at("points", -1))
    own = F.when(closed, F.slice("points", F.lit(1), F.greatest(size - 1, F.lit(1)))).otherwise(F.col("points"))
    rings = rings.withColumn("own", own)
    gone = rings.select(F.sum(F.size(F.filter("own", lambda p: _in_box(p, box))))).first()[0] or 0
    kept = rings.withColumn("own", F.filter("own", lambda p: ~_in_box(p, box)))
    touched = rings.where(F.exists("own", lambda p: _in_box(p, box))).select("fid").distinct()
    kept = kept.join(touched, "fid", "left_semi").where(F.size("own") >= 3).withColumn("points", F.concat("own", F.slice("own", 1, 1)))
    edited = _rebuild(kept.select("fid", "part", "ring", "points"))
    return _apply(layer, edited, gone, "delete")


def sliver_vertices(layer: DataFrame, slivers: DataFrame, tolerance_m: float, latitude: float = 0.0) -> DataFrame:
    """(x, y): the distinct vertices of exterior rings within four tolerances (of a metre at least) of a sliver."""
    reach = metres_to_degrees(max(tolerance_m, 1.0) * 4, latitude)
    own = frozen(layer)
    lines = with_bbox(slivers.select(F.col("n").alias("fid"), "geom"))
    near = bbox_pairs(own, lines, reach=reach).where(geo("dwithin", "a_geom", "b_geom", F.lit(reach))).select(F.col("a_fid").alias("fid")).distinct()
    pts = own.join(near, "fid", "left_semi").select(F.explode(geo("rings", "geom")).alias("r")).where("r.ring = 0").select(F.explode("r.points").alias("p")).select("p.x", "p.y").distinct()
    pts = pts.select(F.xxhash64("x", "y").alias("fid"), "x", "y", geo("make_point", "x", "y").alias("geom"))
    hit = bbox_pairs(with_bbox(pts), lines, reach=reach).where(geo("dwithin", "a_geom", "b_geom", F.lit(reach)))
    return hit.select(F.col("a_x").alias("x"), F.col("a_y").alias("y")).distinct()


def issue_counts(found: DataFrame, fixed: DataFrame) -> DataFrame:
    """For each kind: issues, and how many the repair settled."""
    marked = found.join(fixed.select("key", F.lit(True).alias("_f")), "key", "left")
    return marked.groupBy("kind").agg(F.count(F.lit(1)).alias("issues"), F.count_if("_f").alias("fixed"))


def gap_slider(found: DataFrame) -> tuple[float, float]:
    """The largest gap width to offer, and its step."""
    widest = found.where("kind = 'gap'").agg(F.max("max_width_m")).first()[0]
    top = nice_number(2 * widest) if widest else 100.0
    return top, nice_number(top / 100)


