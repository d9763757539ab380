"""Geometry functions on WKB columns, run in the JVM on the geometry library that Spark ships.

The Java source beside this module is compiled once for each version of it and added to the
session's jars, which Spark hands on to executors. Null arguments give null.
"""

from __future__ import annotations

import glob
import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessella.session import ship

_SOURCE = os.path.join(os.path.dirname(__file__), "java", "tessella", "Geo.java")
_POINTS = "array<struct<x:double,y:double>>"
_RINGS = f"array<struct<part:int,ring:int,points:{_POINTS}>>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

#: Function name, class, result type.
FUNCTIONS = {
    "area": ("Area", "double"), "length": ("Length", "double"), "x": ("X", "double"), "y": ("Y", "double"), "count_of": ("Count", "int"),
    "is_valid": ("IsValid", "boolean"), "is_empty": ("IsEmpty", "boolean"), "kind": ("Kind", "string"), "bbox": ("Bbox", BBOX),
    "intersects": ("Intersects", "boolean"), "within": ("Within", "boolean"), "contains": ("Contains", "boolean"),
    "distance": ("Distance", "double"), "dwithin": ("DWithin", "boolean"), "points_within": ("CountWithin", "array<boolean>"),
    "samples": ("Samples", "long"), "sample_hits": ("SampleHits", "array<struct<a:long,b:long>>"), "common_part": ("CommonPart", "array<binary>"),
    "intersection": ("Intersection", "binary"), "difference": ("Difference", "binary"), "union_list": ("UnionList", "binary"),
    "collect": ("Collect", "binary"), "node": ("Node", "binary"), "make_valid": ("MakeValid", "binary"), "force_2d": ("Force2D", "binary"),
    "boundary": ("Boundary", "binary"), "centroid": ("Centroid", "binary"), "point_on_surface": ("PointOnSurface", "binary"),
    "start_point": ("StartPoint", "binary"), "end_point": ("EndPoint", "binary"), "exterior_ring": ("ExteriorRing", "binary"), "filled": ("Filled", "binary"),
    "remove_repeated": ("RemoveRepeated", "binary"), "multi": ("Multi", "binary"), "line_merge": ("LineMerge", "binary"), "buffer": ("Buffer", "binary"),
    "reduce_precision": ("ReducePrecision", "binary"), "extract": ("Extract", "binary"), "parts": ("Parts", "array<binary>"),
    "interior_rings": ("InteriorRings", "array<binary>"), "interpolate_points": ("InterpolatePoints", "array<binary>"),
    "inscribed_circle": ("InscribedCircle", "struct<center:binary,nearest:binary,radius:double>"), "rings": ("Rings", _RINGS),
    "from_rings": ("FromRings", "binary"), "make_line": ("MakeLine", "binary"), "make_point": ("MakePoint", "binary"), "make_envelope": ("MakeEnvelope", "binary"),
    "polygonize": ("Polygonize", "array<binary>"), "voronoi": ("Voronoi", "array<binary>"), "invalid_edges": ("InvalidEdges", "binary"),
    "coverage_clean": ("CoverageClean", "array<binary>"), "as_text": ("AsText", "string"), "from_text": ("FromText", "binary"),
    "as_geojson": ("AsGeoJson", "string"), "from_geojson": ("FromGeoJson", "binary"), "transform_crs": ("Transform", "binary"),
}


def _jar(spark: SparkSession) -> str:
    with open(_SOURCE, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()[:16]
    folder = os.path.join(tempfile.gettempdir(), f"tessella-geo-{os.getuid()}-{digest}")
    jar = os.path.join(folder, "geo.jar")
    if os.path.exists(jar):
        return jar
    home = os.environ.get("JAVA_HOME") or spark.sparkContext._jvm.System.getProperty("java.home")
    javac = next((p for p in (os.path.join(home, "bin", "javac"), shutil.which("javac")) if p and os.path.exists(p)), None)
    if javac is None:
        raise RuntimeError("geometry functions need javac to be compiled once")
    classpath = spark.sparkContext._jvm.System.getProperty("java.class.path")
    os.makedirs(folder, exist_ok=True)
    with tempfile.TemporaryDirectory() as work:
        subprocess.run([javac, "-nowarn", "-Xlint:none", "-d", work, "-cp", classpath, _SOURCE], check=True, capture_output=True)
        own = f"{jar}.{os.getpid()}"
        with zipfile.ZipFile(own, "w") as z:
            for p in glob.glob(f"{work}/tessella/*.class"):
                z.write(p, os.path.relpath(p, work))
        os.replace(own, jar)
    return jar


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; calling it again costs nothing."""
    ship(spark)
    if spark.catalog.functionExists("tess_area"):
        return
    spark.sql(f"ADD JAR '{_jar(spark)}'")
    for name, (cls, kind) in FUNCTIONS.items():
        spark.udf.registerJavaFunction(f"tess_{name}", f"tessella.Geo${cls}", kind)


def geo(name: str, *args: Column | str) -> Column:
    """A geometry function of columns, e.g. ``geo("area", "geom")``."""
    if name not in FUNCTIONS:
        raise KeyError(name)
    return F.call_function(f"tess_{name}", *[F.col(a) if isinstance(a, str) else a for a in args])


def union_agg(geom: Column | str) -> Column:
    """The union of a group's geometries; nulls are left out."""
    return geo("union_list", F.collect_list(geom))


def bbox_overlap(a: str, b: str) -> Column:
    """Whether two boxes meet, borders included."""
    p, q = F.col(a), F.col(b)
    return (p.xmin <= q.xmax) & (p.xmax >= q.xmin) & (p.ymin <= q.ymax) & (p.ymax >= q.ymin)


def equal_earth_area(geom: Column | str) -> Column:
    """Square metres in the Equal Earth projection, of longitudes and latitudes."""
    return geo("area", geo("transform_crs", geom, F.lit(4326), F.lit(8857)))


def polygonal(geom: Column) -> Column:
    return geo("make_valid", geo("extract", geom, F.lit(3)))
