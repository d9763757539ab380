"""Loading layers: a geometry table and an attribute table that share ``fid``."""

from __future__ import annotations

import io
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.geometry import geo, register
from tessella.operators.spatial_join import with_bbox
from tessella.session import column, cut, numbered

from . import flatgeobuf, formats

#: Extensions that make a layer; a plain ``.json`` isn't one (fixed values).
SHAPEFILE = (".shp", ".dbf", ".shx", ".prj", ".cpg")
SINGLE = (".parquet", ".geojson", ".geojsonl", ".gpkg", ".fgb", ".kml", ".gml", ".gpx")
#: Names under which a binary column is taken for WKB (fixed values).
WKB_NAMES = ("geometry", "geom", "wkb_geometry", "the_geom")


class LoadError(ValueError):
    pass


@dataclass
class Layer:
    geom: DataFrame  # fid, geom, bbox
    attrs: DataFrame  # fid and all columns that aren't geometry

    def joined(self) -> DataFrame:
        return self.geom.join(self.attrs, "fid", "left")


def pick_format(names: list[str]) -> str:
    """The extension that decides: any part of a shapefile, else the first Parquet file, else the first other layer file."""
    ext = [os.path.splitext(n)[1].lower() for n in names]
    if any(e in SHAPEFILE for e in ext):
        return ".shp"
    for e in (".parquet", *ext):
        if e in ext and e in SINGLE:
            return e
    raise LoadError("No layer found in the files: " + ", ".join(names))


def normalised(geom: Column, srid: Column | int) -> Column:
    """Valid, two-dimensional, in longitudes and latitudes; made valid before it is projected."""
    srid = F.lit(srid) if isinstance(srid, int) else srid
    return geo("force_2d", geo("transform_crs", geo("make_valid", geom), srid.cast("int"), F.lit(4326)))


def _features(name: str, files: dict[str, bytes]) -> Iterator[tuple[bytes | None, str | None, dict, int]]:
    """(WKB, or GeoJSON text, attributes, reference system) of each feature of a layer's files."""
    ext = pick_format([name, *files])
    data = files.get(name, b"")
    if ext == ".shp":
        by = {os.path.splitext(n)[1].lower(): d for n, d in files.items()}
        if ".shp" not in by:
            raise LoadError("A shapefile needs its .shp part")
        rows, srid = formats.read_shapefile(by)
    elif ext == ".gpkg":
        rows, srid = formats.read_gpkg(data)
    elif ext == ".fgb":
        rows, srid = flatgeobuf.read(data)
    elif ext in (".geojson", ".geojsonl"):
        text = data.decode("utf-8-sig")
        items = [json.loads(x) for x in text.splitlines() if x.strip()] if ext == ".geojsonl" else json.loads(text)
        for f in items.get("features", [items]) if isinstance(items, dict) else items:
            yield None, json.dumps(f["geometry"]) if f.get("geometry") else None, f.get("properties") or {}, 4326
        return
    elif ext == ".parquet":
        import pyarrow.parquet as pq

        table = pq.read_table(io.BytesIO(data))
        geom = next((c for c in WKB_NAMES if c in table.column_names), None)
        if geom is None:
            raise LoadError("No geometry column found")
        rows = [(r.pop(geom), json.loads(json.dumps(r, default=str))) for r in table.to_pylist()]
        srid = _declared(table.schema.metadata or {}, geom)
    else:
        rows, srid = {".kml": formats.read_kml, ".gml": formats.read_gml, ".gpx": formats.read_gpx}[ext](data), 4326
    for g, a in rows:
        yield g, None, a, srid


def _declared(metadata: dict, geom: str) -> int:
    """The reference system in a GeoParquet footer; longitudes and latitudes if none is declared."""
    spec = json.loads(metadata.get(b"geo", b"{}") or b"{}").get("columns", {}).get(geom, {})
    code = ((spec.get("crs") or {}).get("id") or {}).get("code", 4326)
    return int(code) if str(code).isdigit() else 4326


_FOUND = "wkb binary, geojson string, props string, srid int"


def _batches(features: Iterator[tuple[bytes | None, str | None, dict, int]]) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(features, 1024)):
        cols = [[f[0] for f in part], [f[1] for f in part], [json.dumps(f[2], default=str, ensure_ascii=False) for f in part], [f[3] for f in part]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], ["wkb", "geojson", "props", "srid"])


def _xml_rows(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """The features of one KML or GML file of any size, in their order.

    The file is read as texts that end with an angle bracket, so no task holds more than a
    stretch of it; one task cuts these into whole features, and all tasks read those.
    """
    texts = spark.read.text(path, lineSep=">").select(F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("data"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data = b">".join([*b.column(1).to_pylist(), b""])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([data], pa.binary())], ["at", "data"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x for b in batches for x in b.column(1).to_pylist())
        for n, x in enumerate(formats.xml_documents(pieces, ext)):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([x], pa.binary())], ["at", "data"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = formats.read_kml if ext == ".kml" else formats.read_gml
        for b in batches:
            for x in b.column(1):
                yield from _batches((g, None, a, 4326) for g, a in reader(x.as_py()))

    pieces = texts.mapInArrow(joined, "at long, data binary").repartition(1).sortWithinPartitions("at")
    return cut(pieces.mapInArrow(documents, "at long, data binary")).orderBy("at").mapInArrow(read, _FOUND)


def load_layer(spark: SparkSession, *paths: str, srid: int | None = None, extent: tuple[float, float, float, float] | None = None) -> Layer:
    """Reads a layer from its file or files (ZIP archives are opened).

    Parquet and line-delimited GeoJSON are read by Spark in parallel; KML and GML are cut into
    documents of a few features by one task and read by all; other formats, and files in
    archives, are one task's work, as they can't be split. ``fid`` counts rows from 1 in file order. With
    ``extent`` (in longitudes and latitudes) rows whose raw box misses it are left out before
    anything is repaired; rows in other reference systems are all kept, as their boxes don't
    compare.
    """
    register(spark)
    plain = [p for p in paths if not p.lower().endswith(".zip")]
    ext = pick_format([os.path.basename(p.rstrip("/")) for p in plain]) if plain and len(plain) == len(paths) else None
    if ext == ".parquet":
        return _split(spark, spark.read.parquet(next(p for p in plain if p.rstrip("/").lower().endswith(".parquet"))), srid, extent)
    if ext == ".geojsonl":
        lines = spark.read.text(next(p for p in plain if p.lower().endswith(".geojsonl"))).where(F.trim("value") != "")
        rows = lines.select(F.get_json_object("value", "$.geometry").alias("geojson"), F.get_json_object("value", "$.properties").alias("props"))
        return _assemble(spark, rows.select(geo("from_geojson", "geojson").alias("geom"), "props", F.lit(srid or 4326).alias("srid")), extent)
    if ext in (".kml", ".gml"):
        rows = _xml_rows(spark, min(p for p in plain if p.lower().endswith(ext)), ext)
        return _assemble(spark, rows.select(F.col("wkb").alias("geom"), "props", F.lit(srid or 4326).alias("srid")), extent)
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    together = files.agg(F.sort_array(F.collect_list(F.struct("path", "content"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.column(0).to_pylist():
                found = dict(formats.expand([(os.path.basename(f["path"]), f["content"]) for f in row]))
                kind = pick_format(list(found))
                name = next((n for n in found if os.path.splitext(n)[1].lower() == kind), "")
                stem = os.path.splitext(name)[0]
                own = {n: d for n, d in found.items() if kind != ".shp" or os.path.splitext(n)[0] == stem} if name else found
                yield from _batches(_features(name, own))

    rows = together.mapInArrow(run, _FOUND)
    return _assemble(spark, rows.select(F.coalesce("wkb", geo("from_geojson", "geojson")).alias("geom"), "props", (F.lit(srid) if srid else F.col("srid")).alias("srid")), extent)


def _meets(box: Column, extent: tuple[float, float, float, float]) -> Column:
    return (box.xmin <= extent[2]) & (box.xmax >= extent[0]) & (box.ymin <= extent[3]) & (box.ymax >= extent[1])


def _raw(rows: DataFrame, geom: str, srid: Column | int, extent: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows that may meet the extent, by their boxes as they stand in the file; rows without geometry can't."""
    if extent is None:
        return rows
    srid = F.lit(srid) if isinstance(srid, int) else srid
    return rows.where((srid != 4326) | _meets(geo("bbox", column(geom)), extent))


def _json_schema(spark: SparkSession, texts: DataFrame) -> T.StructType:
    """The schema of JSON texts, inferred in the JVM."""
    held = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(held).schema().json()))


def _assemble(spark: SparkSession, rows: DataFrame, extent: tuple[float, float, float, float] | None = None) -> Layer:
    own = cut(_raw(numbered(rows, "fid"), "geom", F.col("srid"), extent))
    schema = _json_schema(spark, own.where("props is not null").select("props"))
    geom = with_bbox(own.select("fid", normalised(F.col("geom"), F.col("srid")).alias("geom")))
    # a property of that name is none: rows are counted anew
    kept = [c for c in schema.names if c.lower() != "fid"]
    attrs = own.select("fid", F.from_json("props", schema).alias("p")).select("fid", *[F.col("p").getField(c).alias(c) for c in kept])
    return Layer(cut(geom), attrs)


def _split(spark: SparkSession, rows: DataFrame, srid: int | None, extent: tuple[float, float, float, float] | None = None) -> Layer:
    binary = {f.name for f in rows.schema if isinstance(f.dataType, T.BinaryType)}
    name = next((c for c in rows.columns if c in binary and c.lower() in WKB_NAMES), None)
    if name is None:
        raise LoadError("No geometry column found")
    # the box columns that writers add to speed up reading are no attributes
    drop = [f.name for f in rows.schema if isinstance(f.dataType, T.StructType) and (f.name.endswith("_bbox") or f.name == "bbox")]
    own = numbered(rows.drop(*drop, *(["fid"] if "fid" in rows.columns else [])), "fid")
    if srid is None:
        srid = _footer_srid(spark, rows.inputFiles(), name)
    own = _raw(own, name, srid, extent)
    geom = with_bbox(own.select("fid", normalised(column(name), srid).alias("geom")))
    return Layer(cut(geom), own.select("fid", *[column(c) for c in own.columns if c not in ("fid", name)]))


def _footer_srid(spark: SparkSession, files: list[str], geom: str) -> int:
    """The system that the first file's footer declares, wherever the file lies; only the footer is read."""
    if not files:
        return 4326
    jvm = spark._jvm
    at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), spark._jsparkSession.sessionState().newHadoopConf())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
    try:
        found = reader.getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return _declared({b"geo": found.encode()} if found else {}, geom)


def load_clip(spark: SparkSession, layer: Layer, *paths: str, srid: int | None = None) -> DataFrame:
    """(geom) of a second layer's shapes that meet the first one's extent; rows whose raw boxes miss it are neither repaired nor kept."""
    box = layer.geom.agg(F.min("bbox.xmin"), F.min("bbox.ymin"), F.max("bbox.xmax"), F.max("bbox.ymax")).first()
    if box[0] is None:
        return spark.createDataFrame([], "geom binary")
    other = load_layer(spark, *paths, srid=srid, extent=tuple(box)).geom
    extent = geo("make_envelope", F.array(*map(F.lit, box)))
    return other.where(_meets(F.col("bbox"), tuple(box)) & geo("intersects", "geom", extent)).select("geom")
