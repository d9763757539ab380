"""Exports: which results can be saved, in which formats, and the files."""

from __future__ import annotations

import io
import itertools
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.functions.geometry import geo, register
from tessella.session import column, cut, numbered, scratch, ship

from . import flatgeobuf, formats


@dataclass(frozen=True)
class ExportSpec:
    """Suffix of the file name, whether there is geometry, and the columns to keep (None: all)."""

    suffix: str
    spatial: bool = True
    columns: tuple[str, ...] | None = None


#: What can be saved (fixed values: suffixes and columns).
EXPORTS = {
    "extended": ExportSpec("_ee"),
    "clipped": ExportSpec("_em"),
    "cleaned": ExportSpec("_cleaned"),
    "issues": ExportSpec("_issues", True, ("key", "kind", "area_m2", "max_width_m", "unit_a", "unit_b")),
    "overlay": ExportSpec("_cw_overlay", True, ("cluster_id", "relationship_class", "piece_side", "a_fid", "b_fid")),
    "changelog": ExportSpec("_changelog", False),
}
#: Label, extension and rank of each format (fixed values).
SPATIAL_FORMATS = (("GeoPackage", ".gpkg", 0), ("Shapefile", ".shp.zip", 1), ("GeoParquet", ".parquet", 2), ("FlatGeobuf", ".fgb", 3), ("KML", ".kml", 4), ("GML", ".gml", 5), ("GeoJSON", ".geojson", 6))
TABLE_FORMATS = (("CSV", ".csv", 0), ("Parquet", ".parquet", 1))


#: Bytes handed to the file system at once; rows and bytes of a row group.
_PIECE, _GROUP_ROWS, _GROUP_BYTES = 1 << 22, 122_880, 1 << 27
#: Features of a part that a task makes.
_PART = 1024


def list_formats(source: str) -> list[tuple[str, str]]:
    """(label, extension) of the formats that a source can be saved in."""
    every = SPATIAL_FORMATS if EXPORTS[source].spatial else TABLE_FORMATS
    return [(label, ext) for label, ext, rank in sorted(every, key=lambda f: (f[2], f[0]))]


def stem(*names: str) -> str:
    """The file names without folders and extensions, two joined by an underscore."""
    import os

    return "_".join(os.path.splitext(os.path.basename(n))[0] for n in names)


def portable(df: DataFrame, *keep: str) -> DataFrame:
    """Columns whose types other formats lack as text: structs, maps, arrays, bytes and whole numbers beyond 64 bits."""
    def cell(f: T.StructField) -> Column:
        c = column(f.name)
        if f.name in keep:
            return c
        if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.hex(c).alias(f.name)
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0 and f.dataType.precision > 18:
            return c.cast("string").alias(f.name)
        return c

    return df.select(*map(cell, df.schema))


def export_rows(source: str, rows: DataFrame, attrs: DataFrame | None = None) -> DataFrame:
    """What a source saves: attributes by fid (all but fid) or the columns of its spec, rows with geometry only."""
    spec = EXPORTS[source]
    if not spec.spatial:
        return portable(rows)
    register(rows.sparkSession)
    own = rows.where("geom is not null").drop("bbox")
    if attrs is not None:
        own = own.select("fid", "geom").join(attrs, "fid", "left").orderBy("fid").drop("fid")
    elif spec.columns:
        own = own.select(*spec.columns, "geom")
    return portable(own, "geom")


def feature_rows(rows: DataFrame) -> DataFrame:
    """(value): a GeoJSON feature for each row that has a shape; all other columns are its properties."""
    register(rows.sparkSession)
    own = rows.where(F.col("geom").isNotNull() & ~geo("is_empty", "geom"))
    names = [c for c in rows.columns if c not in ("geom", "bbox")]
    props = F.to_json(F.struct(*[column(c) for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return own.select(F.concat(F.lit('{"type":"Feature","geometry":'), geo("as_geojson", "geom"), F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def geojson(rows: DataFrame) -> str:
    """One FeatureCollection as text, for results of a size that a file holds; ``feature_rows`` writes any size line by line."""
    return "".join(_collection(rows))


def _collection(rows: DataFrame) -> Iterator[str]:
    yield '{"type":"FeatureCollection","features":['
    for n, r in enumerate(feature_rows(rows).toLocalIterator()):
        yield f",{r.value}" if n else r.value
    yield "]}"


class _Target(io.RawIOBase):
    """A new file wherever Spark can write; what is written leaves the driver in pieces."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        self._out = target.getFileSystem(self._conf).create(target, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        for k in range(0, len(data), _PIECE):
            self._out.write(data[k : k + _PIECE])
        return len(data)

    def append(self, folder: str) -> None:
        """Adds the files that the tasks of one write have left in a folder, in the order of the tasks and through a small buffer, and removes them."""
        at = self._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(self._conf)
        parts = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("part-")]
        for p in sorted(parts, key=lambda p: (int(p.getName().split("-")[1]), p.getName())):
            source = files.open(p)
            try:
                self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self._out, 1 << 16, False)
            finally:
                source.close()
        files.delete(at, True)

    def close(self) -> None:
        if not self.closed:
            super().close()
            self._out.close()


def target_file(spark: SparkSession, path: str) -> io.BufferedWriter:
    """A buffered binary file to write, on any file system that Spark writes to."""
    return io.BufferedWriter(_Target(spark, path), _PIECE)


def save_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file wherever Spark can write."""
    with target_file(spark, path) as out:
        out.write(data)


def _kinds(rows: DataFrame) -> dict[str, str]:
    whole, real = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
    return {f.name: "INTEGER" if isinstance(f.dataType, whole) else "REAL" if isinstance(f.dataType, real) else "TEXT" for f in rows.schema if f.name != "geom"}


def export(source: str, extension: str, path: str, rows: DataFrame, attrs: DataFrame | None = None, name: str = "layer") -> str:
    """Saves a source as one file, ``path`` being a folder; returns the file's path.

    CSV, GeoJSON and Parquet pass through the driver a partition at a time and are written as
    they come. The other vector files hold multi-geometries: shapefiles are made in tasks, and
    their parts pass through the driver in the same way; KML and GML are written by tasks, whose
    files are strung together without being held; GeoPackage and FlatGeobuf are put together on
    the driver.
    """
    spec, spark = EXPORTS[source], rows.sparkSession
    if extension not in [e for _, e in list_formats(source)]:
        raise ValueError(f"{source} can't be saved as {extension}")
    layer = f"{name}{spec.suffix}"
    own = export_rows(source, rows, attrs)
    target = f"{path.rstrip('/')}/{layer}{extension}"
    if extension == ".csv":
        import csv

        with io.TextIOWrapper(target_file(spark, target), "utf-8-sig", newline="") as text:
            writer = csv.writer(text, lineterminator="\n")
            writer.writerow(own.columns)
            writer.writerows(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in r] for r in own.toLocalIterator())
    elif extension == ".geojson":
        with target_file(spark, target) as out:
            out.writelines(x.encode() for x in _collection(own))
    elif extension == ".parquet":
        with target_file(spark, target) as out:
            _parquet(own, spec.spatial, out)
    elif extension in (".kml", ".gml"):
        own = own.withColumn("geom", geo("multi", "geom"))
        frame, made = {".kml": (formats.kml_frame, formats.kml_features), ".gml": (formats.gml_frame, formats.gml_features)}[extension]
        head, tail = frame(layer)
        kinds = _kinds(own)

        def text(first: int, features: list[formats.Feature]) -> Iterator[dict]:
            for k in range(0, len(features), _PART):
                yield {"data": b"\n".join(made(features[k : k + _PART], layer, kinds, first + k)).decode()}

        folder = scratch(spark)
        _made(own, text, "data string").write.text(folder, compression="none", lineSep="\n")
        with _Target(spark, target) as out:
            out.write(head)
            out.append(folder)
            out.write(tail)
    elif extension == ".shp.zip":
        _shapefile(own.withColumn("geom", geo("multi", "geom")), layer, spark, target)
    else:
        own = own.withColumn("geom", geo("multi", "geom"))
        kinds = _kinds(own)
        features = ((bytes(r["geom"]), {c: r[c] for c in kinds}) for r in own.toLocalIterator())
        writer = {".gpkg": formats.write_gpkg, ".fgb": flatgeobuf.write}[extension]
        save_bytes(spark, target, writer(features, layer, kinds))
    return target


def _made(own: DataFrame, part: Callable[[int, list[formats.Feature]], Iterator[dict]], schema: str) -> DataFrame:
    """What ``part`` makes in tasks of the rows' features and of the number of the first of them, in the order of the rows."""
    names = own.columns
    plain = own.toDF(*(f"c{i}" for i in range(len(names))))
    # a time is shown as the session's clock has it
    plain = plain.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in plain.schema])
    at = names.index("geom")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(wanted)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            features = [(r[at], {n: v for i, (n, v) in enumerate(zip(names, r)) if i != at}) for r in zip(*cols[:-1])]
            for made in part(cols[-1][0], features) if features else ():
                yield pa.RecordBatch.from_pylist([made], kind)

    wanted = T._parse_datatype_string(schema)
    rows = numbered(plain, "row", start=0).select(*plain.columns, "row")
    # the driver may take in a partition at a time, so shapes of a few MB make one
    n = 1 + (rows.agg(F.sum(F.length(f"c{at}").cast("long"))).first()[0] or 0) // _PIECE
    return rows.repartitionByRange(n, "row").sortWithinPartitions("row").mapInArrow(run, schema)


def _shapefile(own: DataFrame, layer: str, spark: SparkSession, target: str) -> None:
    """The five parts of a shapefile as a ZIP archive."""
    names = {"Point": 1, "LineString": 2, "LinearRing": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
    kind = formats.shape_type(names.get(r[0], 0) for r in own.select(geo("kind", "geom")).distinct().collect())
    kinds = _kinds(own)

    def part(first: int, features: list[formats.Feature]) -> Iterator[dict]:
        for k in range(0, len(features), _PART):
            few = features[k : k + _PART]
            shp, sizes, box = formats.shp_records((g for g, _ in few), kind, first + k + 1)
            dbf, widths = formats.dbf_records([[formats.dbf_text(a[c], x) for c, x in kinds.items()] for _, a in few], kinds)
            yield {"n": len(few), "shp": shp, "sizes": sizes, "box": list(box), "dbf": dbf, "widths": widths}

    parts = cut(_made(own, part, "n long, shp binary, sizes array<int>, box array<double>, dbf binary, widths array<int>"))
    corners = [f(F.col("box")[i]) for i, f in enumerate((F.min, F.min, F.max, F.max))]
    n, size, *rest = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("shp").cast("long")), F.lit(0)), *corners, *[F.coalesce(F.max(F.col("widths")[i]), F.lit(1)) for i in range(len(kinds))]).first()
    box, widths = formats.NOWHERE if rest[0] is None else rest[:4], rest[4:]

    def index() -> Iterator[bytes]:
        at = 100
        for r in parts.select("sizes").toLocalIterator():
            out = bytearray()
            for s in r.sizes:
                out += struct.pack(">2i", at // 2, s // 2)
                at += 8 + s
            yield bytes(out)

    pieces = {
        "shp": (size, itertools.chain([formats.shp_head(size, kind, box)], (bytes(r.shp) for r in parts.select("shp").toLocalIterator()))),
        "shx": (8 * n, itertools.chain([formats.shp_head(8 * n, kind, box)], index())),
        "dbf": (n * (1 + sum(widths)), itertools.chain([formats.dbf_head(n, widths, kinds)], (formats.dbf_widened(bytes(r.dbf), r.n, r.widths, widths, kinds) for r in parts.select("n", "dbf", "widths").toLocalIterator()), [b"\x1a"])),
        "prj": (0, [formats.WGS84.encode()]),
        "cpg": (0, [b"UTF-8"]),
    }
    with target_file(spark, target) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for extension, (most, data) in pieces.items():
            with z.open(f"{layer}.{extension}", "w", force_zip64=most > 1 << 30) as entry:
                for x in data:
                    entry.write(x)


def _arrow_tables(own: DataFrame) -> Iterator[pa.Table]:
    """The rows as Arrow tables in their order, put together in tasks; the driver holds one partition's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as stream:
                stream.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    ship(own.sparkSession)
    plain = own.toDF(*(f"c{i}" for i in range(len(own.columns))))
    for r in plain.mapInArrow(run, "data binary").toLocalIterator():
        yield pa.ipc.open_stream(r.data).read_all()


def _parquet(own: DataFrame, spatial: bool, out: io.BufferedWriter) -> None:
    schema = to_arrow_schema(own.schema)
    if spatial:
        types = sorted(r[0] for r in own.select(geo("kind", "geom")).distinct().collect())
        meta = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": types}}}
        schema = pa.schema([f.with_name("geometry") if f.name == "geom" else f for f in schema], {b"geo": json.dumps(meta).encode()})
    held: list[pa.Table] = []
    with pq.ParquetWriter(out, schema, compression="zstd", compression_level=15) as writer:

        def flush() -> None:
            if held:
                writer.write_table(pa.concat_tables(held), row_group_size=_GROUP_ROWS)
                held.clear()

        for t in _arrow_tables(own):
            held.append(t.rename_columns(schema.names).cast(schema))
            if sum(t.nbytes for t in held) > _GROUP_BYTES or sum(map(len, held)) >= _GROUP_ROWS:
                flush()
        flush()
