import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions.geometry import geo, register
from tessella.sources import flatgeobuf, formats, layers, sinks
from tessella.sources.columns import detect_columns

HOLED = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]}
PAIR = {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]], [[[7, 7], [8, 7], [8, 8], [7, 7]]]]}


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": p} for g, p in features]})


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "in.geojson"
    path.write_text(collection((HOLED, {"id": 1, "name": "Ä", "x": 0.5}), (PAIR, {"id": 2, "name": None, "x": 2.0}), (None, {"id": 3, "name": "none", "x": None})))
    return str(path)


def shapes(layer):
    rows = layer.joined().select("fid", geo("area", "geom").alias("area"), *[c for c in layer.attrs.columns if c != "fid"]).orderBy("fid").collect()
    return [r.asDict() for r in rows]


def test_geojson(spark, file):
    layer = layers.load_layer(spark, file)
    assert shapes(layer) == [{"fid": 1, "area": 15.0, "id": 1, "name": "Ä", "x": 0.5}, {"fid": 2, "area": 1.0, "id": 2, "name": None, "x": 2.0}, {"fid": 3, "area": None, "id": 3, "name": "none", "x": None}]
    back = json.loads(sinks.geojson(layer.joined().orderBy("fid").drop("fid", "bbox")))
    assert [f["properties"]["id"] for f in back["features"]] == [1, 2]
    assert back["features"][0]["geometry"]["type"] == "Polygon" and len(back["features"][0]["geometry"]["coordinates"]) == 2


@pytest.mark.parametrize("extension", [e for _, e in sinks.list_formats("cleaned")])
def test_round_trips(spark, file, tmp_path, extension):
    layer = layers.load_layer(spark, file)
    path = sinks.export("cleaned", extension, str(tmp_path), layer.geom, layer.attrs, "town")
    assert os.path.basename(path) == f"town_cleaned{extension}"
    back = [{k: (str(v) if v is not None else None) if k in ("id", "x") else v for k, v in r.items()} for r in shapes(layers.load_layer(spark, path))]
    for got, (i, area, name, x) in zip(back, [(1, 15.0, "Ä", 0.5), (2, 1.0, None, 2.0)]):
        assert got["fid"] == i and got["area"] == pytest.approx(area) and got["id"] == str(i) and got["name"] == name and float(got["x"]) == x
    assert len(back) == 2


def test_zip_lines_gpx_and_clip(spark, file, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(file, "inner/in.geojson")
        z.writestr("__MACOSX/in.geojson", "x")
    assert len(shapes(layers.load_layer(spark, str(tmp_path / "a.zip")))) == 3
    lines = tmp_path / "b.geojsonl"
    lines.write_text("\n".join(json.dumps({"type": "Feature", "geometry": g, "properties": {"n": n}}) for n, g in enumerate([HOLED, PAIR])) + "\n\n")
    layer = layers.load_layer(spark, str(lines))
    assert [(r["fid"], r["n"]) for r in shapes(layer)] == [(1, 0), (2, 1)]
    (tmp_path / "t.gpx").write_text('<gpx><wpt lat="2" lon="1"><name>w</name></wpt><trk><name>t</name><trkseg><trkpt lat="0" lon="0"/><trkpt lat="1" lon="1"/></trkseg></trk></gpx>')
    gpx = layers.load_layer(spark, str(tmp_path / "t.gpx"))
    assert [r[0] for r in gpx.geom.orderBy("fid").select(geo("as_text", "geom")).collect()] == ["POINT (1 2)", "MULTILINESTRING ((0 0, 1 1))"]
    (tmp_path / "m.geojson").write_text(collection(({"type": "Polygon", "coordinates": [[[-1, -1], [9, -1], [9, 9], [-1, -1]]]}, {}), ({"type": "Polygon", "coordinates": [[[50, 50], [51, 50], [51, 51], [50, 50]]]}, {})))
    assert layers.load_clip(spark, layer, str(tmp_path / "m.geojson")).count() == 1


def test_errors_and_choice_of_format(spark, tmp_path):
    assert layers.pick_format(["a.kml", "b.parquet"]) == ".parquet" and layers.pick_format(["b.parquet", "a.dbf"]) == ".shp"
    with pytest.raises(layers.LoadError):
        layers.pick_format(["a.json"])
    spark.range(3).write.parquet(str(tmp_path / "n.parquet"))
    with pytest.raises(layers.LoadError, match="No geometry column"):
        layers.load_layer(spark, str(tmp_path / "n.parquet"))
    with pytest.raises(ValueError):
        sinks.export("changelog", ".gpkg", str(tmp_path), spark.range(1))


def test_csv_has_a_mark_and_header(spark, tmp_path):
    df = spark.createDataFrame([("a", None, True, [1])], "code string, x double, ok boolean, l array<int>")
    path = sinks.export("changelog", ".csv", str(tmp_path), df, name="ab")
    assert open(path, "rb").read() == b'\xef\xbb\xbfcode,x,ok,l\na,,true,[1]\n'
    assert sinks.list_formats("changelog")[0] == ("CSV", ".csv") and sinks.stem("/x/a.geojson", "b.zip") == "a_b"


def test_odd_column_names(spark, tmp_path):
    (tmp_path / "o.geojson").write_text(collection((HOLED, {"a`b": 1, "c.d": "x", "e f": None})))
    layer = layers.load_layer(spark, str(tmp_path / "o.geojson"))
    assert layer.attrs.columns == ["fid", "a`b", "c.d", "e f"]
    path = sinks.export("cleaned", ".parquet", str(tmp_path), layer.geom, layer.attrs, "odd")
    back = layers.load_layer(spark, path).attrs.collect()
    assert [tuple(r) for r in back] == [(1, 1, "x", None)]


def test_projections(spark):
    register(spark)
    def there(lon, lat, srid):
        p = geo("transform_crs", geo("from_text", lit(f"POINT ({lon} {lat})")), lit(srid), lit(4326))
        return spark.range(1).select(geo("x", p), geo("y", p)).first()
    from pyspark.sql.functions import lit
    assert there(1113194.9079327357, 5621521.486192066, 3857) == pytest.approx((10, 45), abs=1e-9)
    # 9 E 45 N is the central meridian of zone 32
    assert there(500000, 4982950.400, 32632) == pytest.approx((9, 45), abs=1e-7)
    assert formats.prj_srid("PROJCS[\"WGS_1984_UTM_Zone_33S\"]") == 32733
    with pytest.raises(ValueError):
        formats.prj_srid("PROJCS[\"Odd\"]")


def test_detection_of_columns():
    assert detect_columns(["fid", "shapecode", "ID", "Name_1"]) == ("ID", "Name_1")
    assert detect_columns(["id", "ADM1_PCODE", "adm1_en"]) == ("ADM1_PCODE", "adm1_en")
    assert detect_columns(["x"]) == (None, None)


def test_flatgeobuf_without_features_and_dbf_names():
    assert flatgeobuf.read(flatgeobuf.write([], "l", {"a": "TEXT"})) == ([], 4326)
    rows = formats.read_dbf(formats.write_dbf([{"a_long_name_1": 1, "a_long_name_2": None}], {"a_long_name_1": "INTEGER", "a_long_name_2": "TEXT"}))
    assert list(rows[0].values()) == [1, None] and len(rows[0]) == 2


@pytest.mark.parametrize("extension", [".kml", ".gml"])
def test_xml_files_are_written_without_passing_through_python(spark, tmp_path, monkeypatch, extension):
    register(spark)
    monkeypatch.setattr(sinks, "_PART", 3)
    monkeypatch.setattr(sinks, "_PIECE", 300)
    rows = spark.range(0, 40, 1, 5).select((40 - F.col("id")).alias("fid"), geo("make_envelope", F.array(*(F.col("id").cast("double") + i for i in (0, 0, 1, 1)))).alias("geom"))
    attrs = rows.select("fid", F.concat(F.lit("é & \r\n"), "fid").alias("name"))
    with monkeypatch.context() as m:
        m.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("rows are sent to the driver"))
        path = sinks.export("cleaned", extension, str(tmp_path), rows, attrs, "many")
        none = sinks.export("cleaned", extension, str(tmp_path), rows.limit(0), attrs, "none")
    frame, made = (formats.kml_frame, formats.kml_features) if extension == ".kml" else (formats.gml_frame, formats.gml_features)
    features = [(bytes(r.g), {"name": f"é & \r\n{r.fid}"}) for r in rows.select("fid", geo("multi", "geom").alias("g")).orderBy("fid").collect()]
    for got, layer, own in ((path, "many_cleaned", features), (none, "none_cleaned", [])):
        head, tail = frame(layer)
        with open(got, "rb") as f:
            assert f.read() == head + b"".join(x + b"\n" for x in made(own, layer, {"name": "TEXT"})) + tail


def test_parquet_keeps_types_and_order_over_partitions(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 7).selectExpr("id", "cast(id % 9 as decimal(20, 2)) as `d.d`", "timestamp'2024-07-01 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as t", "if(id % 3 = 0, null, date'2024-02-29') as day", "array(id) as list")
    path = sinks.export("changelog", ".parquet", str(tmp_path), rows)
    back = spark.read.parquet(path)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema] == [("id", "bigint"), ("d.d", "decimal(20,2)"), ("t", "timestamp"), ("day", "date"), ("list", "string")]
    assert back.collect() == sinks.portable(rows).collect()
    empty = sinks.export("changelog", ".parquet", str(tmp_path / "none"), rows.limit(0))
    assert spark.read.parquet(empty).count() == 0
    lines = open(sinks.export("changelog", ".csv", str(tmp_path), rows.select("id", "day")), encoding="utf-8-sig", newline="").read().split("\n")
    assert lines[:3] == ["id,day", "0,", "1,2024-02-29"] and len(lines) == 30_002


def test_parquet_footer_declares_its_system(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    register(spark)
    point = bytes(spark.range(1).select(geo("from_text", F.lit("POINT (0 0)"))).first()[0])
    for code in (3857, 4326):
        crs = {"id": {"authority": "EPSG", "code": code}}
        meta = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"], "crs": crs}}}
        pq.write_table(pa.table({"geometry": [point]}).replace_schema_metadata({"geo": json.dumps(meta)}), str(tmp_path / f"{code}.parquet"))
        assert layers._footer_srid(spark, spark.read.parquet(str(tmp_path / f"{code}.parquet")).inputFiles(), "geometry") == code


def test_large_files_are_made_in_tasks(spark, tmp_path, monkeypatch):
    """What passes through the driver are parts that tasks made, never features; shapes, numbers and widths fit over all parts."""
    register(spark)
    monkeypatch.setattr(sinks, "_PART", 3)
    rows = spark.range(0, 20, 1, 5).select((F.col("id") + 1).alias("fid"), geo("make_envelope", F.array(*(F.col("id").cast("double") + i for i in (0, 0, 1, 1)))).alias("geom"))
    attrs = rows.select("fid", F.when(F.col("fid") % 4 > 0, F.repeat(F.lit("é"), F.col("fid").cast("int"))).alias("a<b"), (F.pow(F.lit(10), F.col("fid")) / 4).alias("x"), F.expr("timestamp'2024-07-01 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, fid)").alias("t"))
    for extension in (".shp.zip", ".kml", ".gml"):
        with monkeypatch.context() as m:
            here = os.getpid()
            read = sinks.formats.parse_wkb
            m.setattr(sinks.formats, "parse_wkb", lambda g: read(g) if os.getpid() != here else pytest.fail("a shape was taken apart on the driver"))
            path = sinks.export("cleaned", extension, str(tmp_path), rows, attrs, "many")
        back = layers.load_layer(spark, path).joined().select("*", geo("area", "geom").alias("area"), geo("x", geo("centroid", "geom")).alias("mid")).orderBy("fid").collect()
        assert [(r.fid, r.area, r.mid) for r in back] == [(i, 1.0, i - 0.5) for i in range(1, 21)]
        text = next(c for c in back[0].asDict() if c in ("a<b", "a_b"))
        assert [r[text] for r in back] == ["é" * i if i % 4 else None for i in range(1, 21)]
        assert [float(r.x) for r in back] == [10.0**i / 4 for i in range(1, 21)] and str(back[0].t) == "2024-07-01 12:00:01"
    with zipfile.ZipFile(tmp_path / "many_cleaned.shp.zip") as z:
        shp, shx = z.read("many_cleaned.shp"), z.read("many_cleaned.shx")
    import struct

    assert struct.unpack_from(">i", shp, 24)[0] * 2 == len(shp) and struct.unpack_from("<4d", shp, 36) == (0, 0, 20, 20) and len(shx) == 100 + 8 * 20
    for i in range(20):
        at, size = struct.unpack_from(">2i", shx, 100 + 8 * i)
        assert struct.unpack_from(">2i", shp, 2 * at) == (i + 1, size)
    none = layers.load_layer(spark, sinks.export("cleaned", ".shp.zip", str(tmp_path / "none"), rows.limit(0), attrs))
    assert none.geom.count() == 0


KML = """<?xml version="1.0" encoding="{}"?>
<!DOCTYPE kml [<!ENTITY who "Zoë &amp; co">]><!-- <Placemark> no mark </Placemark> -->
<k:kml xmlns:k="http://www.opengis.net/kml/2.2" note='a>"b'><k:Document><k:Folder><k:Placemark/>
<k:Placemark id="x>y"><k:name>&who; 1 > 0</k:name><k:Point><k:coordinates>1,2</k:coordinates></k:Point></k:Placemark ></k:Folder>
<k:Folder><k:Placemark><k:description><![CDATA[</Placemark> é]]></k:description><k:ExtendedData><k:Data name="n"><k:value>7</k:value></k:Data></k:ExtendedData></k:Placemark></k:Folder></k:Document></k:kml> <!-- end > -->
"""
GML = """<?xml version="1.0" encoding="{}"?><g:FeatureCollection xmlns:g="http://www.opengis.net/gml"><g:boundedBy><g:Null>a</g:Null></g:boundedBy>
<g:featureMember xmlns:o="urn:o"><o:t><o:n>ü</o:n><g:Point><g:pos>1 2</g:pos></g:Point></o:t></g:featureMember>
<g:featureMembers><t><n>2</n><!-- </t> --></t><t/><t><n><![CDATA[<t>]]></n></t></g:featureMembers></g:FeatureCollection>
"""


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1", "utf-16"])
@pytest.mark.parametrize("text,kind", [(KML, ".kml"), (GML, ".gml")])
def test_xml_in_pieces_reads_as_a_whole(encoding, text, kind):
    data = text.format(encoding).encode(encoding)
    reader = {".kml": formats.read_kml, ".gml": formats.read_gml}[kind]
    want = reader(data)
    assert len(want) == (3 if kind == ".kml" else 4)
    cuts = [data[i : j + 1] for i, j in zip([0, *(k + 1 for k, b in enumerate(data) if b == 62)], [k for k, b in enumerate(data) if b == 62])] + [data[data.rindex(b">") + 1 :] + b">"]
    for most in (1, 2, 1000):
        for pieces in ([data], cuts, [b"".join(cuts[k : k + 3]) for k in range(0, len(cuts), 3)]):
            assert [f for d in formats.xml_documents(pieces, kind, most) for f in reader(d)] == want
    with pytest.raises(Exception):
        list(formats.xml_documents(cuts[: len(cuts) // 2], kind))


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_xml_layers_of_any_encoding(spark, tmp_path, encoding):
    (tmp_path / "a.gml").write_bytes(GML.format(encoding).encode(encoding))
    assert [(r.fid, r.n) for r in layers.load_layer(spark, str(tmp_path / "a.gml")).attrs.orderBy("fid").collect()] == [(1, "ü"), (2, "2"), (3, None), (4, "<t>")]
    (tmp_path / "a.kml").write_bytes(KML.format(encoding).encode(encoding))
    assert [r.name for r in layers.load_layer(spark, str(tmp_path / "a.kml")).attrs.orderBy("fid").collect()] == [None, "Zoë & co 1 > 0", None]
