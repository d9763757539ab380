"""Bytes of vector files to and from features: (WKB geometry, attributes)."""

from __future__ import annotations

import io
import itertools
import os
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator

Feature = tuple[bytes | None, dict]


def wkb_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def _points(pts: list[tuple[float, float]]) -> bytes:
    return struct.pack(f"<I{2 * len(pts)}d", len(pts), *(v for p in pts for v in p[:2]))


def wkb_line(pts) -> bytes:
    return struct.pack("<BI", 1, 2) + _points(pts)


def wkb_polygon(rings) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(_points, rings))


def wkb_multi(kind: int, parts: list[bytes]) -> bytes:
    return struct.pack("<BII", 1, kind, len(parts)) + b"".join(parts)


def parse_wkb(data: bytes) -> tuple[int, list]:
    """(type 1 to 7, nested coordinates or parts) of a two-dimensional WKB geometry."""
    def read(at: int) -> tuple[int, list, int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5

        def points(at: int) -> tuple[list, int]:
            (n,) = struct.unpack_from(f"{order}I", data, at)
            flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
            return list(zip(flat[::2], flat[1::2])), at + 4 + 16 * n

        if kind == 1:
            return kind, list(struct.unpack_from(f"{order}2d", data, at)), at + 16
        if kind == 2:
            pts, at = points(at)
            return kind, pts, at
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at, out = at + 4, []
        for _ in range(n):
            if kind == 3:
                ring, at = points(at)
                out.append(ring)
            else:
                k, part, at = read(at)
                out.append(part if kind < 7 else (k, part))
        return kind, out, at

    return read(0)[:2]


# GeoPackage


def read_gpkg(data: bytes) -> tuple[list[Feature], int]:
    """Features of the first feature table that the contents list, and its reference system."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(data)
        f.flush()
        db = sqlite3.connect(f.name)
        try:
            row = db.execute("SELECT c.table_name, g.column_name, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g ON c.table_name = g.table_name WHERE c.data_type = 'features' ORDER BY c.rowid LIMIT 1").fetchone()
            if row is None:
                raise ValueError("No geometry column found")
            name, geom, srs = row
            quoted = name.replace('"', '""')
            key = {r[1] for r in db.execute(f'PRAGMA table_info("{quoted}")') if r[5] and r[2].upper() == "INTEGER"}
            cur = db.execute(f'SELECT * FROM "{quoted}" ORDER BY rowid')
            cols = [c[0] for c in cur.description]
            out = []
            for r in cur:
                own = dict(zip(cols, r))
                out.append((_gpkg_wkb(own.pop(geom)), {k: v for k, v in own.items() if k not in key}))
            return out, srs if srs and srs > 0 else 4326
        finally:
            db.close()


def _gpkg_wkb(blob: bytes | None) -> bytes | None:
    if not blob:
        return None
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return None if blob[3] & 16 else bytes(blob[8 + envelope :])


def write_gpkg(features: Iterable[Feature], layer: str, kinds: dict[str, str]) -> bytes:
    """A GeoPackage with one feature table in EPSG:4326. ``kinds`` gives SQL types by column."""
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "out.gpkg")
        db = sqlite3.connect(path)
        q = '"' + layer.replace('"', '""') + '"'
        cols = "".join(', "' + c.replace('"', '""') + f'" {k}' for c, k in kinds.items())
        db.executescript(
            f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL),
                ('WGS 84', 4326, 'EPSG', 4326, '{WGS84}', NULL);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
            CREATE TABLE {q} (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom BLOB{cols});"""
        )
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, 4326)", (layer, layer))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (layer,))
        marks = ", ".join("?" * (len(kinds) + 1))
        names = ", ".join(["geom", *('"' + c.replace('"', '""') + '"' for c in kinds)])
        head = b"GP\x00\x01" + struct.pack("<i", 4326)
        db.executemany(f"INSERT INTO {q} ({names}) VALUES ({marks})", ((head + g if g else None, *(a.get(c) for c in kinds)) for g, a in features))
        db.commit()
        db.close()
        with open(path, "rb") as f:
            return f.read()


# Shapefile

WGS84 = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def _ring_area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _inside(p, ring) -> bool:
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def _polygons(rings: list) -> bytes:
    """Rings to polygons: clockwise ones are shells, each hole goes to the smallest shell round it."""
    shells = [[r] for r in rings if _ring_area(r) < 0] or [[r] for r in rings]
    for hole in (r for r in rings if _ring_area(r) >= 0) if len(shells) < len(rings) else ():
        home = min((s for s in shells if _inside(hole[0], s[0])), key=lambda s: abs(_ring_area(s[0])), default=None)
        (home if home is not None else shells[0]).append(hole)
    parts = [wkb_polygon(s) for s in shells]
    return parts[0] if len(parts) == 1 else wkb_multi(6, parts)


def read_shapefile(files: dict[str, bytes]) -> tuple[Iterable[Feature], int]:
    """Features of .shp and .dbf bytes, by extension, one at a time; .cpg names the encoding, .prj the reference system."""
    encoding = (files.get(".cpg") or b"utf-8").decode("ascii", "ignore").strip() or "utf-8"
    rows = _dbf_rows(files[".dbf"], encoding) if ".dbf" in files else itertools.repeat({})
    return zip(_shp_shapes(files[".shp"]), rows), prj_srid(files.get(".prj", b"").decode("utf-8", "replace"))


def _shp_shapes(shp: bytes) -> Iterator[bytes | None]:
    at = 100
    while at + 12 <= len(shp):
        (size,) = struct.unpack_from(">i", shp, at + 4)
        body = at + 8
        (kind,) = struct.unpack_from("<i", shp, body)
        base = kind % 10
        if base == 1:
            yield wkb_point(*struct.unpack_from("<2d", shp, body + 4))
        elif base == 8:
            (n,) = struct.unpack_from("<i", shp, body + 36)
            flat = struct.unpack_from(f"<{2 * n}d", shp, body + 40)
            yield wkb_multi(4, [wkb_point(*p) for p in zip(flat[::2], flat[1::2])])
        elif base in (3, 5):
            n_parts, n = struct.unpack_from("<2i", shp, body + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", shp, body + 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", shp, body + 44 + 4 * n_parts)
            pts = list(zip(flat[::2], flat[1::2]))
            parts = [pts[a:b] for a, b in zip(starts, starts[1:])]
            if not parts:
                yield None
            elif base == 5:
                yield _polygons(parts)
            else:
                yield wkb_line(parts[0]) if len(parts) == 1 else wkb_multi(5, [wkb_line(p) for p in parts])
        else:
            yield None
        at = body + 2 * size


def prj_srid(text: str) -> int:
    """The reference system that a .prj describes; an unknown projection is an error, as nothing could be measured in it."""
    import re

    flat = text.upper().replace("_", " ")
    if not flat.strip() or flat.lstrip().startswith(("GEOGCS", "GEOGCRS")):
        return 4326
    if m := re.search(r"UTM ZONE (\d+) ?([NS])", flat):
        return (32600 if m[2] == "N" else 32700) + int(m[1])
    if "PSEUDO" in flat and "MERCATOR" in flat or "WEB MERCATOR" in flat:
        return 3857
    raise ValueError("The layer's projection isn't supported")


def read_dbf(data: bytes, encoding: str = "utf-8") -> list[dict]:
    return list(_dbf_rows(data, encoding))


def _dbf_rows(data: bytes, encoding: str) -> Iterator[dict]:
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    for i in range(n):
        pos, row = head + i * width + 1, {}
        for name, kind, size, places in fields:
            raw = data[pos : pos + size]
            pos += size
            text = raw.decode(encoding, "replace").strip("\0 ")
            if kind in "NF":
                try:
                    row[name] = None if not text or "*" in text else float(text) if places or kind == "F" else int(text)
                except ValueError:
                    row[name] = None
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            else:
                row[name] = text or None
        yield row


#: Shape types of a shapefile by WKB type (fixed values).
_FAMILY = {1: 1, 4: 8, 2: 3, 5: 3, 3: 5, 6: 5}
NOWHERE = (float("inf"), float("inf"), float("-inf"), float("-inf"))


def shape_type(kinds: Iterable[int]) -> int:
    """The shape type of a shapefile that holds these WKB types. All shapes are polygons, or all lines, or all points."""
    found = {_FAMILY[k] for k in kinds if k in _FAMILY}
    if len(found - {1}) > 1 or (1 in found and len(found) > 1 and 8 not in found):
        raise ValueError("a shapefile holds one kind of geometry")
    return 8 if 8 in found else next(iter(found), 5)


def shp_records(geoms: Iterable[bytes | None], kind: int, first: int) -> tuple[bytes, list[int], tuple[float, float, float, float]]:
    """Records numbered from ``first``, the bytes that each takes without its head, and the box of all."""
    body, sizes, box = io.BytesIO(), [], NOWHERE
    for i, g in enumerate(geoms, first):
        k, shape = parse_wkb(g) if g else (0, [])
        parts = {1: [[shape]], 4: [shape], 2: [shape], 5: shape, 3: shape, 6: [r for p in shape for r in p] if k == 6 else []}.get(k, [])
        if kind == 5:
            groups = [shape] if k == 3 else shape if k == 6 else []
            parts = [(r if (_ring_area(r) < 0) == (j == 0) else r[::-1]) for p in groups for j, r in enumerate(p)]
        pts = [tuple(p) for part in parts for p in part]
        if not pts:
            record = struct.pack("<i", 0)
        else:
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            own = (min(xs), min(ys), max(xs), max(ys))
            box = (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
            flat = [v for p in pts for v in p]
            if kind == 1:
                record = struct.pack("<i2d", 1, *pts[0])
            elif kind == 8:
                record = struct.pack(f"<i4di{len(flat)}d", 8, *own, len(pts), *flat)
            else:
                starts, n = [], 0
                for p in parts:
                    starts.append(n)
                    n += len(p)
                record = struct.pack(f"<i4d2i{len(starts)}i{len(flat)}d", kind, *own, len(starts), n, *starts, *flat)
        sizes.append(len(record))
        body.write(struct.pack(">2i", i, len(record) // 2) + record)
    return body.getvalue(), sizes, box


def shp_head(size: int, kind: int, box) -> bytes:
    """The head of a .shp or .shx part with so many bytes after it."""
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i8d", 1000, kind, *(v if abs(v) != float("inf") else 0.0 for v in box), 0, 0, 0, 0)


def dbf_text(v, kind: str) -> bytes:
    if v is None:
        return b""
    if kind == "INTEGER":
        return str(int(v)).encode()
    if kind == "REAL":
        return repr(float(v)).encode()[:24]
    raw = str(v).encode()[:254]
    return raw.decode("utf-8", "ignore").encode()


def dbf_records(cells: list[list[bytes]], kinds: dict[str, str]) -> tuple[bytes, list[int]]:
    """Rows of texts without their marks, as wide as these rows need, and the widths."""
    widths = [max([1, *(len(row[i]) for row in cells)]) for i in range(len(kinds))]
    return b"".join(v.rjust(w) if k in ("INTEGER", "REAL") else v.ljust(w) for row in cells for v, w, k in zip(row, widths, kinds.values())), widths


def dbf_widened(data: bytes, n: int, own: list[int], widths: list[int], kinds: dict[str, str]) -> bytes:
    """The same rows with their marks, at other widths that are no less."""
    import numpy as np

    old, new = np.frombuffer(data, np.uint8).reshape(n, sum(own)), np.full((n, 1 + sum(widths)), 32, np.uint8)
    a, b = 0, 1
    for w, wide, k in zip(own, widths, kinds.values()):
        start = b + wide - w if k in ("INTEGER", "REAL") else b
        new[:, start : start + w] = old[:, a : a + w]
        a, b = a + w, b + wide
    return new.tobytes()


def dbf_head(n: int, widths: list[int], kinds: dict[str, str]) -> bytes:
    names: dict[str, str] = {}
    for c in kinds:  # ten bytes for a name, and no two alike
        short, k = c.encode()[:10].decode("utf-8", "ignore"), 1
        while short in names.values():
            k += 1
            short = f"{c.encode()[: 10 - len(str(k)) - 1].decode('utf-8', 'ignore')}_{k}"
        names[c] = short
    out = io.BytesIO()
    out.write(struct.pack("<4B I H H 20x", 3, 124, 1, 1, n, 33 + 32 * len(kinds), 1 + sum(widths)))
    for (c, k), w in zip(kinds.items(), widths):
        kind, places = ("N", 0) if k == "INTEGER" else ("F", 15) if k == "REAL" else ("C", 0)
        out.write(struct.pack("<11s c 4x B B 14x", names[c].encode(), kind.encode(), w, min(places, max(0, w - 2))))
    return out.getvalue() + b"\r"


def write_dbf(rows: list[dict], kinds: dict[str, str]) -> bytes:
    data, widths = dbf_records([[dbf_text(r.get(c), k) for c, k in kinds.items()] for r in rows], kinds)
    return dbf_head(len(rows), widths, kinds) + dbf_widened(data, len(rows), widths, widths, kinds) + b"\x1a"


# KML, GML, GPX


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _numbers(text: str | None) -> list[float]:
    return [float(v) for v in (text or "").replace(",", " ").split()]


def _kml_ring(e) -> list:
    text = next((x.text for x in e.iter() if _local(x.tag) == "coordinates"), "") or ""
    return [tuple(map(float, t.split(",")[:2])) for t in text.split()]


def _kml_geometry(e) -> bytes | None:
    kind = _local(e.tag)
    if kind == "Point":
        return wkb_point(*_kml_ring(e)[0])
    if kind == "LineString":
        return wkb_line(_kml_ring(e))
    if kind == "Polygon":
        outer = [_kml_ring(x) for x in e if _local(x.tag) == "outerBoundaryIs"]
        return wkb_polygon(outer[:1] + [_kml_ring(x) for x in e if _local(x.tag) == "innerBoundaryIs"])
    if kind == "MultiGeometry":
        parts = [p for p in map(_kml_geometry, e) if p]
        kinds = {struct.unpack_from("<I", p, 1)[0] for p in parts}
        return wkb_multi({1: 4, 2: 5, 3: 6}.get(kinds.pop(), 7) if len(kinds) == 1 else 7, parts)
    return None


def read_kml(data: bytes) -> list[Feature]:
    out = []
    for mark in (e for e in ET.fromstring(data).iter() if _local(e.tag) == "Placemark"):
        attrs, geom = {}, None
        for e in mark:
            kind = _local(e.tag)
            if kind in ("name", "description"):
                attrs[kind] = (e.text or "").strip() or None
            elif kind == "ExtendedData":
                for d in e.iter():
                    if _local(d.tag) == "SimpleData":
                        attrs[d.get("name")] = d.text
                    elif _local(d.tag) == "Data":
                        attrs[d.get("name")] = next((v.text for v in d if _local(v.tag) == "value"), None)
            else:
                geom = geom or _kml_geometry(e)
        out.append((geom, attrs))
    return out


def kml_frame(layer: str) -> tuple[bytes, bytes]:
    """What stands before and after the features."""
    name = ET.Element("name")
    name.text = layer
    return b"<?xml version='1.0' encoding='utf-8'?>\n<kml xmlns=\"http://www.opengis.net/kml/2.2\"><Document><Folder>" + ET.tostring(name, encoding="utf-8"), b"</Folder></Document></kml>"


def kml_features(features: Iterable[Feature], layer: str, kinds: dict[str, str], first: int = 0) -> Iterator[bytes]:
    def ring(parent, pts) -> None:
        ET.SubElement(parent, "coordinates").text = " ".join(f"{x!r},{y!r}" for x, y in pts)

    def add(parent, kind: int, c) -> None:
        if kind == 1:
            ring(ET.SubElement(parent, "Point"), [tuple(c)])
        elif kind == 2:
            ring(ET.SubElement(parent, "LineString"), c)
        elif kind == 3:
            p = ET.SubElement(parent, "Polygon")
            for i, r in enumerate(c):
                ring(ET.SubElement(ET.SubElement(p, "innerBoundaryIs" if i else "outerBoundaryIs"), "LinearRing"), r)
        else:
            m = ET.SubElement(parent, "MultiGeometry")
            for part in c:
                add(m, *((kind - 3, part) if kind < 7 else part))

    for g, a in features:
        mark = ET.Element("Placemark")
        data = ET.SubElement(mark, "ExtendedData")
        for c in kinds:
            if a.get(c) is not None:
                ET.SubElement(ET.SubElement(data, "Data", name=c), "value").text = str(a[c])
        if g:
            add(mark, *parse_wkb(g))
        yield ET.tostring(mark, encoding="utf-8")


def _gml_points(e) -> list:
    for x in e.iter():
        if _local(x.tag) in ("posList", "pos"):
            v = _numbers(x.text)
            step = int(x.get("srsDimension") or e.get("srsDimension") or 2)
            if _local(x.tag) == "pos":
                return [tuple(_numbers(y.text)[:2]) for y in e.iter() if _local(y.tag) == "pos"]
            return [tuple(v[i : i + 2]) for i in range(0, len(v), step)]
        if _local(x.tag) == "coordinates":
            return [tuple(map(float, t.split(",")[:2])) for t in (x.text or "").split()]
    return []


def _gml_geometry(e) -> bytes | None:
    kind = _local(e.tag)
    if kind == "Point":
        return wkb_point(*_gml_points(e)[0])
    if kind in ("LineString", "Curve"):
        return wkb_line(_gml_points(e))
    if kind in ("Polygon", "PolygonPatch", "Surface"):
        outer = [_gml_points(x) for x in e.iter() if _local(x.tag) in ("exterior", "outerBoundaryIs")]
        return wkb_polygon(outer[:1] + [_gml_points(x) for x in e.iter() if _local(x.tag) in ("interior", "innerBoundaryIs")])
    if kind.startswith("Multi"):
        parts = [g for m in e for x in m if (g := _gml_geometry(x))]
        return wkb_multi({"MultiPoint": 4, "MultiLineString": 5, "MultiCurve": 5, "MultiPolygon": 6, "MultiSurface": 6}.get(kind, 7), parts)
    return None


def read_gml(data: bytes) -> list[Feature]:
    out = []
    for member in (e for e in ET.fromstring(data).iter() if _local(e.tag) in ("featureMember", "member", "featureMembers")):
        for feature in member:
            attrs, geom = {}, None
            for e in feature:
                if len(e):
                    geom = geom or next((g for x in e if (g := _gml_geometry(x))), None)
                elif _local(e.tag) != "boundedBy":
                    attrs[_local(e.tag)] = (e.text or "").strip() or None
            out.append((geom, attrs))
    return out


def gml_frame(layer: str) -> tuple[bytes, bytes]:
    """What stands before and after the features."""
    return b"<?xml version='1.0' encoding='utf-8'?>\n<gml:FeatureCollection xmlns:gml=\"http://www.opengis.net/gml\" xmlns:ogr=\"http://example.org/layer\">", b"</gml:FeatureCollection>"


def gml_features(features: Iterable[Feature], layer: str, kinds: dict[str, str], first: int = 0) -> Iterator[bytes]:
    """GML 3 with longitude before latitude. Names that XML doesn't allow get underscores."""
    import re

    def name(s: str) -> str:
        s = re.sub(r"[^\w.-]", "_", s)
        return s if re.match(r"[A-Za-z_]", s) else f"_{s}"

    def add(parent, kind: int, c) -> None:
        def el(p, t):
            return ET.SubElement(p, f"gml:{t}")

        def many(p, pts):
            el(p, "posList").text = " ".join(f"{x!r} {y!r}" for x, y in pts)

        if kind == 1:
            el(el(parent, "Point"), "pos").text = f"{c[0]!r} {c[1]!r}"
        elif kind == 2:
            many(el(parent, "LineString"), c)
        elif kind == 3:
            p = el(parent, "Polygon")
            for i, r in enumerate(c):
                many(el(el(p, "interior" if i else "exterior"), "LinearRing"), r)
        else:
            outer, inner = {4: ("MultiPoint", "pointMember"), 5: ("MultiCurve", "curveMember"), 6: ("MultiSurface", "surfaceMember"), 7: ("MultiGeometry", "geometryMember")}[kind]
            m = el(parent, outer)
            for part in c:
                add(el(m, inner), *((kind - 3, part) if kind < 7 else part))

    for i, (g, a) in enumerate(features, first):
        member = ET.Element("gml:featureMember")
        f = ET.SubElement(member, f"ogr:{name(layer)}", {"gml:id": f"f{i}"})
        if g:
            add(ET.SubElement(f, "ogr:geometryProperty"), *parse_wkb(g))
        for c in kinds:
            if a.get(c) is not None:
                ET.SubElement(f, f"ogr:{name(c)}").text = str(a[c])
        yield ET.tostring(member, encoding="utf-8")


def read_gpx(data: bytes) -> list[Feature]:
    """Waypoints as points, routes as lines, tracks as multilines."""
    out = []

    def at(e) -> tuple[float, float]:
        return float(e.get("lon")), float(e.get("lat"))

    for e in ET.fromstring(data):
        kind = _local(e.tag)
        attrs = {_local(x.tag): (x.text or "").strip() or None for x in e if not len(x) and _local(x.tag) not in ("rtept", "trkseg")}
        if kind == "wpt":
            out.append((wkb_point(*at(e)), attrs))
        elif kind == "rte":
            out.append((wkb_line([at(x) for x in e if _local(x.tag) == "rtept"]), attrs))
        elif kind == "trk":
            out.append((wkb_multi(5, [wkb_line([at(x) for x in s if _local(x.tag) == "trkpt"]) for s in e if _local(s.tag) == "trkseg"]), attrs))
    return out


# large XML files

#: Elements of KML that are features, and elements of GML whose children are (fixed values).
_MARKS, _MEMBERS = ("Placemark",), ("featureMember", "member", "featureMembers")


def _utf8(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces in UTF-8, whatever the file's mark or declaration says that they are."""
    import codecs
    import re

    pieces = iter(pieces)
    first = next(pieces, b"")
    said = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([\w.:-]+)", first)
    name = "utf-16" if first[:2] in (b"\xff\xfe", b"\xfe\xff") else codecs.lookup(said[1].decode()).name if said else "utf-8"
    pieces = itertools.chain([first.removeprefix(codecs.BOM_UTF8)], pieces)
    if name in ("utf-8", "ascii"):
        yield from pieces
        return
    decoder = codecs.getincrementaldecoder(name)()
    for p in pieces:
        yield decoder.decode(p).encode()


def xml_documents(pieces: Iterable[bytes], kind: str, most: int = 1000, most_bytes: int = 1 << 20) -> Iterator[bytes]:
    """A KML or GML file that comes in pieces as documents of a few features each, which the readers take one by one.

    The parser itself tells where features begin and end. Each document has what stands before
    the root (without the declaration: all is UTF-8 now) and the elements round its features.
    What follows the root is left out.
    """
    import re
    from xml.parsers import expat
    from xml.sax.saxutils import quoteattr

    parser = expat.ParserCreate("utf-8")
    buffer, base, safe, depth, at, ended = bytearray(), 0, 0, 0, None, False
    unit_depth, prolog, weight = 0, b"", 0
    stack: list[tuple[str, dict]] = []
    held: list[bytes] = []
    ready: list[bytes] = []
    chain: list[tuple[str, dict]] = []

    def opened(e) -> bytes:
        return f"<{e[0]}{''.join(f' {k}={quoteattr(v)}' for k, v in e[1].items())}>".encode()

    def closed(e) -> bytes:
        return f"</{e[0]}>".encode()

    def flush() -> None:
        nonlocal weight
        weight = 0
        if held:
            ready.append(b"".join([prolog, *map(opened, chain), *held, *map(closed, reversed(chain))]))
            held.clear()

    def start(tag: str, attrs: dict) -> None:
        nonlocal depth, at, unit_depth, prolog, safe, own
        depth += 1
        if at is not None:
            return
        safe = parser.CurrentByteIndex
        if depth == 1:
            prolog = re.sub(rb"^\s*<\?xml.*?\?>", b"", bytes(buffer[: safe - base]), flags=re.S)
        if (tag.rsplit(":", 1)[-1] in _MARKS) if kind == ".kml" else bool(stack) and stack[-1][0].rsplit(":", 1)[-1] in _MEMBERS:
            at, unit_depth, own = safe, depth, (tag, attrs)
        else:
            stack.append((tag, attrs))

    def end(tag: str) -> None:
        nonlocal depth, at, safe, chain, ended, weight
        if at is None:
            stack.pop()
            safe = parser.CurrentByteIndex
        elif depth == unit_depth:
            here = parser.CurrentByteIndex
            # an element without content has no end tag of its own, and the parser stands behind it
            last = re.compile(rb"</" + re.escape(tag.encode()) + rb"\s*>").match(buffer, here - base)
            raw = bytes(buffer[at - base : last.end()]) if last else opened(own) + closed(own)
            around, member = (stack, None) if kind == ".kml" else (stack[:-1], stack[-1])
            if around != chain:
                flush()
                chain = list(around)
            held.append(raw if member is None else opened(member) + raw + closed(member))
            at, safe = None, here
            weight += len(raw)
            if len(held) >= most or weight >= most_bytes:
                flush()
        depth -= 1
        ended = not depth

    own: tuple[str, dict] = ("", {})
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        for p in _utf8(pieces):
            buffer += p
            parser.Parse(p, False)
            keep = safe if at is None else at
            if depth and keep > base:
                del buffer[: keep - base]
                base = keep
            yield from ready
            ready.clear()
        parser.Parse(b"", True)
    except expat.ExpatError:
        if not ended:
            raise
    flush()
    yield from ready


# archives


def expand(files: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) with ZIP archives opened; folders, empty entries and resource forks are left out."""
    for name, data in files:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for entry in z.namelist():
                    if not entry.startswith("__MACOSX/") and not entry.endswith("/") and z.getinfo(entry).file_size:
                        yield entry, z.read(entry)
        else:
            yield name, data
