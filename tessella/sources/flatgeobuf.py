"""FlatGeobuf files: the flatbuffer tables of header and features, read and written without a spatial index."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from .formats import Feature, parse_wkb, wkb_line, wkb_multi, wkb_point, wkb_polygon

MAGIC = b"fgb\x03fgb\x00"
#: Column types by number: struct format, or None for text and bytes with a length (fixed values).
_KINDS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d", 11: None, 12: None, 13: None, 14: None}


class _Table:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.fields = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.fields)[0]

    def where(self, k: int) -> int:
        slot = 4 + 2 * k
        off = struct.unpack_from("<H", self.data, self.fields + slot)[0] if slot < self.size else 0
        return self.at + off if off else 0

    def number(self, k: int, kind: str, default=0):
        at = self.where(k)
        return struct.unpack_from(f"<{kind}", self.data, at)[0] if at else default

    def jump(self, k: int) -> int:
        at = self.where(k)
        return at + struct.unpack_from("<I", self.data, at)[0] if at else 0

    def text(self, k: int) -> str | None:
        raw = self.vector(k, "B")
        return bytes(raw).decode() if raw is not None else None

    def vector(self, k: int, kind: str):
        at = self.jump(k)
        if not at:
            return None
        (n,) = struct.unpack_from("<I", self.data, at)
        if kind == "B":
            return self.data[at + 4 : at + 4 + n]
        return struct.unpack_from(f"<{n}{kind}", self.data, at + 4)

    def table(self, k: int) -> "_Table | None":
        at = self.jump(k)
        return _Table(self.data, at) if at else None

    def tables(self, k: int) -> list["_Table"]:
        at = self.jump(k)
        if not at:
            return []
        (n,) = struct.unpack_from("<I", self.data, at)
        return [_Table(self.data, at + 4 + 4 * i + struct.unpack_from("<I", self.data, at + 4 + 4 * i)[0]) for i in range(n)]


def _root(data: bytes) -> _Table:
    return _Table(data, struct.unpack_from("<I", data, 0)[0])


def _shape(t: _Table, kind: int) -> bytes | None:
    kind = t.number(6, "B", 0) or kind
    xy = t.vector(1, "d") or ()
    pts = list(zip(xy[::2], xy[1::2]))
    if kind == 6 or kind == 7:
        parts = [p for x in t.tables(7) if (p := _shape(x, 3 if kind == 6 else 0))]
        return wkb_multi(kind, parts)
    if not pts:
        return None
    ends = list(t.vector(0, "I") or [len(pts)])
    runs = [pts[a:b] for a, b in zip([0, *ends], ends)]
    return {1: lambda: wkb_point(*pts[0]), 2: lambda: wkb_line(pts), 3: lambda: wkb_polygon(runs), 4: lambda: wkb_multi(4, [wkb_point(*p) for p in pts]), 5: lambda: wkb_multi(5, list(map(wkb_line, runs)))}[kind]()


def read(data: bytes) -> tuple[list[Feature], int]:
    """Features in file order and the reference system."""
    if data[:3] != b"fgb":
        raise ValueError("not a FlatGeobuf file")
    (size,) = struct.unpack_from("<I", data, 8)
    head = _root(data[12 : 12 + size])
    kind, cols = head.number(2, "B"), [(c.text(0), c.number(1, "B")) for c in head.tables(7)]
    count, node = head.number(8, "Q"), head.number(9, "H", 16)
    crs = head.table(10)
    srid = crs.number(1, "i") if crs else 0
    at = 12 + size
    if node and count:
        n, nodes = count, count
        while n > 1:
            n = -(-n // node)
            nodes += n
        at += nodes * 40
    out = []
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        f = _root(data[at + 4 : at + 4 + size])
        at += 4 + size
        g = f.table(0)
        own = cols or [(c.text(0), c.number(1, "B")) for c in f.tables(2)]
        attrs: dict = dict.fromkeys(c for c, _ in own)
        raw, p = bytes(f.vector(1, "B") or b""), 0
        while p + 2 <= len(raw):
            (k,) = struct.unpack_from("<H", raw, p)
            name, form = own[k][0], _KINDS[own[k][1]]
            p += 2
            if form:
                attrs[name] = struct.unpack_from(f"<{form}", raw, p)[0]
                p += struct.calcsize(f"<{form}")
            else:
                (n,) = struct.unpack_from("<I", raw, p)
                attrs[name] = raw[p + 4 : p + 4 + n].decode("utf-8", "replace")
                p += 4 + n
        out.append((_shape(g, kind) if g else None, attrs))
    return out, srid if srid > 0 else 4326


def _pack(fields: dict[int, tuple[str, object]]) -> bytes:
    """One flatbuffer table: scalars inline, then what offsets point to. Kinds: a struct format, or text, bytes, doubles, uints, table, tables."""
    slots, inline, at = max(fields, default=-1) + 1, [], 4
    for k, (kind, v) in sorted(fields.items(), key=lambda f: -(struct.calcsize(f"<{f[1][0]}") if len(f[1][0]) == 1 else 4)):
        size = struct.calcsize(f"<{kind}") if len(kind) == 1 else 4
        at += -at % size
        inline.append((k, kind, v, at))
        at += size
    body = bytearray(at + (-at % 8))
    head = struct.pack("<2H", 4 + 2 * slots, at) + b"".join(struct.pack("<H", next((o for k, _, _, o in inline if k == s), 0)) for s in range(slots))
    pad = -len(head) % 8
    tail = bytearray()
    for _, kind, v, o in inline:
        if len(kind) == 1:
            struct.pack_into(f"<{kind}", body, o, v)
            continue
        if kind == "tables":
            start, block = len(body) + len(tail), bytearray()
            spots = []
            for t in v:
                block += b"\0" * (-len(block) % 8)
                spots.append(len(block))
                block += t
            gap = 4 + 4 * len(v)
            gap += -(start + gap) % 8
            lead = bytearray(gap)
            struct.pack_into("<I", lead, 0, len(v))
            for i, (s, t) in enumerate(zip(spots, v)):
                root = struct.unpack_from("<I", t, 0)[0]
                struct.pack_into("<I", lead, 4 + 4 * i, gap + s + root - (4 + 4 * i))
            struct.pack_into("<I", body, o, start - o)
            tail += lead + block
        elif kind == "table":
            tail += b"\0" * (-(len(body) + len(tail)) % 8)
            start = len(body) + len(tail)
            struct.pack_into("<I", body, o, start + struct.unpack_from("<I", v, 0)[0] - o)
            tail += v
        else:
            data, n, align = {"text": lambda: (v.encode() + b"\0", len(v.encode()), 4), "bytes": lambda: (v, len(v), 4), "doubles": lambda: (struct.pack(f"<{len(v)}d", *v), len(v), 8), "uints": lambda: (struct.pack(f"<{len(v)}I", *v), len(v), 4)}[kind]()
            tail += b"\0" * (-(len(body) + len(tail) + 4) % align)
            tail += b"\0" * (-(len(body) + len(tail)) % 4)
            struct.pack_into("<I", body, o, len(body) + len(tail) - o)
            tail += struct.pack("<I", n) + data
        tail += b"\0" * (-(len(body) + len(tail)) % 4)
    lead = 4 + (-4 % 8)
    start = lead + len(head) + pad
    out = bytearray(struct.pack("<I", start)) + b"\0" * (lead - 4) + b"\0" * pad + head
    struct.pack_into("<i", body, 0, len(head))
    return bytes(out + body + tail)


def _shape_table(kind: int, c) -> bytes:
    if kind == 6:
        return _pack({6: ("B", 6), 7: ("tables", [_shape_table(3, p) for p in c])})
    if kind == 7:
        return _pack({6: ("B", 7), 7: ("tables", [_shape_table(*p) for p in c])})
    runs = {1: [[c]], 2: [c], 3: c, 4: [c], 5: c}[kind]
    ends, n = [], 0
    for r in runs:
        n += len(r)
        ends.append(n)
    fields = {1: ("doubles", [v for r in runs for p in r for v in p]), 6: ("B", kind)}
    if kind in (3, 5) and len(runs) > 1:
        fields[0] = ("uints", ends)
    return _pack(fields)


def write(features: Iterable[Feature], layer: str, kinds: dict[str, str]) -> bytes:
    """A FlatGeobuf file in EPSG:4326 without an index. ``kinds`` gives SQL types by column."""
    rows = list(features)
    code = {"INTEGER": 7, "REAL": 10}
    cols = [_pack({0: ("text", c), 1: ("B", code.get(k, 11))}) for c, k in kinds.items()]
    crs = _pack({0: ("text", "EPSG"), 1: ("i", 4326)})
    head = _pack({0: ("text", layer), 2: ("B", 0), 7: ("tables", cols), 8: ("Q", len(rows)), 9: ("H", 0), 10: ("table", crs)})
    out = [MAGIC, struct.pack("<I", len(head)), head]
    for g, a in rows:
        raw = b""
        for i, (c, k) in enumerate(kinds.items()):
            v = a.get(c)
            if v is None:
                continue
            if k == "INTEGER":
                raw += struct.pack("<Hq", i, int(v))
            elif k == "REAL":
                raw += struct.pack("<Hd", i, float(v))
            else:
                data = str(v).encode()
                raw += struct.pack("<HI", i, len(data)) + data
        fields: dict = {1: ("bytes", raw)} if raw else {}
        if g:
            fields[0] = ("table", _shape_table(*parse_wkb(g)))
        f = _pack(fields)
        out += [struct.pack("<I", len(f)), f]
    return b"".join(out)
