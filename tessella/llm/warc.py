"""WARC: reading records, and resolving not-modified revisits against earlier full responses."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship

#: Response headers that a 304 must not change: what belongs to the connection, and what describes the stored body (fixed values).
KEPT_FROM_ORIGINAL = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that name no other document (fixed values).
TRACKING = "utm_[^=]*|gclid|fbclid"

RECORDS = "record_id long, kind string, url string, captured_at long, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and leading www, path without trailing slashes, and sorted parameters without tracking ones.

    Scheme and fragment are dropped. Null stays null.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    for drop in ("^.*@", ":(80|443)$", r"^www\d*\."):
        host = F.regexp_replace(host, drop, "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*(/[^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    query = F.array_join(params, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _bare(etag: str) -> str:
    return etag[2:] if etag.startswith(("W/", "w/")) else etag


def judge(own: dict, own_digest: str | None, old: dict, old_digest: str | None) -> str:
    """Whether a not-modified revisit belongs to the response before it.

    Entity tags decide where both have one (compared weakly), else modification dates where
    both have one. Payload digests, where both have one, must agree too. Without anything to
    compare the revisit stays unverified.
    """
    checked = False
    if own.get("etag") and old.get("etag"):
        if _bare(own["etag"]) != _bare(old["etag"]):
            return "etag_mismatch"
        checked = True
    elif own.get("last-modified") and old.get("last-modified"):
        if own["last-modified"] != old["last-modified"]:
            return "date_mismatch"
        checked = True
    if own_digest and old_digest:
        if own_digest != old_digest:
            return "digest_mismatch"
        checked = True
    return "resolved" if checked else "unverified"


def merge_headers(old: dict, own: dict) -> dict:
    """The stored headers, updated with those that a 304 may change."""
    fixed = {*KEPT_FROM_ORIGINAL, *(x.strip().lower() for x in own.get("connection", "").split(","))}
    return old | {k: v for k, v in own.items() if k not in fixed}


_OUT = "record_id long, canonical_url string, kind string, captured_at long, outcome string, original_id long, status int, headers map<string,string>, digest string"


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per record: what it is worth on its own or together with the response it revisits.

    ``records`` has the columns of :data:`RECORDS` (others are ignored); ``captured_at`` is a
    number that grows with time. Full responses (kind ``response``, status 200 or 203) get
    outcome ``full``; other records that aren't revisits ``other``. A record of kind
    ``revisit`` meets the latest earlier full response of its canonical URL (by time, then id):
    without one its outcome is ``missing``, else what :func:`judge` says. Resolved revisits
    carry the original's id, status and digest, and the merged headers; the rest keep their own.

    The as-of join is one range partitioning by URL, time and id, so that a URL with a third of
    all captures spreads over many tasks; a task hands on at most the last full response of its
    last URL, one row for each partition, and reads its rows one after the other.

    Null or empty URLs match nothing. A null time comes before all others, and null ids before
    others of the same time; repeated rows stay. Null headers count as none. An empty table gives no rows.
    """
    ship(records.sparkSession)
    spark = records.sparkSession
    entries = F.expr("transform(map_entries(coalesce(headers, map())), e -> struct(lower(trim(e.key)) as key, e.value as value))")
    rows = records.select(
        "record_id", F.nullif(canonical_url(F.col("url")), F.lit("")).alias("key"), "kind", "captured_at", "status", F.filter(entries, lambda e: e["value"].isNotNull()).alias("headers"), "digest"
    )
    rows = cut(rows)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, "key", "captured_at", "record_id").sortWithinPartitions("key", "captured_at", "record_id"))

    def is_full(kind: str | None, status: int | None) -> bool:
        return kind == "response" and status in (200, 203)

    def unpack(entries) -> dict:
        return {e["key"]: e["value"] for e in entries or []}

    def last_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = key = None
        full, any_row = None, False
        for b in batches:
            keys, kinds, states = (b.column(i).to_pylist() for i in (1, 2, 4))
            for i, k in enumerate(keys):
                if not any_row:
                    first, any_row = k, True
                if k != key:
                    key, full = k, None
                if k is not None and is_full(kinds[i], states[i]):
                    full = b.slice(i, 1)
        if any_row:
            row = full.to_pylist()[0] if full is not None else {"record_id": None, "status": None, "headers": None, "digest": None}
            kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
            cols = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([first], pa.string()), pa.array([key], pa.string()), pa.array([full is not None])]
            cols += [pa.array([row["record_id"]], pa.int64()), pa.array([row["status"]], pa.int32()), pa.array([row["headers"]], kind), pa.array([row["digest"]], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "first", "last", "has", "record_id", "status", "headers", "digest"])

    ends = dealt.mapInArrow(last_full, "part long, first string, last string, has boolean, record_id long, status int, headers array<struct<key:string,value:string>>, digest string").collect()
    before: dict[int, tuple] = {}  # partition -> the full response that its first URL comes with
    prev, come = None, None
    for e in sorted(ends, key=lambda r: r.part):
        found = None
        if prev is not None and prev.last is not None and prev.last == e.first:
            found = (prev.record_id, prev.status, unpack([h.asDict() for h in prev.headers]), prev.digest) if prev.has else (come if prev.first == prev.last else None)
        if found:
            before[e.part] = (e.first, found)
        prev, come = e, found
    shared = spark.sparkContext.broadcast(before)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, full = shared.value.get(TaskContext.get().partitionId(), (None, None))
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for r in b.to_pylist():
                own = unpack(r["headers"])
                if r["key"] != key:
                    key, full = r["key"], None
                outcome, source, status, digest = "other", None, r["status"], r["digest"]
                if is_full(r["kind"], r["status"]):
                    outcome, source = "full", r["record_id"]
                    if key is not None:
                        full = (r["record_id"], r["status"], own, r["digest"])
                elif r["kind"] == "revisit":
                    outcome = "missing" if full is None else judge(own, r["digest"], full[2], full[3])
                    if outcome == "resolved":
                        source, status, digest = full[0], full[1], full[3]
                        own = merge_headers(full[2], own)
                for col, x in zip(out, (r["record_id"], r["key"], r["kind"], r["captured_at"], outcome, source, status, list(own.items()), digest)):
                    col.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in _OUT.split(", ")])

    return dealt.mapInArrow(resolve, _OUT)


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or with a gzip member for each record; a broken end is left out.

    Each has its WARC headers (names in lower case) and its block.
    """
    if data[:2] == b"\x1f\x8b":
        rest = data
        while rest[:2] == b"\x1f\x8b":
            run = zlib.decompressobj(31)
            try:
                own = run.decompress(rest)
            except zlib.error:
                return
            if not run.eof:
                return
            rest = run.unused_data
            yield from parse_warc(own)
        return
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            return
        headers = {}
        for line in data[start:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        if stop + 4 + size > len(data):
            return
        yield {"warc": headers, "block": data[stop + 4 : stop + 4 + size]}
        at = stop + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records below ``path`` in the columns of :data:`RECORDS`, with file, date and payload.

    One task reads a file. ``record_id`` numbers records by file and place in it, ``captured_at``
    is the record's date in seconds (null if it can't be read).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "id string, kind string, url string, date string, status int, headers map<string,string>, digest string, payload binary, file string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.string(), pa.int64()]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                held: list[tuple] = []
                for n, r in enumerate(parse_warc(data.as_py())):
                    w, block = r["warc"], r["block"]
                    if w.get("warc-type") not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    first, *rest = head.decode("latin-1").split("\r\n")
                    status = first.split(" ")[1] if first.startswith("HTTP/") and first.count(" ") else ""
                    fields = {}
                    for line in rest:
                        k, _, v = line.partition(":")
                        fields[k.strip().lower()] = v.strip()
                    held.append((w.get("warc-record-id"), w["warc-type"], w.get("warc-target-uri", "").strip("<>"), w.get("warc-date"), int(status) if status.isdigit() else None, list(fields.items()), w.get("warc-payload-digest"), body, name, n))
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], [x.split()[0] for x in schema.split(", ")])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], [x.split()[0] for x in schema.split(", ")])

    found = files.mapInArrow(run, schema)
    return found.select(F.xxhash64("file", "n").alias("record_id"), "kind", "url", F.unix_seconds(F.try_to_timestamp("date")).alias("captured_at"), "status", "headers", "digest", "payload", "file", "date", F.col("id").alias("warc_id"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of each raw page, in the columns of :data:`RECORDS`: a full response, and a later not-modified revisit.

    The crawl of the pages gives one response each; the revisit repeats its address with other
    letter case, tracking parameter or fragment, and its entity tag, which is stale for every
    seventh page. Times count seconds; the second crawl begins after the first.
    """
    html, n = F.coalesce("html", F.lit("")), F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    first = F.struct(
        (n * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        F.col("url"),
        n.alias("captured_at"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(html).cast("string"), F.lit("ETag"), tag, F.lit("Date"), n.cast("string")).alias("headers"),
        F.sha2(html, 256).alias("digest"),
    )
    stale = F.when(n % 7 == 0, F.lit('"gone"')).otherwise(F.concat(F.lit("W/"), tag))
    later = n + F.lit(1 << 40)
    url = F.when(n % 3 == 0, F.concat("url", F.lit("#top"))).when((n % 3 == 1) & ~F.col("url").contains("?") & ~F.col("url").contains("#"), F.concat("url", F.lit("?utm_source=again"))).otherwise(F.col("url"))
    again = F.struct(
        (n * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        url.alias("url"),
        later.alias("captured_at"),
        F.lit(304).alias("status"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), stale, F.lit("Date"), later.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return pages.select(F.explode(F.array(first, again)).alias("r")).select("r.*")
