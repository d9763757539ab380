import gzip
import random

from pyspark.sql import functions as F

from tessella.llm.warc import canonical_url, judge, merge_headers, parse_warc, read_warc, resolve_revisits

SCHEMA = "record_id long, kind string, url string, captured_at long, status int, headers map<string,string>, digest string, key string, part int"


def test_canonical_url(spark):
    cases = {
        "HTTP://www.Example.com:80/a/?b=2&a=1&utm_source=x#top": "example.com/a?a=1&b=2",
        "https://user@www2.example.com/A//": "example.com/A",
        "example.com": "example.com",
        "https://example.com/?gclid=1": "example.com",
        "https://example.com:8080/x?gclidx=1&": "example.com:8080/x?gclidx=1",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == cases


def brute(rows):
    out = {}
    for r in rows:
        i, kind, url, at, status, headers, digest = r[:7]
        own = {k.lower(): v for k, v in (headers or {}).items() if v is not None}
        if kind == "response" and status in (200, 203):
            out[i] = ("full", i)
        elif kind != "revisit":
            out[i] = ("other", None)
        else:
            past = [p for p in rows if p[1] == "response" and p[4] in (200, 203) and p[2] == url and url and (p[3] if p[3] is not None else -1, p[0]) < (at if at is not None else -1, i)]
            if not past:
                out[i] = ("missing", None)
            else:
                last = max(past, key=lambda p: (p[3] if p[3] is not None else -1, p[0]))
                said = judge(own, digest, {k.lower(): v for k, v in (last[5] or {}).items()}, last[6])
                out[i] = (said, last[0] if said == "resolved" else None)
    return out


def test_as_of_join_matches_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        url = rng.choice(["hot.example.com/x"] * 6 + ["b.org", "c.org/1", "d.org", "", None])
        kind = rng.choice(["response", "revisit", "revisit", "revisit", "request"])
        tag = {"ETag": rng.choice(['"1"', 'W/"1"', '"2"'])} if rng.random() < 0.7 else {"last-modified": rng.choice("ab")} if rng.random() < 0.7 else None
        rows.append((i, kind, url, rng.choice([None, *range(200)]), rng.choice([200, 200, 404, None]) if kind == "response" else 304, tag, rng.choice([None, None, "s1", "s2"]), "k", 1))
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(5), partitions=9).collect()
    assert {r.record_id: (r.outcome, r.original_id) for r in got} == brute(rows) and len(got) == len(rows)


def test_one_url_over_many_partitions(spark):
    rows = [(0, "response", "a.b", 0, 200, {"etag": "1", "Content-Type": "t"}, "d", "k", 1)] + [(i, "revisit", "a.b", i, 304, {"etag": "1", "content-type": "no", "x": str(i)}, None, "k", 1) for i in range(1, 400)]
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA), partitions=13).where("kind = 'revisit'").collect()
    assert len(got) == 399
    assert all((r.outcome, r.original_id, r.status, r.digest, r.headers) == ("resolved", 0, 200, "d", {"etag": "1", "content-type": "t", "x": str(r.record_id)}) for r in got)


def test_edges(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, None, None, None, None, None), (1, "response", "u.v", 5, 200, None, None, None, None), (1, "response", "u.v", 5, 200, None, None, None, None), (2, "revisit", "u.v", 6, 304, None, None, "k", 2)]
    out = resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.outcome for r in out) == ["full", "full", "other", "unverified"]
    assert merge_headers({"a": "1", "via": "x"}, {"connection": "Via, close", "via": "y", "a": "2", "content-length": "0"}) == {"a": "2", "via": "x"}


def record(kind, n, status, body, extra=""):
    block = f"HTTP/1.1 {status} X\r\nETag: \"e{n}\"\r\n\r\n".encode() + body
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{n}>\r\nWARC-Target-URI: http://h.org/{n}\r\nWARC-Date: 2024-01-0{n}T00:00:00Z\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_read_warc(spark, tmp_path):
    own = [record("response", 1, 200, b"WARC/1.0 in the body\r\n\r\n"), record("revisit", 2, 304, b""), record("request", 3, 200, b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(own))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, own)) + b"\x1f\x8bbroken")
    rows = read_warc(spark, str(tmp_path)).orderBy("file", "captured_at").collect()
    assert [(r.kind, r.url, r.status, r.headers) for r in rows] == [("response", "http://h.org/1", 200, {"etag": '"e1"'}), ("revisit", "http://h.org/2", 304, {"etag": '"e2"'})] * 2
    assert bytes(rows[0].payload) == b"WARC/1.0 in the body\r\n\r\n" and rows[0].captured_at == 1704067200
    assert list(parse_warc(own[0][:-30])) == [] and list(parse_warc(b"")) == []
    assert read_warc(spark, str(tmp_path)).selectExpr("record_id", "kind", "url", "captured_at", "status", "headers", "digest").transform(resolve_revisits).count() == 4
