"""ARC parsing, WARC files and revisits."""

import hashlib

import pytest

from veilwork.llm import archive

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(html) if len(data) >= 100 else None
        again = f is not None and (i is None or i > f)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in archive.convert_pages(df).collect()), key=repr)


def test_pages(spark, monkeypatch):
    long = "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [
        (5, "http://a b/\n", long), (3, "http://x", long), (9, None, long), (3, "http://x", long),
        (1, "", None), (2, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "x" * 100), (8, "u", "x" * 100),
        (None, "u", long), (None, "u", "only" * 50), (-12, "u", "y" * 3_000_000), (2**62, "u", "y" * 3_000_000),
        (10, "u", "HTTP/1.0 200\r\n\r\nbody" * 20), (11, "u", "\x00\x01 ﷐"),
    ]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_long_and_odd_urls(spark):
    rows = [(1, "http://x", "a"), (2, "data:," + "x" * 70_000, "b"), (3, "filedesc://x y", "c" * 200),
            (4, "filedesc://x", "1 0 veilwork\n"), (5, "http://y", "d"), (6, None, "c" * 200)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).coalesce(1)
    assert sorted((tuple(r) for r in archive.convert_pages(df).collect()), key=repr) == expected(rows)


def test_pages_are_not_lost_silently(spark, monkeypatch):
    broken = spark.createDataFrame([("f", b"nonsense\n")], "path string, content binary")
    monkeypatch.setattr(archive, "pack_arc", lambda *_: broken)
    with pytest.raises(ValueError, match="archive f cannot be read"):
        archive.convert_pages(spark.createDataFrame([(1, "u", "x", "")], SCHEMA)).collect()


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    rows += [(r[0] + 10_000, *r[1:]) for r in rows[::3]]
    assert run(spark, rows) == expected(rows)


def arc(version, records, fields=None):
    block = f"{version} 0 test\n{fields or archive.FIELDS[version]}\n".encode()
    more = " 200 - - 0 f.arc" if version == 2 else ""
    out = f"filedesc://f.arc 0.0.0.0 19990101000000 text/plain{more} {len(block)}\n".encode() + block + b"\n"
    for url, kind, body in records:
        more = " 404 abc - 77 f.arc" if version == 2 else ""
        out += f"{url} 10.0.0.1 19990203040506 {kind}{more} {len(body)}\n".encode() + body + b"\n"
    return out


def test_versions_and_broken_archives(spark, tmp_path):
    good = [("http://a/with space", "text/html", b"HTTP/1.0 200 OK\r\nX-Archive-Id: 4\r\n\r\nhello\nhttp://no 1 2 3 4"),
            ("dns:b", "text/dns", b"\xff\xfe\x00raw")]
    contents = [arc(1, good), arc(2, good), arc(1, good)[:-10], b"", b"nonsense\n", arc(2, good) + b"\nhttp://x short 5\nabcde\n"]
    df = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content binary")
    rows = archive.read_arc(df).collect()
    of = lambda i: [r for r in rows if r["archive"] == f"f{i}"]
    for i in (0, 1):
        page, dns = of(i)
        assert (page["source_id"], page["url"], page["ip"], page["date"]) == (4, "http://a/with space", "10.0.0.1", "19990203040506")
        assert bytes(page["payload"]) == b"hello\nhttp://no 1 2 3 4" and bytes(dns["payload"]) == b"\xff\xfe\x00raw"
        assert dns["mime"] == "text/dns" and not dns["head"]
    assert [r["error"] is None for r in of(2)] == [True, False]
    assert of(3) == [] and of(4)[0]["error"] and [r["error"] is None for r in of(5)] == [True, True, False]
    errors = archive.write_warc(df, f"{tmp_path}/warc").collect()
    assert {r["archive"] for r in errors} == {"f2", "f4", "f5"}
    back = archive.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(back) == 7 and all(r["intact"] for r in back)
    assert {r["record_type"] for r in back} == {"response", "resource"}
    assert {r["date"] for r in back} == {"1999-02-03T04:05:06Z"}
    assert len({r["record_id"] for r in back}) == 7
