"""Legacy ARC archives to WARC files, with identical payloads as revisits, and back.

An ARC file begins with a version block that names its version and the fields of
its header lines; each record is such a line and as many bytes as it declares.
Version 1 has URL, address, date, type and length; version 2 also a result code,
checksum, location, offset and file name.  The converter makes record
identifiers, timestamps, types and digests from these.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.llm.common import cut, join_small
from veilwork.session import run_dir

#: Fixed values of the formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
RECORDS_PER_FILE = 4000

ARC_SCHEMA = "path string, content binary"
RECORD_SCHEMA = (
    "archive string, place long, source_id long, url string, ip string, date string, mime string, "
    "head binary, payload binary, digest string, error string"
)
READ_SCHEMA = (
    "source_id long, record_id string, url string, date string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, intact boolean"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _arrow(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _quoted(url: str | None) -> str:
    """No white space or control character, as a header line needs it."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0]", lambda m: f"%{ord(m[0]) & 255:02X}", url or "") or "-"


def _stamp(number: int | None) -> str:
    """A 14-digit date that goes with the row."""
    n = (number or 0) % (28 * 12 * 24 * 3600 * 20)
    n, second = divmod(n, 60)
    n, minute = divmod(n, 60)
    n, hour = divmod(n, 24)
    n, day = divmod(n, 28)
    year, month = divmod(n, 12)
    return f"{1996 + year:04d}{month + 1:02d}{day + 1:02d}{hour:02d}{minute:02d}{second:02d}"


def pack_arc(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as legacy archives (path, content) of about ``ARCHIVE_BYTES``, in both versions by turns.

    A record is an HTTP response that carries the key; a null body is empty.
    """
    schema = _arrow(ARC_SCHEMA)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size, number, version = 0, 0, 1

        def closed() -> pa.RecordBatch:
            content = b"".join(parts)
            name = f"{hashlib.sha256(content).hexdigest()[:32]}-v{version}.arc"
            return _batch([(name, content)], schema)

        for batch in batches:
            for k, u, b in zip(*(batch.column(i) for i in range(3))):
                if not parts:
                    version = 1 + number % 2
                    block = f"{version} 0 veilwork\n{FIELDS[version]}\n".encode()
                    more = " 200 - - 0 pages.arc" if version == 2 else ""
                    parts.append(f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain{more} {len(block)}\n".encode() + block + b"\n")
                k, payload = k.as_py(), b.as_py() or b""
                content = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nX-Archive-Id: %s\r\n\r\n" % (
                    b"" if k is None else str(k).encode()
                ) + payload
                more = f" 200 {hashlib.md5(content).hexdigest()} - {size} pages.arc" if version == 2 else ""
                line = f"{_quoted(u.as_py())} 0.0.0.0 {_stamp(k)} text/html{more} {len(content)}\n"
                parts += [line.encode(), content, b"\n"]
                size += len(line) + len(content)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield closed()

    chosen = pages.select(
        F.col(f"`{key}`").cast("long"), F.col(f"`{url}`").cast("string"), F.col(f"`{body}`").cast("binary")
    )
    return chosen.mapInArrow(pack, ARC_SCHEMA)


def parse_arc(path: str, content: bytes) -> Iterator[tuple]:
    """Records of one archive in order.  What cannot be read ends in one row with an error."""
    at, place, names, begun = 0, 0, FIELDS[1].split(), None
    view = memoryview(content)

    def broken(why: str) -> tuple:
        return path, place, None, None, None, None, None, None, None, None, f"{why} at byte {at}"

    while at < len(content):
        if content[at:at + 1] == b"\n":  # records are set apart by one line break or more
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            yield broken("no header line")
            return
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        # a URL may hold spaces; the fields behind it do not
        values = line.rsplit(" ", len(names) - 1)
        # a version block may have other fields than the records
        described = line.startswith("filedesc://")
        length = values[-1] if described or len(values) == len(names) else ""
        if not length.isdigit() or end + 1 + int(length) > len(content):
            yield broken("bad header line or length")
            return
        body = bytes(view[end + 1:end + 1 + int(length)])
        first = begun is None
        begun, at = at, end + 1 + int(length)
        if described:
            rows = body[:65_536].decode("utf-8", "replace").split("\n")
            version = rows[0].split(" ")[0]
            listed = rows[1].split() if len(rows) > 1 else []
            told = bool(listed) and listed[0] == "URL" and listed[-1] == "Archive-length"
            if told:
                names = listed
            elif first and version in ("1", "2"):
                names = FIELDS[int(version)].split()
            # elsewhere than in front, only a list of fields makes a version block (of an archive
            # that was appended); any other is a page with such a URL
            if first or told:
                continue
            if len(values) != len(names):
                at = begun
                yield broken("bad header line or length")
                return
        of = dict(zip(names, values))
        head, payload, source = b"", body, None
        if body.startswith(b"HTTP/"):
            cut_at = body.find(b"\r\n\r\n")
            if cut_at >= 0:
                head, payload = body[:cut_at + 4], body[cut_at + 4:]
                found = re.search(rb"\r\nX-Archive-Id: (-?\d{1,19})\r\n", head)
                source = int(found[1]) if found else None
        yield (
            path, place, source, of["URL"], of.get("IP-address"), of.get("Archive-date"),
            of.get("Content-type"), head, payload, hashlib.sha256(payload).hexdigest(), None,
        )
        place += 1


def read_arc(archives: DataFrame) -> DataFrame:
    """Records of archives (path, content), as the ``binaryFile`` source gives them too."""
    schema = _arrow(RECORD_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in parse_arc(path.as_py(), content.as_py() or b""):
                    rows.append(row)
                    size += len(row[8] or b"")
                    if size > ARCHIVE_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return archives.select("path", "content").mapInArrow(parse, RECORD_SCHEMA)


def _uuid(*parts) -> "F.Column":
    """An identifier made of a digest: the same record gets the same one again."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def write_warc(archives: DataFrame, out: str, min_bytes: int = 100) -> DataFrame:
    """Convert archives to gzipped WARC files below ``out``; the records that could not be read.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the
    smallest source id are responses, the others revisits that refer to it; records
    without an id are never referred to.  Payloads are not shuffled: only source
    ids and digests are, and what is joined has one row per repeated digest.
    """
    records = read_arc(archives)
    light = cut(
        records.select("source_id", "digest", F.octet_length("payload").alias("n"), "error", "archive", "place"),
        "warc-light",
    )
    first = cut(
        light.where((F.col("n") >= min_bytes) & F.col("source_id").isNotNull())
        .groupBy("digest").agg(F.min("source_id").alias("first"), F.count("*").alias("times"))
        .where("times > 1").select("digest", "first"),
        "warc-repeated",
    )
    r = join_small(records.where("error IS NULL"), first, ["digest"], "left")
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= min_bytes) & (
        F.col("source_id").isNull() | (F.col("source_id") > F.col("first"))
    )
    r = r.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    block = F.when(F.col("revisit"), F.col("head")).otherwise(F.concat("head", "payload"))
    r = r.withColumn("block", block)
    http = F.octet_length("head") > 0
    own = F.coalesce(F.col("source_id").cast("string"), F.lit(""))
    when = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").when(http, "response").otherwise("resource")),
        F.concat(F.lit("WARC-Record-ID: "), _uuid("archive", F.col("place").cast("string"), "url", "date")),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-IP-Address: "), F.col("ip")),
        F.concat(F.lit("Content-Type: "), F.when(http, "application/http;msgtype=response").otherwise(F.col("mime"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2("block", 256)),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: " + REVISIT))),
        F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Id: "), F.col("first").cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.concat(F.lit("X-Source-Id: "), own),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.col("block")).cast("string")
    # a record ends in two line breaks, which the text writer puts behind each row
    (
        r.select(record.alias("value")).write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(out)
    )
    return light.where("error IS NOT NULL").select("archive", "place", "error")


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by the declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a WARC record is cut off")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below a folder; ``intact`` compares both digests."""
    schema = _arrow(READ_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    kind = h["warc-type"]
                    told = h.get("warc-payload-digest", "").partition(":")[2]
                    intact = hashlib.sha256(block).hexdigest() == h.get("warc-block-digest", "").partition(":")[2]
                    size, digest = int(h.get("x-payload-length") or 0), told
                    if kind != "revisit":
                        payload = block
                        if block.startswith(b"HTTP/") and (at := block.find(b"\r\n\r\n")) >= 0:
                            payload = block[at + 4:]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        intact = intact and digest == told
                    number = lambda name: int(h[name]) if h.get(name) else None
                    rows.append((
                        number("x-source-id"), h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-date"),
                        kind, size, digest, number("x-refers-to-id"), intact,
                    ))
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, READ_SCHEMA)


def convert_pages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html",
                  min_bytes: int = 100) -> DataFrame:
    """Pages through legacy archives to WARC files and back: one row per page.

    Null bodies are empty; null or blank URLs are written ``-``.  Repeated rows
    are records of their own, and all with the smallest key of a payload are
    responses; rows without a key are revisits if one with a key has their
    payload.  An empty table gives an empty one; other columns are not read.
    An archive that cannot be read to its end is an error.
    """
    spark = pages.sparkSession
    archives = cut(pack_arc(pages, key, url, body), "arc")
    out = run_dir(spark, "llm-warc")
    lost = write_warc(archives, out, min_bytes).first()
    if lost is not None:
        raise ValueError(f"archive {lost['archive']} cannot be read from record {lost['place']} on: {lost['error']}")
    back = read_warc(spark, out)
    return back.select(
        F.col("source_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
