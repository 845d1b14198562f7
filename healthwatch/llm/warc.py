"""WARC archives: write records, read them back, reassemble segments.

Writing: every page becomes one HTTP response with chunked transfer framing.
Of pages with equal payloads of at least 1000 bytes the one with the largest
page_id is written in full and the others as ``revisit`` records.  A block
longer than the segment size is split into a first record and ``continuation``
records, which go to archive files of their own.  Records are rows of Spark's
text writer with the record end as line separator, so files are plain WARC
files made by the executors in any file system Spark can write.

Reading: archive files of a bounded number of records are parsed one at a
time; complete records need no shuffle.  Segments are grouped by origin
identifier (a group is one record), ordered by segment number, checked
against the total length and joined; then the chunked framing is decoded and
the payload digest verified."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import RID, map_arrow, ship_package, with_row_id, write_table
from healthwatch.session import checkpoint_dir

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 4096
LEAST_REVISIT = 1000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Extension field: bytes of the full payload, kept on revisits too.
LENGTH_FIELD = "X-Payload-Length"

_PARSED = ("record_id string, record_type string, uri string, origin string, segment int, total_length bigint, "
           "payload_digest string, payload_length bigint, refers_to string, block binary")


# -------------------------------------------------------------------- writing

def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer coding of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def page_records(page_id, url: str, payload: bytes, refers_to, segment_bytes: int = SEGMENT_BYTES, row: str = "") -> list[bytes]:
    """The records of one page: one, or a first segment and continuations.
    ``row`` names the input row, so segments of repeated rows stay apart."""
    ident = f"<urn:page:{'' if page_id is None else page_id}>"
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), (LENGTH_FIELD, str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident), *common,
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], http)]
    block = http + chunked(payload)
    kind = [("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, *kind], block)]
    origin = f"<urn:page:{'' if page_id is None else page_id}:{hashlib.sha1(payload + uri.encode()).hexdigest()}{row and ':' + row}>"
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("WARC-Segment-Number", "1"), *kind], block[:segment_bytes])]
    starts = range(segment_bytes, len(block), segment_bytes)
    for n, i in enumerate(starts, 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}:{n}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE),
                  ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n))]
        if n == len(starts) + 1:
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(fields, block[i:i + segment_bytes]))
    return out


def _write_batches(segment_bytes: int):
    def run(batches):
        for b in batches:
            rows, firsts = [], []
            for page_id, url, html, refers, file, pos in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", *RID))):
                made = page_records(page_id, url, (html or "").encode(), refers, segment_bytes, f"{file}:{pos}")
                rows += made
                firsts += [True] + [False] * (len(made) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(firsts, pa.bool_())], names=["record", "first"])
    return run


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with their row id and ``refers_to``: the largest page_id among equal payloads of
    at least ``least`` bytes when that is another page, else null.  Digests
    are grouped with map-side partial counts; only groups of two or more join
    back, by sort-merge, which splits a hot payload."""
    pages = with_row_id(pages, ["page_id", "url", "html"]).select(*RID, F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                                                                 F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    groups = (pages.filter(F.octet_length(payload) >= least).groupBy(F.sha1(payload).alias("sha"))
              .agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").select("sha", "target"))
    groups = write_table(groups, "warc-payloads")
    key = F.when(F.octet_length(payload) >= least, F.sha1(payload))
    joined = pages.withColumn("sha", key).join(groups.hint("merge"), "sha", "left")
    return joined.select(*RID, "page_id", "url", "html", F.when(F.col("target") != F.coalesce("page_id", F.col("target") - 1), F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write planned pages as WARC files under ``path``: ``first`` holds
    complete records and first segments, ``continuation`` the others."""
    records = map_arrow(pages, _write_batches(segment_bytes), "record binary, first boolean")
    records = records.select(F.col("record").cast("string").alias("value"),
                             F.when(F.col("first"), "first").otherwise("continuation").alias("part"))
    (records.write.partitionBy("part").option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path))


# -------------------------------------------------------------------- reading

def parse(data: bytes):
    """(fields, block) of each record; stops at the first broken header."""
    view, pos = memoryview(data), 0
    while pos < len(data):
        stop = data.find(END, pos)
        head = data[pos:stop].decode("utf-8", "replace").split("\r\n") if stop >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {pos}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        start = stop + len(END)
        end = start + int(fields["content-length"])
        if end > len(data):
            raise ValueError(f"record at byte {pos} is cut off")
        yield fields, bytes(view[start:end])
        pos = end + len(END)


def _row(f: dict, block: bytes) -> dict:
    number = lambda k: int(f[k]) if k in f else None
    return {"record_id": f.get("warc-record-id"), "record_type": f.get("warc-type"), "uri": f.get("warc-target-uri"),
            "origin": f.get("warc-segment-origin-id", f.get("warc-record-id") if "warc-segment-number" in f else None),
            "segment": number("warc-segment-number"), "total_length": number("warc-segment-total-length"),
            "payload_digest": f.get("warc-payload-digest"), "payload_length": number(LENGTH_FIELD.lower()),
            "refers_to": f.get("warc-refers-to"), "block": block}


def _parse_batches(batches):
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                        for c in _PARSED.split(", ")])
    for b in batches:
        for content in b.column("content"):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            rows, held = [], 0
            for fields, block in parse(data):
                rows.append(_row(fields, block))
                held += len(block)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives under ``path``, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return map_arrow(files, _parse_batches, _PARSED)


def dechunk(body: bytes) -> bytes:
    """Payload of a chunked body (chunk extensions and trailers allowed)."""
    out, pos = [], 0
    while True:
        line = body.index(b"\r\n", pos)
        size = int(body[pos:line].split(b";")[0].strip(), 16)
        pos = line + 2
        if size == 0:
            return b"".join(out)
        if pos + size > len(body) or body[pos + size:pos + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[pos:pos + size])
        pos += size + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    coded = any(x.lower().replace(b" ", b"").startswith(b"transfer-encoding:chunked") for x in head.split(b"\r\n"))
    return dechunk(body) if coded else body


def join_segments(table: pa.Table) -> pa.Table:
    """One record from the segments of one origin: ordered by number, with no
    gap or repeat, and as long as the last segment says."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    block = b"".join(r["block"] for r in rows)
    whole = [r["segment"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["total_length"] == len(block)
    first = dict(rows[0], block=block if whole else None, total_length=len(block))
    return pa.Table.from_pylist([first], table.schema)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: complete ones as they are, segments joined by origin
    (``block`` is null when a segment is missing or the length differs)."""
    ship_package(records.sparkSession)
    joined = records.filter("segment is not null").groupBy("origin").applyInArrow(join_segments, _PARSED)
    return records.filter("segment is null").unionByName(joined)


_DECODED = ("record_id string, record_type string, uri string, refers_to string, "
            "payload_bytes bigint, payload_digest string, verified boolean, payload binary")


def _decoded(record_id, kind, uri, refers_to, digest, length, block, keep: bool) -> tuple:
    """One row of :data:`_DECODED`; the payload itself only with ``keep``.

    Size and SHA-1 of a response are those of the bytes read back, null when
    they could not be put together; only other records, which carry no payload
    (revisits), take them from the header."""
    if kind != "response":
        raw = base64.b32decode(digest.split(":")[1]).hex() if digest else None
        return (record_id, kind, uri, refers_to, length, raw, block is not None, None)
    try:
        payload = None if block is None else http_payload(block)
    except ValueError:  # broken chunked framing
        payload = None
    if payload is None:
        return (record_id, kind, uri, refers_to, None, None, False, None)
    sha = hashlib.sha1(payload)
    ok = digest == "sha1:" + base64.b32encode(sha.digest()).decode() and length in (None, len(payload))
    return (record_id, kind, uri, refers_to, len(payload), sha.hexdigest(), ok, payload if keep else None)


_DECODE_FROM = ("record_id", "record_type", "uri", "refers_to", "payload_digest", "payload_length", "block")
_DECODED_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
_DECODED_NAMES = [c.split()[0] for c in _DECODED.split(", ")]


def _decoded_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(_DECODED_TYPES)]


def _payload_batches(batches):
    for b in batches:
        rows = [_decoded(*r, True) for r in zip(*(b.column(c).to_pylist() for c in _DECODE_FROM))]
        yield pa.RecordBatch.from_arrays(_decoded_columns(rows), names=_DECODED_NAMES)


def payloads(records: DataFrame) -> DataFrame:
    """Decoded payload, its size, its SHA-1 and whether the digest agrees."""
    return map_arrow(records, _payload_batches, _DECODED)


_SUMMARY = _PARSED + ", payload_bytes bigint, payload_hex string, verified boolean"


def _summary_batches(batches):
    """Complete records decoded and checked at once (their blocks go),
    segments as they are."""
    schema = None
    for b in _parse_batches(batches):
        rows = b.to_pylist()
        for r in rows:
            r |= {"payload_bytes": None, "payload_hex": None, "verified": None}
            if r["segment"] is None:
                d = _decoded(*(r[c] for c in _DECODE_FROM), False)
                r |= {"payload_bytes": d[4], "payload_hex": d[5], "verified": d[6], "block": None}
        schema = schema or pa.schema([*b.schema, ("payload_bytes", pa.int64()), ("payload_hex", pa.string()), ("verified", pa.bool_())])
        yield pa.RecordBatch.from_pylist(rows, schema)


def _join_and_decode(table: pa.Table) -> pa.Table:
    whole = join_segments(table).to_pylist()[0]
    return pa.Table.from_arrays(_decoded_columns([_decoded(*(whole[c] for c in _DECODE_FROM), False)]), names=_DECODED_NAMES)


def checked_records(spark, path: str) -> DataFrame:
    """Size, SHA-1 and check of every record's payload, without the payloads.

    The archives are parsed once: complete records are decoded where they are
    read, and only segments are kept with their bytes, shuffled by origin and
    decoded when joined."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parsed = write_table(map_arrow(files, _summary_batches, _SUMMARY), "warc-records")
    whole = parsed.filter("segment is null").select("record_id", "record_type", "uri", "refers_to", "payload_bytes",
                                                    F.col("payload_hex").alias("payload_digest"), "verified")
    segments = parsed.filter("segment is not null").drop("payload_bytes", "payload_hex", "verified")
    ship_package(spark)
    joined = segments.groupBy("origin").applyInArrow(_join_and_decode, _DECODED).drop("payload")
    return whole.unionByName(joined)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, verified.  Size and digest of a response are taken from the
    bytes read back and are null when its record could not be put together;
    a revisit has those of its header.  Defined cases: null html is an empty payload; null
    page_id keeps a null id and never is a revisit's target unless all ids of
    its group are null (then all are responses); repeated rows with the same
    page_id and payload are each a response; payloads under 1000 bytes are
    responses; other columns are ignored; an empty table gives an empty
    result."""
    import uuid
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/warc-{uuid.uuid4().hex[:12]}"
    write_archives(plan_records(pages), path)
    if spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, verified boolean")
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)", 1)
    out = checked_records(spark, path)
    number = lambda c: F.when(ident(c) != "", ident(c).cast("bigint"))
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      number("refers_to").alias("refers_to"), "verified")
