import hashlib

import pytest
from healthwatch.llm import warc

SCHEMA = "page_id bigint, url string, html string, sha int, target int, record string"
BIG = "é<p>\r\n\r\n" * 30_000
PAGES = [(1, "u", None), (None, "u", "x" * 2000), (3, None, "x" * 2000), (2, "é \n", "x" * 2000), (2, "é \n", "x" * 2000),
         (7, "b", BIG), (8, "c", BIG), (9, "c", ""), (10, "c", "WARC/1.1\r\n\r\n"), (None, "c", BIG + "a"), (None, "d", BIG + "a"),
         (11, "e", "s" * 999), (12, "e", "s" * 999)]


def brute(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        data, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        target = max(ids) if ids else None
        revisit = len(data) >= 1000 and target is not None and i != target and len(groups[h or ""]) > 1
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None, True))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, 1, 2, "r") for p in PAGES], SCHEMA)
    assert sorted(map(tuple, warc.archive_round_trip(df).collect()), key=str) == brute(PAGES)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str) == brute(rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_repeated_rows_with_segments_stay_apart(spark):
    """Equal rows above the segment size, with equal and with null page_id."""
    rows = [(5, "u", BIG)] * 3 + [(None, "u", BIG + "n")] * 3 + [(6, "u", BIG)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(map(tuple, warc.archive_round_trip(df.repartition(3)).collect()), key=str) == brute(rows)
    same = [(5, "u", BIG)] * 4 + [(None, "u", BIG + "n")] * 3
    got = warc.archive_round_trip(spark.createDataFrame(same, "page_id bigint, url string, html string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(same)


def test_segments_are_reassembled_in_any_order(spark):
    made = warc.page_records(5, "http://x", b"0123456789" * 50, None, segment_bytes=100)
    assert len(made) > 5
    rows = [warc._row(*next(warc.parse(r + warc.END))) for r in made]
    schema = warc._PARSED
    df = spark.createDataFrame([tuple(r.values()) for r in reversed(rows)], schema)
    got = warc.payloads(warc.reassemble(df)).collect()
    assert len(got) == 1 and got[0]["payload"] == b"0123456789" * 50 and got[0]["verified"]
    lost = spark.createDataFrame([tuple(r.values()) for r in rows if r["segment"] != 3], schema)
    assert [r["verified"] for r in warc.payloads(warc.reassemble(lost)).collect()] == [False]


def test_size_and_digest_come_from_the_bytes_read_back(spark):
    (record,) = warc.page_records(5, "http://x", b"0123456789", None)
    bad = record.replace(b"0123456789", b"012345678X")
    cut = record.replace(b"a\r\n0123456789", b"b\r\n0123456789")
    segments = warc.page_records(6, "http://x", b"0123456789" * 50, None, segment_bytes=100)
    revisit = warc.page_records(7, "http://x", b"0123456789" * 50, 6)
    rows = [warc._row(*next(warc.parse(r + warc.END))) for r in [record, bad, cut, *segments[:2], *segments[3:], *revisit]]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], warc._PARSED)
    got = [(r["payload_bytes"], r["payload_digest"], r["verified"]) for r in warc.payloads(warc.reassemble(df)).collect()]
    sha = lambda data: hashlib.sha1(data).hexdigest()
    want = [(10, sha(b"0123456789"), True), (10, sha(b"012345678X"), False), (None, None, False), (None, None, False),
            (500, sha(b"0123456789" * 50), True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunked_framing():
    for data in (b"", b"a", b"\r\n0\r\n\r\n" * 9, bytes(range(256)) * 100):
        assert warc.dechunk(warc.chunked(data, 7)) == data
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"no record here\r\n\r\n"))
