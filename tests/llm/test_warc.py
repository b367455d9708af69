import hashlib

import pytest

from tokenloom.llm import common, warc
from tokenloom.llm.common import shared_dir

PAGES = ["<html>" + "x" * 300, "<html>" + "x" * 300, "short", "short", "", None, "é" * 40_000, "<p>" + "long " * 30_000, "<html>" + "x" * 300]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(PAGES)], "page_id long, url string, html string, block string").repartition(2)


@pytest.mark.parametrize("segment, archive", [(warc.SEGMENT, warc.ARCHIVE), (100, 1000), (1 << 30, 1)])
def test_round_trip(spark, pages, segment, archive):
    a = warc.write_archives(pages, shared_dir(spark) + "/w", segment, archive)
    got = {r.page_id: r for r in warc.read_archives(a, payloads=True).collect()}
    assert len(got) == len(PAGES)
    for i, h in enumerate(PAGES):
        b = (h or "").encode()
        r = got[i]
        copy = i in (1, 8)
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 0) if copy else ("response", None))
        assert copy or bytes(r.payload) == b


def test_edges(spark):
    schema = "page_id long, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).collect() == []
    h = "y" * 200
    rows = warc.round_trip(spark.createDataFrame([(5, h), (5, h), (None, h), (9, h)], schema).coalesce(1)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in rows) == [(-1, "revisit", 5), (5, "response", None), (5, "revisit", 5), (9, "revisit", 5)]


def test_lost_segment_and_bad_framing(spark, pages):
    a = warc.write_archives(pages, shared_dir(spark) + "/w", 100, 1000)
    paths = sorted(r.path for r in a.collect())
    some = spark.createDataFrame([(p,) for p in paths[: len(paths) // 2]], "path string")
    with pytest.raises(Exception, match="missing segment"):
        warc.read_archives(some).collect()
    for bad in (b"5\r\nab", b"2\r\nabXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.dechunked(warc.chunked(b"z" * 20_000, 7)) == b"z" * 20_000


def test_hot_payload_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    html = ["<p>" + "z" * 150] * 300 + [f"<p>{i // 2}" + "y" * 150 for i in range(40)]
    d = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").repartition(3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(d).collect()}
    first = {h: i for i, h in reversed(list(enumerate(html)))}
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, h in enumerate(html)}


def test_a_page_of_50_mb(spark):
    html = "0123456789abcdef" * (50 << 16)
    d = spark.createDataFrame([(1, html), (2, "small")], "page_id long, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(d).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, h in ((1, html), (2, "small"))}
