import base64
import gzip
import hashlib
import io

import pytest

from foliant.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS last", "3 AS `at`").repartition(3)


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/ü x", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "http://b\r\nX: y", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 9_000_000), (2, "u", "<p>ä</p>"), (None, "u", "<p>ä</p>"), (None, "u", "alone")]
    found = warc.archived(pages(spark, rows)).collect()
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, x in rows if (x or "").encode() == data and q is not None]
        last = max(same) if same else None
        revisit = last is not None and (p is None or p < last)
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)


def test_small_payloads_stay_responses(spark):
    found = warc.archived(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), min_bytes=4).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_normaliser_makes_members_and_index():
    raws = [warc.record("response", f"urn:page:{i}", f"http://x/{i}", b"b" * i * 100, "D") for i in range(5)]
    source, target = io.BytesIO(gzip.compress(b"".join(raws))), io.BytesIO()
    index = warc.normalise(source, target)
    data = target.getvalue()
    assert b"".join(gzip.decompress(data[e.offset : e.offset + e.length]) for e in index) == b"".join(raws)
    assert [e.record_id for e in index] == [f"urn:page:{i}" for i in range(5)]
    again = io.BytesIO()
    assert warc.normalise(io.BytesIO(data), again) == index and again.getvalue() == data
    assert warc.read_at(data, index[3]).block.endswith(b"b" * 300)


def test_damaged_archives_are_told():
    whole = gzip.compress(warc.record("response", "urn:page:1", "u", b"x" * 1000, "D"))
    for bad in (whole[:-20], gzip.compress(b"no warc\r\n\r\n"), gzip.compress(gzip.decompress(whole)[:-500])):
        with pytest.raises(warc.DamagedArchive):
            warc.normalise(io.BytesIO(bad), io.BytesIO())
    assert warc.normalise(io.BytesIO(gzip.compress(b"")), io.BytesIO()) == []


def test_empty_table(spark):
    assert warc.archived(pages(spark, [])).count() == 0
