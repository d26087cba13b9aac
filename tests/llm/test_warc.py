import base64
import gzip
import hashlib
import io
import random

import pytest

from doclattice.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string, d int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (3, "u3", "same", "x", 1), (1, "u1", "same", "x", 1), (2, None, "same", "x", 1), (1, "u1", "same", "x", 1),
    (5, "u5", None, "x", 1), (4, "a\r\nb", "", "x", 1), (None, "n", "same", "x", 1), (None, "n2", "only", "x", 1),
    (9, "u9", "é\r\n\r\nWARC/1.0\r\n" * 40_000, "x", 1), (8, "u8", "".join(chr(random.Random(i).randrange(32, 9000)) for i in range(9000)), "x", 1),
]


@pytest.mark.parametrize("split", [50, 4 << 20])
def test_round_trip(spark, tmp_path, split):
    queries.prepare(spark)
    folder = str(tmp_path / "w")
    manifest = warc.write_archive(warc.digests(spark.createDataFrame(ROWS, SCHEMA)), folder)
    got = warc.read_archive(spark, manifest, folder, split=max(split, 2000) if split < 100 else split).collect()
    assert len(got) == len(ROWS) == manifest.groupBy().sum("records").first()[0]
    first = {}
    for i, _, h, _, _ in ROWS:
        k = h or ""
        first[k] = min(x for x in (first.get(k), i) if x is not None) if (first.get(k), i) != (None, None) else None
    seen = {}
    for r in got:
        text = next(h or "" for i, _, h, _, _ in ROWS if digest(h) == r.payload_digest)
        assert r.payload_bytes == len(text.encode())
        if r.record_type == "response":
            assert r.payload == text.encode() and r.refers_to is None and r.page_id == first[text]
            seen[text] = seen.get(text, 0) + 1
        else:
            assert r.payload is None and r.refers_to == first[text]
    assert set(seen.values()) == {1} and seen.keys() == {h or "" for _, _, h, _, _ in ROWS}


def test_alike_rows_after_a_shuffle_are_one_response(spark, monkeypatch):
    """Rows alike in all, dealt anew each time that they are read, and more of them than a task makes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc, "ALIKE", 7)
    rows = [(1, "u1", "same")] * 40 + [(2, "u2", "same")] * 3 + [(3, None, "other")] * 2 + [(None, "n", "alone")] * 2 + [(4, "u4", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5, F.rand())
    got = warc.digests(queries.prepare(spark) and pages).collect()
    assert len(got) == len(rows) and sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(1, "response", 0)] + [(1, "revisit", 1)] * 39 + [(2, "revisit", 1)] * 3 + [(3, "response", 0), (3, "revisit", 3), (0, "response", 0), (0, "revisit", 0), (4, "response", 0)]
    )
    assert all(bytes(r.payload).decode() in ("same", "other", "alone", "short") for r in got if r.record_type == "response")
    assert {r.payload_bytes for r in got if r.page_id == 1} == {4} and {r.payload_digest for r in got if r.page_id == 1} == {digest("same")}


def test_short_payloads_are_all_responses(spark):
    got = warc.digests(spark.createDataFrame(ROWS, SCHEMA), least=5).collect()
    assert all(r.record_type == "response" for r in got) and len(got) == len(ROWS)


def test_ranges_own_what_starts_inside():
    """Every way to cut a file gives every record once; other members and stray magic are passed over."""
    parts, starts, at = [], [], 0
    for k in range(12):
        data = warc.gzip_member(warc.record(k, f"u{k}", b"p" * k * 70, "D", "response", None))
        starts.append(at)
        parts += [data, gzip.compress(b"not a record"), b"\x1f\x8b\x08 stray \x1f\x8b"]
        at += sum(map(len, parts[-3:]))
    data = b"".join(parts)
    for step in (1, 7, 100, 333, len(data)):
        found = []
        for a in range(0, len(data), step):
            mine = [warc.parse(m)["page_id"] for m in warc.members(warc.Buffered(io.BytesIO(data), 64), a, min(a + step, len(data)), 50)]
            assert mine == [k for k, s in enumerate(starts) if a <= s < a + step]
            found += mine
        assert found == list(range(12))
    assert list(warc.members(warc.Buffered(io.BytesIO(data[: starts[-1] + 40])), starts[-1], len(data))) == []


def test_empty(spark, tmp_path):
    queries.prepare(spark)
    manifest = warc.write_archive(warc.digests(spark.createDataFrame([], SCHEMA)), str(tmp_path))
    assert manifest.count() == 0 and warc.read_archive(spark, manifest, str(tmp_path)).count() == 0
