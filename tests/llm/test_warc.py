"""WARC archives: the round trip against plain Python, segments, framing and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import tempfile

import pytest
from made import prose

from flowrhythm.llm import warc as W

SCHEMA = "page_id long, url string, html string, content string, h string, n int, refers string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, x, "c", "h", 1, "r") for i, u, x in rows], SCHEMA).repartition(3)


def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/warc"


def plain(rows):
    out = []
    best = {}
    for i, _, x in rows:
        best[x or ""] = max(best.get(x or "", -1), -1 if i is None else i)
    for i, _, x in rows:
        b = (x or "").encode()
        head = best[x or ""]
        last = (-1 if i is None else i) == head
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last else "revisit", None if last or head < 0 else head))
    return sorted(out, key=str)


ROWS = [(k, f"http://a.example/{k}?q=ä b\r\nX: y", f"<p>{prose(k, 5 + k * 3)}</p>") for k in range(60)]
ROWS += [(100 + k, None, "<same>") for k in range(70)] + [(200, "u", None), (201, "u", ""), (None, "u", "no id"), (None, None, "<same>"), (300, "u", "ü" * 20_000), (301, "u", ROWS[5][2])]


def test_round_trip(spark):
    got = W.round_trip(pages_of(spark, ROWS), folder(), 500, 3000).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


def test_round_trip_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(W, "HOT_SHARE", 5)
    got = W.round_trip(pages_of(spark, ROWS), folder(), 500, 3000).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


@pytest.mark.parametrize("rows", (100_000, 0))
def test_rows_equal_in_id_and_payload(spark, monkeypatch, rows):
    monkeypatch.setattr(W, "BROADCAST_ROWS", rows)
    made = [(1, "a", "x")] * 5 + [(None, None, "y")] * 3 + [(2, "b", "x")] * 4 + [(3, "c", "z" * 3000)] * 2
    got = [tuple(r) for r in W.round_trip(pages_of(spark, made), folder(), 500).collect()]
    assert len(got) == len(made)
    for payload, head in (("x", 2), ("y", None), ("z" * 3000, 3)):
        digest = W.sha1(payload.encode())
        own = [r for r in got if r[2] == digest]
        assert sorted(r[3] for r in own) == ["response"] + ["revisit"] * (len(own) - 1)
        assert {r[0] for r in own if r[3] == "response"} == {head} == {r[4] for r in own if r[3] == "revisit"}
        assert {r[1] for r in own} == {len(payload)}


def test_archives_hold_what_the_format_asks_for(spark):
    archives = W.write_archives(pages_of(spark, ROWS), folder(), 500, 3000).collect()
    assert len(archives) > 3
    kinds, origins, firsts = {}, {}, {}
    for r in archives:
        with open(r.archive, "rb") as f:
            found = list(W.parse(io.BufferedReader(gzip.GzipFile(fileobj=f))))
        assert found[0][0]["warc-type"] == "warcinfo" and len(found) == r.records + 1
        for said, block in found:
            kinds[said["warc-type"]] = kinds.get(said["warc-type"], 0) + 1
            assert len(block) <= 500 and said["warc-record-id"].startswith("<urn:uuid:")
            if said["warc-type"] == "continuation":
                origins.setdefault(said["warc-segment-origin-id"], {})[int(said["warc-segment-number"])] = block
            else:
                firsts[said["warc-record-id"]] = block
    assert kinds["response"] + kinds["revisit"] == len(ROWS) and kinds["continuation"] > 60
    for own, parts in origins.items():
        assert sorted(parts) == list(range(2, len(parts) + 2))
        W.payload_of(firsts[own] + b"".join(parts[k] for k in sorted(parts)))


def test_payloads_and_texts_come_back(spark):
    rows = W.read_archives(W.write_archives(pages_of(spark, ROWS), folder(), 700, 5000)).collect()
    assert all(r.intact for r in rows)
    back = {r.page_id: (r.url, bytes(r.payload).decode()) for r in rows if r.record_type == "response" and r.page_id is not None}
    for i, u, x in ROWS:
        if i in back:
            assert back[i] == (u, x or "")


def damaged(spark, change):
    """Records read from archives whose records a function changes; it gets (fields, block) and returns a list of them."""
    at = W.write_archives(pages_of(spark, [(1, "u", "a" * 1500), (2, "u", "b" * 1500), (3, "u", "short")]).coalesce(1), folder(), 500).collect()[0].archive
    with open(at, "rb") as f:
        found = list(W.parse(io.BufferedReader(gzip.GzipFile(fileobj=f))))
    with open(at, "wb") as f:
        for said, block in found:
            for s, b in change(said, block):
                f.write(W._record([(k, v) for k, v in s.items() if k != "content-length"], b))
    rows = W.read_archives(spark.createDataFrame([(at,)], "archive string")).collect()
    return {r.page_id: r for r in rows}


def test_damage_is_told(spark):
    second = lambda s: s.get("warc-segment-number") == "2" and "warc-segment-total-length" not in s
    lost = damaged(spark, lambda s, b: [] if second(s) else [(s, b)])
    assert not lost[1].intact and not lost[2].intact and lost[3].intact and lost[1].payload is None
    twice = damaged(spark, lambda s, b: [(s, b), (s, b)])
    assert all(r.intact for r in twice.values()) and bytes(twice[1].payload) == b"a" * 1500
    other = damaged(spark, lambda s, b: [(s, b.replace(b"aaaa", b"cccc"))])
    assert not other[1].intact and other[2].intact


def test_framing():
    for n in (0, 1, 1023, 1024, 1025, 5000):
        x = bytes(k % 251 for k in range(n))
        assert W.unframed(W.framed(x)) == x
    assert W.unframed(b"4;a=b\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: x\r\n\r\n") == b"Wikipedia"
    with pytest.raises(ValueError):
        W.unframed(b"5\r\nab\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        W.unframed(b"5\r\nabcde\r\n")


def test_no_pages(spark):
    assert W.round_trip(pages_of(spark, [(1, "u", "x")]).limit(0), folder()).count() == 0
