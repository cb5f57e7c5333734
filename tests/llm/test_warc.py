import base64
import gzip
import hashlib
import io
import random

import pytest

from axonframe.llm import warc
from axonframe.llm.shared import new_path
from axonframe.llm.warc import payload_digest, read_warc, record, records_of_split, store_of, unread, warc_digest, write_warc

SCHEMA = "page_id long, url string, html string, payload string, _key long"


def brute(rows):
    """Of the rows of a payload the one that comes last by id and url is a response, the rest revisit it."""
    out, of = [], {}
    for i, url, html in rows:
        of.setdefault(html or "", []).append((i is not None, i, url is not None, url))
    for html, same in of.items():
        last = max(same, key=lambda r: (r[0], r[1] or 0, r[2], r[3] or ""))
        body, rest = html.encode(), list(same)
        rest.remove(last)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out += [(last[1], len(body), digest, "response", None)] + [(r[1], len(body), digest, "revisit", last[1]) for r in rest]
    return out


ROWS = [
    (1, "http://a/é", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b", None), (4, "http://b", ""), (5, "http://c", "y" * 300_000),
    (6, "u\r\nX: 1", "WARC/1.1\r\n\r\n\r\n"), (7, "v", "<p>x</p>"), (7, "v", "<p>x</p>"), (None, "w", "<p>x</p>"), (8, "w", "WARC-Type: revisit"),
    (None, "n", "both null"), (None, None, "both null"), (None, "n", "both null"), (12, "a", "twins"), (12, "b", "twins"), (12, "b", "twins"), (11, "z", "twins"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "p", 1) for r in ROWS], SCHEMA).repartition(3)
    for split in (1 << 22, 200):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_digest(df, split).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(ROWS)))
    assert warc_digest(df.limit(0)).count() == 0


def test_payloads_and_urls_come_back(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "é" * i) for i in range(200)], "page_id long, url string, html string")
    back = read_warc(write_warc(df, new_path(spark, "warc")), 1000).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in back) == [(i, f"http://h/{i}", "é" * i) for i in range(200)]


def test_every_split_owns_each_record_once(monkeypatch):
    nested = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 0)
    members = []
    for i in range(30):
        payload = bytes([i]) * (i * 37) + nested * (i % 2)
        raw = gzip.decompress(record(i, "u", payload, payload_digest(payload), None))
        members.append(gzip.compress(raw, 0))  # stored blocks: the payload's own gzip members stand in the file as they are
    data, raws = b"".join(members), [gzip.decompress(m) for m in members]
    for split in (1, 50, 333, 4096, len(data)):
        got = [r for s in range(0, len(data), split) for r in records_of_split(io.BytesIO(data), s, s + split, len(data))]
        assert got == raws
    monkeypatch.setattr(warc, "HELD_BYTES", 500)  # most records are decoded twice
    assert records_of_split(io.BytesIO(data), 0, len(data), len(data)) == raws


def member(i, payload):
    return record(i, "u", payload, payload_digest(payload), None)


def archive(tmp_path, spark, data, name="a.warc.gz"):
    (tmp_path / name).write_bytes(data)
    return spark.createDataFrame([(f"file://{tmp_path}/{name}", len(data))], "path string, bytes long")


def test_broken_archives_give_what_they_hold_and_an_error(spark, tmp_path):
    rng = random.Random(3)
    members = [member(i, rng.randbytes(200 + 40 * i)) for i in range(10)]
    whole, ends = b"".join(members), [0]
    for m in members:
        ends.append(ends[-1] + len(m))
    flipped = bytearray(whole)
    flipped[ends[8] + 150] ^= 255
    headless = bytearray(whole)
    headless[0] ^= 255
    cases = {
        "whole": (whole, set(range(10)), []),
        "padded": (whole + bytes(5000), set(range(10)), []),
        "cut off": (whole[:-30], set(range(9)), [ends[9]]),
        "damaged": (bytes(flipped), set(range(10)) - {8}, [ends[8]]),
        "first": (bytes(headless), set(range(1, 10)), [0]),
        "no archive": (b"something else", set(), [0]),
    }
    for n, (what, (data, want, broken)) in enumerate(cases.items()):
        df = archive(tmp_path, spark, data, f"{n}.warc.gz")
        for split in (100, 700, 1 << 22):
            rows = read_warc(df, split, damaged="report").collect()
            assert {r.page_id for r in rows if not r.error} == want, (what, split)
            assert sorted(r.offset for r in rows if r.error) == broken, (what, split)
            assert sum(r.length for r in rows) + (5000 if what == "padded" else 0) == len(data) or broken
        if broken:
            with pytest.raises(Exception, match=f"byte {broken[0]}"):
                read_warc(df).collect()
        assert unread(df, read_warc(df, damaged="report")).count() == (what != "whole")


def test_a_wrong_digest_is_an_error(spark, tmp_path):
    df = archive(tmp_path, spark, member(1, b"good") + record(2, "u", b"bad", payload_digest(b"other"), None))
    rows = read_warc(df, damaged="report").collect()
    assert [(r.page_id, bool(r.error)) for r in sorted(rows, key=lambda r: r.offset)] == [(1, False), (None, True)]
    with pytest.raises(Exception, match="has the digest"):
        read_warc(df).collect()


def test_foreign_records_and_schemes(spark, tmp_path):
    raw = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (row,) = read_warc(archive(tmp_path, spark, gzip.compress(raw))).collect()
    assert (row.page_id, row.record_type, row.error) == (None, "warcinfo", None)
    assert store_of(f"file://{tmp_path}")[1] == str(tmp_path)
