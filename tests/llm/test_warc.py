import gzip
import hashlib
import base64
import random
import zlib

import pytest

from mosaiq.llm import warc


def brute(rows):
    payload = {}
    for p, _, h in rows:
        payload.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in payload[body] if x is not None]
        first = min(ids) if len(payload[body]) > 1 and ids else p
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((p, len(body), digest, "response" if p == first else "revisit", None if p == first else first))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}\r\nX: y", "".join(rng.choice("aé<\n ") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100 + i, None, "hot" * 100) for i in range(200)] + [(400, "u", None), (401, "u", ""), (None, "u", "alone"), (None, "u", "hot" * 100), (-5, "u", "hot" * 100)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).collect() == []
    clash = spark.createDataFrame([(1, "u", "x", "y")], "page_id long, url string, html string, digest string")
    assert warc.round_trip(clash).first()["record_type"] == "response"


def nested(rng, n):
    """Archive members whose payloads hold gzip magic, other members, and whole records, one or several, as they are."""
    inner = lambda: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x-page:999>")], b"inside", 0)
    out = []
    for i in range(n):
        body = rng.randbytes(rng.randint(0, 900)) + warc.MAGIC * rng.randint(0, 3) + (gzip.compress(b"not a record") if i % 3 else b"") + inner() * rng.choice([0, 0, 1, 2, 5])
        out.append(warc.page_record(i, f"u{i}", body + rng.randbytes(rng.choice([0, 0, 300])), None, None, level=0))
    return out


@pytest.mark.parametrize("tail", [b"", gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:10]])
def test_splits_own_records_once(spark, tmp_path, tail):
    members = nested(random.Random(2), 60)
    members[20] = warc.page_record(20, "u20", random.Random(3).randbytes(9000) + members[21] * 3, None, None, level=0)  # over many ranges
    starts = [sum(map(len, members[:i])) for i in range(len(members))]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members) + tail)
    size = path.stat().st_size
    assert [(at, warc.page_id_of(h["warc-record-id"])) for at, h, _, _ in warc.walk(str(path), 0, size)] == list(zip(starts, range(60), strict=True))
    archives = spark.createDataFrame([(str(path), size)], "path string, size long")
    for span in (100, 300, 1500, 20_000, size, size + 1):
        got = warc.read(spark, archives, span).collect()
        assert sorted((r["start"], warc.page_id_of(r["headers"]["warc-record-id"])) for r in got) == list(zip(starts, range(60), strict=True)), span


def test_damaged_archives(spark, tmp_path):
    members = nested(random.Random(5), 30)
    members[7] = members[7][: len(members[7]) // 2]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    whole = [(at, h["warc-record-id"]) for at, h, _, _ in warc.walk(str(path), 0, size)]
    assert {warc.page_id_of(n) for _, n in whole} >= set(range(30)) - {7}
    archives = spark.createDataFrame([(str(path), size)], "path string, size long")
    for span in (200, 1000):
        got = warc.read(spark, archives, span).collect()
        assert sorted((r["start"], r["headers"]["warc-record-id"]) for r in got) == whole


def test_long_headers_and_many_ranges(spark):
    rng = random.Random(6)
    rows = [(i, "data:" + rng.randbytes(rng.choice([10, 100_000])).hex(), rng.randbytes(rng.choice([5, 70_000])).hex()) for i in range(12)] + [(20, "u", rows_ := "z" * 10), (21, "v", rows_), (21, "v", rows_)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), span=1 << 14)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_records_are_plain_warc():
    member = warc.page_record(3, "http://x", "é".encode(), 1, "http://y")
    text = zlib.decompress(member, 31).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") and "WARC-Refers-To: <urn:x-page:1>" in text and text.endswith("\r\n\r\n\r\n\r\n")
