import hashlib
import random
import uuid
from collections import defaultdict

import pytest

from valuetide.llm.warc import DELIMITER, archive_pages, read_archives, record_head, write_archives

EDGE = "\r\n\r\n"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5" + EDGE + "abcde"
SCHEMA = "page_id long, url string, html string, page long, payload string, `first` int, digest string, value string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "d", "v") for r in rows], SCHEMA)


def plain(rows):
    ids = defaultdict(list)
    for i, _, html in rows:
        ids[html or ""].append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        most = max((x for x in ids[html or ""] if x is not None), default=None)
        revisit = len(payload) >= 1000 and most is not None and i != most
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", most if revisit else None))
    return sorted(out, key=str)


def odd_pages(n=70):
    r = random.Random(3)
    parts = [
        EDGE + RECORD + EDGE, "WARC/1.1\r\n", RECORD, EDGE + "WARC/1.", "x" * 3000 + EDGE + RECORD + EDGE + RECORD + EDGE + "y" * 3000, "\r\n", "\r\n\r", EDGE,
        EDGE + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100000" + EDGE + "z" * 50, "é漢" * 700, None, "", "\r" * 5 + "\n" + EDGE + "\r\n\r\n\r\nWARC/1.1\r\n", "q" * 9000 + EDGE + RECORD,
    ]
    rows = []
    for k in range(n):
        html = r.choice(parts)
        if html is not None and r.random() < 0.5:
            html += r.choice(parts[:6]) + f"w{r.randrange(50)}" * r.choice([1, 500])
        rows.append((k % (n - 5) if k != 7 else None, r.choice(["http://a/WARC/1.1", "http://x\r\n\r\nWARC/1.1\r\n", None]), html))
    return rows


@pytest.mark.parametrize("split", ["128m", "3001"])
def test_magic_in_payloads_and_urls(spark, split):
    rows = odd_pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert sorted((tuple(r) for r in archive_pages(frame(spark, rows).repartition(3)).collect()), key=str) == plain(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_come_back(spark, tmp_path):
    rows = [(k, "http://h/%d" % k, html) for k, html in enumerate(["short", None, "x" * 2000, "x" * 2000, EDGE + RECORD + EDGE, "WARC/1.1\r\n", "l" * 3_000_000 + DELIMITER + "m"])]
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_archives(frame(spark, rows).repartition(2), path)
    for limit in (1000, 0):
        got = {r.record_id: r for r in read_archives(spark, path, payload=True, broadcast_rows=limit).collect()}
        assert len(got) == 7
        for i, url, html in rows:
            r = got[f"<urn:page:{i}>"]
            head, _, body = bytes(r.body).partition(b"\r\n\r\n")
            assert head.startswith(b"HTTP/1.1 200 OK") and r.uri == url
            assert body.decode() == ("" if i == 2 else html or "") and (r.intact is None if i == 2 else r.intact)
    assert got["<urn:page:2>"].refers_to == "<urn:page:3>" and got["<urn:page:2>"].payload_bytes == 2000


def test_many_groups_are_joined(spark, tmp_path):
    rows = [(k, None, f"{k % 20:04d}" * 300) for k in range(60)] + [(100 + k, None, "h" * 1500) for k in range(60)]
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_archives(frame(spark, rows), path, broadcast_rows=0)
    got = sorted((int(r.record_id[10:-1]), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to[10:-1]) if r.refers_to else None) for r in read_archives(spark, path).collect())
    assert got == sorted(plain(rows))


def test_broken_archives(spark, tmp_path):
    good = RECORD + EDGE
    (tmp_path / "cut.warc").write_bytes((good * 2 + RECORD.replace(": 5", ": 5000")).encode())
    (tmp_path / "noise.warc").write_bytes(b"no archive" + good.encode())
    (tmp_path / "one.warc").write_bytes(good.encode())
    (tmp_path / "nothing.warc").write_bytes(b"")
    got = sorted((r.file.rpartition("/")[2], r.offset, r.payload_bytes) for r in read_archives(spark, f"file://{tmp_path}").collect())
    assert got == [("cut.warc", 0, 5), ("cut.warc", len(good), 5), ("cut.warc", 2 * len(good), 5), ("one.warc", 0, 5)]


def test_empty_and_repeated(spark):
    assert archive_pages(frame(spark, [])).count() == 0
    rows = [(1, "u", "a" * 1200)] * 3 + [(None, "u", "b" * 1200)] * 2 + [(2, None, "a" * 999), (3, None, "a" * 999)]
    assert sorted((tuple(r) for r in archive_pages(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_heads():
    assert record_head(b"1\r\nWARC-Type: x\r\nContent-Length: 3")[0] == 38
    for bad in (b"", b"2\r\nWARC-Type: x\r\nContent-Length: 3", b"1\r\nWARC-Type: x\r\nContent-Length: -3", b"1\r\nContent-Length: 3", b"1\r\nnoise\r\nContent-Length: 3"):
        assert record_head(bad) is None
