import base64
import hashlib

import pytest

from twinframe.llm.warc import archive_index, read_records, write_archive


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, sha256 string").repartition(3)
    return make


ROWS = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/3\r\nX: y", "<p>é</p>"), (4, "u", None), (5, "u", ""),
        (6, "u", "y" * 100_000), (7, "u", "<p>other</p>"), (-8, "u", "neg"), (-9, "u", "neg")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 4, 10 ** 6])
def test_index(spark, pages, least):
    want = []
    for i, _, h in ROWS:
        size = len((h or "").encode())
        same = [j for j, _, x in ROWS if (x or "") == (h or "")]
        type_ = "revisit" if size >= least and i != max(same) else "response"
        want.append((i, size, digest(h), type_, max(same) if type_ == "revisit" else None))
    got = archive_index(spark, write_archive(pages(ROWS), min_bytes=least))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_payloads_are_kept_once_and_records_come_back(spark, pages):
    path = write_archive(pages(ROWS))
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    records = {r.page_id: r for r in read_records(spark, path).collect()}
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert {i: bytes(r.payload) for i, r in records.items()} == html
    head, _, block = bytes(records[3].record).partition(b"\r\n\r\n")
    assert block == html[3] + b"\r\n\r\n" and b"WARC-Target-URI: http://a/3%0D%0AX: y\r\n" in head and b"WARC-Type: response" in head
    head, _, block = bytes(records[1].record).partition(b"\r\n\r\n")
    assert block == b"\r\n\r\n" and b"WARC-Refers-To: <urn:page:3>" in head and b"Content-Length: 0" in head
    assert b"WARC-Target-URI" not in bytes(records[2].record)


def test_repeated_and_odd_rows(spark, pages):
    got = archive_index(spark, write_archive(pages([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "b")]))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [
        (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]
    assert archive_index(spark, write_archive(pages(ROWS).where("page_id > 99"))).collect() == []


def test_damage_is_noticed(spark, pages):
    path = write_archive(pages(ROWS))
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "n_bytes", "encode(replace(decode(payload, 'UTF-8'), 'o', 'u'), 'UTF-8') as payload").write.parquet(f"{path}-bad/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        archive_index(spark, f"{path}-bad").collect()
