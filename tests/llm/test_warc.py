import gzip
import hashlib

import pytest

from graphloom.llm.common import filesystem, work_path
from graphloom.llm.warc import _Input, page_records, read_archives, read_records, write_archives

SCHEMA = "page_id long, url string, html string, digest int"
BIG, OTHER = "<p>é</p>" * 400, "<b>x</b>" * 400
ROWS = [(1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, "http://a b\n", BIG), (9, "u", OTHER), (10, "u", "tiny"), (11, "u", "tiny"), (12, None, None), (13, "", "\r\n\r\nWARC/1.1\r\n"), (7, "http://a/7", BIG), (None, "n", OTHER)]


def pages(spark):
    return spark.createDataFrame([(*r, 0) for r in ROWS], SCHEMA).repartition(3)


def expected():
    out = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        best = max((p for p, _, h in ROWS if p is not None and (h or "") == (html or "")), default=None)
        revisit = len(data) >= 1000 and (page is None or page < best)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    path = work_path(spark, "warc")
    write_archives(pages(spark), path, compress=compress)
    assert sorted(map(tuple, page_records(spark, path).collect()), key=str) == expected()
    payloads = sorted((r.payload or b"").decode() for r in read_archives(spark, path).where("record_type = 'response'").collect())
    assert payloads == sorted(h or "" for (p, _, h), e in zip(ROWS, ROWS, strict=True) if (p, len((h or "").encode())) in {(x[0], x[1]) for x in expected() if x[3] == "response"})


def test_filters_are_pushed_and_payloads_skipped(spark):
    path = work_path(spark, "warc")
    write_archives(pages(spark).coalesce(1), path)
    read = read_archives(spark, path, payload=False)
    rows = read.where("record_type = 'revisit' and target_uri in ('http://a/1', 'n')").collect()
    assert {r.target_uri for r in rows} == {"http://a/1", "n"} and all(r.payload is None for r in rows)
    plan = read.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.split("BatchScan")[0]  # no filter is left above the scan
    assert read.where("payload_bytes > 3000").count() == 6


def test_members_split_and_standard_tools(spark, tmp_path):
    path = work_path(spark, "warc")
    write_archives(pages(spark).coalesce(1), path)
    parts = spark.read.format("warc").option("splitBytes", "200").load(path)
    assert parts.count() == len(ROWS) and parts.rdd.getNumPartitions() > 3
    system, at = filesystem(path)
    from pyarrow import fs

    name = next(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".gz"))
    data = open(name, "rb").read()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC-Record-ID") == len(ROWS)
    # Members without the length field, as other writers make them, are read alike.
    source, other = _Input(name), tmp_path / "other.warc.gz"
    offsets = [r[-1] for r in read_records(name, 0, source.size, {}, False)] + [source.size]
    other.write_bytes(b"".join(gzip.compress(gzip.decompress(data[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)))
    strip = lambda rows: [r[:-2] for r in rows]
    for wanted in ({}, {"record_type": {"revisit"}}):
        assert strip(read_records(str(other), 0, 10**9, wanted, True)) == strip(read_records(name, 0, 10**9, wanted, True))


def test_empty_table(spark):
    path = work_path(spark, "warc")
    write_archives(pages(spark).limit(0), path)
    assert page_records(spark, path).collect() == []


def test_clashing_columns_and_a_long_payload(spark):
    path = work_path(spark, "warc")
    long = "<p>" + "x\r\n\r\n" * 300_000
    rows = [(1, "u", long, 1, "a"), (2, "v", long, 2, "b"), (3, "w", "short", 3, "c")]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, latest int, salt string"), path)
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in page_records(spark, path).collect()) == [(1, "revisit", len(long)), (2, "response", len(long)), (3, "response", 5)]
