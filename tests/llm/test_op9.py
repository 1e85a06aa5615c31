import hashlib

import pytest

from sediment.llm._common import new_folder
from sediment.llm.op9_warc import WarcError, archives, read_archive, read_archives, record, write_archives


def test_round_trip(spark):
    long = "<p>é</p>" * 40
    rows = [(3, "u3", long), (1, "u1", long), (2, None, None), (4, "u4\r\nx", ""), (5, "u5", "short"), (6, "u6", "short"), (7, "u7", "z" * 3_000_000), (1, "u1", long)]
    folder = new_folder(spark, "warc-test")
    index = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    assert index.agg({"records": "sum"}).first()[0] == len(rows)
    got = read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(x[2] for x in rows if x[0] == r["page_id"]) or ""
        raw = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        want = ("revisit", 1) if r["page_id"] == 3 else ("response", None)
        assert (r["record_type"], r["refers_to"]) == want
        assert r["payload"] == (None if r["page_id"] == 3 else raw)


def test_damage_is_found():
    payload = b"x" * 500
    (data, n), = archives(iter([record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)] * 3))
    assert n == 3 and len(list(read_archive(data))) == 3
    with pytest.raises(WarcError):
        list(read_archive(data[:-5]))
    with pytest.raises(WarcError):
        list(read_archive(b"\0" + data[1:]))
    wrong = record(1, "u", payload, hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(WarcError):
        list(read_archive(next(archives(iter([wrong])))[0]))


def test_empty_tables_clashing_columns_and_the_least_revisit(spark):
    shape = "page_id long, url string, html string, payload string, digest int, refers_to string"
    empty = new_folder(spark, "warc-empty")
    assert write_archives(spark.createDataFrame([], shape), empty).collect() == []
    rows = [(2, "u", "x" * 99, "p", 1, "r"), (1, "u", "x" * 99, None, 2, None), (4, "u", "y" * 100, "p", 3, "r"), (3, None, "y" * 100, "p", 4, "r"), (None, "u", "y" * 100, "p", 5, "r")]
    folder = new_folder(spark, "warc-clash")
    write_archives(spark.createDataFrame(rows, shape), folder).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in read_archives(spark, folder).collect()), key=str)
    assert got == sorted([(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (None, "revisit", 3)], key=str)
