"""Archives against plain reading, and the cases that the docstrings define."""

import glob
import gzip
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import warc

PAGES = "page_id long, url string, html string, payload string"


def pages(spark, rows):
    """Pages with a column whose name clashes with one of an archive."""
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)


def brute(rows):
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", []).append(i)
    out, seen = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (html or "").encode()
        low = min((x for x in first[html or ""] if x is not None), default=None)
        revisit = (html or "") in seen
        seen.add(html or "")
        out.append((i, len(b), warc.base32_sha1(b), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4\r\nWARC-Type: fake", ""), (5, "u", "x" * 300_000),
    (6, "u", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "x" * 300_000), (8, "ü", "q"), (8, "ü", "q"), (None, "n", "q"), (None, "n", "only null"), (None, "n", "only null"),
    *[(100 + i, f"http://b/{i}", f"page {i % 40} " * (i % 40)) for i in range(200)],
]


def test_round_trip_of_odd_rows(spark, monkeypatch):
    assert sorted(map(tuple, warc.round_trip(pages(spark, ROWS)).collect()), key=str) == brute(ROWS)
    monkeypatch.setattr(warc, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, warc.round_trip(pages(spark, ROWS)).collect()), key=str) == brute(ROWS)
    assert warc.round_trip(pages(spark, ROWS).filter("false")).count() == 0


def test_least_size(spark):
    got = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, ROWS[:5]), least=1).collect()}
    assert got == {1: "response", 2: "revisit", 3: "response", 4: "response", 5: "response"}


def test_sql_agrees(spark):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 8]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(warc.SQL).fetchall(), key=str) == brute(rows)


def write(spark, rows, path, mode="append", **options):
    warc.register(spark)
    kind = "type string, record_id string, uri string, refers_to string, payload binary, payload_bytes long, payload_sha1 string"
    df = spark.createDataFrame(rows, kind).coalesce(1)
    df.write.format("warc").options(**options).mode(mode).save(path)


def responses(n):
    return [("response", f"urn:page:{i}", f"http://h{i % 3}/{i}", None, f"payload {i} ".encode() * (i + 1), None, None) for i in range(n)]


def test_predicates_are_handed_down_and_unwanted_payloads_left_alone(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, responses(30), path, split=500)
    name = glob.glob(f"{path}/*.warc.gz")[0]
    with pytest.raises(Exception, match="cannot be read|decompress"):  # noqa: PT012
        _spoil(name, 7)
        warc.read_warc(spark, path).collect()
    with warc.pushdown(spark):
        read = warc.read_warc(spark, path)
        asked = read.filter("uri like 'http://h2/%' and type in ('response', 'metadata') and record_id <> 'urn:page:2' and content_length > 10 and payload_digest is not null and refers_to is null")
        assert sorted(int(r.record_id[9:]) for r in asked.collect()) == [i for i in range(30) if i % 3 == 2 and i != 2]
        assert asked.filter("record_id = 'urn:page:5'").first().payload == b"payload 5 " * 6
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan
        assert read.filter("type = 'warcinfo'").count() == 1
        assert read.filter("uri is null").count() == 1
        # what Spark keeps for itself: other columns, functions of columns
        assert read.filter("uri like 'http://h2/%' and payload_bytes = 60 and length(uri) = 11 and not uri <=> 'http://h0/3'").count() == 1
    assert spark.conf.get(warc.PUSHDOWN, "false") == "false"


def _spoil(name, n):
    """Overwrite the packed payload of the n-th page, but not its headers."""
    with open(name, "r+b") as f:
        data, at, k = f.read(), 0, 0
        while True:
            length = int.from_bytes(data[at + 16 : at + 20], "little")
            if k == n + 1:
                f.seek(at + length - 12)
                f.write(b"\xff" * 12)
                return
            at, k = at + length, k + 1


def test_archives_are_split_at_records(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, responses(40), path, split=600)
    warc.register(spark)
    read = spark.read.format("warc").option("split", 600).load(path)
    assert read.rdd.getNumPartitions() > 5
    assert sorted(r.record_id for r in read.filter("type = 'response'").collect()) == sorted(f"urn:page:{i}" for i in range(40))
    assert read.filter("type = 'response'").where(F.col("digest") != F.col("payload_digest")).count() == 0


def test_only_what_a_manifest_names_is_read(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, responses(3), path)
    with open(f"{path}/left-by-a-lost-task.warc.gz", "wb") as f:
        f.write(warc.member(warc.record_bytes({"type": "response", "record_id": "urn:page:99", "payload": b"x"})))
    ids = lambda: sorted(r.record_id for r in warc.read_warc(spark, path, "none").filter("type = 'response'").collect())
    assert ids() == ["urn:page:0", "urn:page:1", "urn:page:2"]
    write(spark, responses(1), path)
    assert len(ids()) == 4
    write(spark, responses(2), path, "overwrite")
    assert ids() == ["urn:page:0", "urn:page:1"] and len(os.listdir(path)) >= 2
    write(spark, [], path, "overwrite")
    assert ids() == []


def test_archives_from_elsewhere(spark, tmp_path):
    records = [warc.record_bytes({"type": "response", "record_id": f"urn:page:{i}", "uri": f"http://{i}", "payload": b"p" * i * 3000}) for i in range(6)]
    records.append(b"warc/1.0\r\n".upper() + b"warc-type: metadata\r\nWARC-Record-ID: <urn:m>\r\nX-Folded: a\r\n b\r\ncontent-length: 4\r\n\r\nabcd\r\n\r\n")
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "notes.txt").write_text("not an archive")
    for payload in ("none", "digest", "whole"):
        got = warc.read_warc(spark, str(tmp_path), payload).collect()
        assert len(got) == 21 and {r.payload_bytes for r in got if r.record_id == "urn:page:3"} == {9000}
        assert {(r.type, r.content_length) for r in got if r.record_id == "urn:m"} == {("metadata", 4)}
        if payload == "whole":
            assert {bytes(r.payload) for r in got if r.record_id == "urn:m"} == {b"abcd"}
    with warc.pushdown(spark):
        assert warc.read_warc(spark, str(tmp_path)).filter("type = 'metadata'").count() == 3
    (tmp_path / "cut.warc").write_bytes(records[5][:-9000])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path)).collect()
