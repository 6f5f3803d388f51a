"""WARC archive: exact round trip, revisits, damage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from offerlens.llm import warc

PAGES = "page_id bigint, url string, html string"
LONG = "<p>é</p>" * 30


def pages():
    rows = [(5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (3, "http://a/again", LONG), (None, "http://a/none", LONG)]
    rows += [(10, "http://b", "short"), (11, "http://b", "short"), (12, "x\r\nEvil: 1", None), (13, "", ""), (14, "u", "a\r\n\r\nb" * 50), (15, "u", "z" * 300_000)]
    rows += [(30, "http://a/\u0085X-Page-ID: 77", "p" * 120), (31, "b\u2028X-Page-ID: x\u2029WARC-Type: revisit", "r" * 120), (32, "c\x0bX-Page-ID: 1\x0c", "v")]
    rows += [(None, "n1", "q" * 200), (None, "n2", "q" * 200), (20, "e", "é" * 50), (21, "e", "é" * 50), (22, "e", "y" * 99), (23, "e", "y" * 99)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "payload": F.lit(2), "first": F.lit(3), "record_type": F.lit(4)})
    warc.write_archive(table, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/payloads")
    assert stored.count() == len({h or "" for *_, h in rows})
    found = warc.read_archive(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        payload = next((h or "" for i, _, h in rows if i == r.page_id and hashlib.sha256((h or "").encode()).hexdigest() == r.payload_digest)).encode()
        assert r.payload_bytes == len(payload)
        assert bytes(r.block) == (payload if r.record_type == "response" else b"")
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in found}
    assert kinds[(3, "http://a/3")] == kinds[(3, "http://a/again")] == ("response", None)
    assert kinds[(5, "http://a/5")] == kinds[(9, None)] == kinds[(None, "http://a/none")] == ("revisit", 3)
    assert kinds[(11, "http://b")] == kinds[(23, "e")] == kinds[(None, "n2")] == ("response", None)
    assert kinds[(21, "e")] == ("revisit", 20)
    assert kinds[(12, "x%0D%0AEvil: 1")] == ("response", None)
    assert kinds[(30, "http://a/\u0085X-Page-ID: 77")] == kinds[(31, "b\u2028X-Page-ID: x\u2029WARC-Type: revisit")] == ("response", None)
    assert kinds[(32, "c\x0bX-Page-ID: 1\x0c")] == ("response", None)


def test_text_ids(spark, tmp_path):
    ids = ["a", "", "x\r\ny", "50%0A", "%25", "é\u2028z", " s ", None]
    rows = [(i, f"u{n}", LONG if n < 5 else f"{n}") for n, i in enumerate(ids)]
    warc.write_archive(spark.createDataFrame(rows, PAGES.replace("page_id bigint", "page_id string")), str(tmp_path))
    found = {r.url: (r.page_id, r.refers_to) for r in warc.read_archive(spark, str(tmp_path), "string").collect()}
    assert found == {f"u{n}": (i, "" if n < 5 and i else None) for n, i in enumerate(ids)}


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(1, "u", LONG), (1, "u", LONG), (1, "v", LONG), (None, "u", LONG), (None, None, "x"), (None, None, "x"), (2, "w", LONG), (None, "-", "x"), (None, "", "x")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path))
    heads = [bytes(r.record).split(b"\r\n\r\n")[0].decode() for r in warc.read_records(spark, str(tmp_path)).collect()]
    line = lambda head, name: next((x.split(": ", 1)[1] for x in head.split("\r\n") if x.startswith(name + ":")), None)
    ids = [line(h, "WARC-Record-ID") for h in heads]
    assert len(set(ids)) == len(rows)
    for h in heads:
        if line(h, "WARC-Type") == "revisit":
            first = heads[ids.index(line(h, "WARC-Refers-To"))]
            assert line(first, "WARC-Type") == "response" and line(first, "X-Page-ID") == line(h, "X-Refers-To-Page") == "1"


def test_many_records_of_small_payloads(spark, tmp_path):
    rows = [(i, f"u{i}", "" if i % 3 else f"{i % 5}") for i in range(300)]
    warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path))
    found = warc.read_archive(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.block).decode()) for r in found) == [(i, h) for i, _, h in rows]


def test_record_bytes_and_export(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "http://a/", LONG), (2, "http://b/", LONG)], PAGES), str(tmp_path))
    records = {bytes(r.record) for r in warc.read_records(spark, str(tmp_path)).collect()}
    response = next(r for r in records if b"WARC-Type: response" in r)
    revisit = next(r for r in records if b"WARC-Type: revisit" in r)
    head, block = response.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and block == LONG.encode() + b"\r\n\r\n"
    assert f"Content-Length: {len(LONG.encode())}".encode() in head
    digest = hashlib.sha256(LONG.encode()).hexdigest().encode()
    assert b"sha256:" + digest in head and b"sha256:" + digest in revisit
    own = next(line for line in head.split(b"\r\n") if line.startswith(b"WARC-Record-ID"))
    assert own.split(b": ")[1] in revisit and revisit.endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    warc.export_warc(warc.read_records(spark, str(tmp_path)), f"{tmp_path}/files")
    written = b"".join(p.read_bytes() for p in (tmp_path / "files").glob("*.txt"))
    assert len(written) == sum(map(len, records)) and all(r in written for r in records)


def test_damage_is_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", LONG), (2, "u", "other" * 50)], PAGES), f"{tmp_path}/good")
    spark.read.parquet(f"{tmp_path}/good/headers").write.parquet(f"{tmp_path}/bad/headers")
    payloads = spark.read.parquet(f"{tmp_path}/good/payloads")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/bad/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(spark, f"{tmp_path}/bad").collect()
    spark.read.parquet(f"{tmp_path}/good/headers").write.parquet(f"{tmp_path}/less/headers")
    payloads.limit(1).write.parquet(f"{tmp_path}/less/payloads")
    with pytest.raises(Exception, match="payload is missing"):
        warc.read_records(spark, f"{tmp_path}/less").collect()


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path))
    assert warc.read_archive(spark, str(tmp_path)).count() == 0
