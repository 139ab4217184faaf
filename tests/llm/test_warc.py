"""The archive against a plain reader of WARC bytes."""

import base64
import hashlib
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import warc


def plain_records(data):
    """(fields, block) of every record in a WARC file."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def number(urn):
    key = unquote_plus(urn.removeprefix("<urn:row:").rpartition(":")[0])
    return int(key) if key else None


ROWS = [
    (1, "http://a/\r\nWARC-Type: x", "same"),
    (2, "http://a/ü", "same"),
    (3, None, "same"),
    (4, "u", None),
    (5, "u", ""),
    (6, "", "größe \U0001f600\r\n\r\nWARC/1.1"),
    (7, "u", "x" * 300_000),
    (8, "u", "once"),
    (8, "u", "once"),
    (None, "u", "once"),
    (None, "u", "alone"),
]


def expected(rows, min_bytes=0):
    groups = {}
    for key, _, text in rows:
        groups.setdefault((text or "").encode(), []).append(key)
    out = []
    for data, keys in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        best = max(keys, key=lambda k: (k is not None, k))
        whole = len(data) < min_bytes
        first = keys.index(best)
        out += [
            (k, len(data), digest, "response" if whole or i == first else "revisit", None if whole or i == first else best)
            for i, k in enumerate(keys)
        ]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archive_against_plain_reader(spark, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "SPREAD", 2)
    docs = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, key string").repartition(4)
    got = warc.archive_pages(docs, min_bytes=min_bytes)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = got.select(*columns, "url", "header", "record").collect()
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == expected(ROWS, min_bytes)
    texts = {(k, hashlib.sha1((t or "").encode()).digest()): (u, (t or "").encode()) for k, u, t in ROWS}
    records = list(plain_records(b"".join(bytes(r.record) for r in rows)))
    assert len(records) == len(ROWS)
    for r, (fields, block) in zip(rows, records, strict=True):
        assert bytes(r.record).startswith(bytes(r.header))
        assert number(fields["WARC-Record-ID"]) == r.page_id and fields["WARC-Type"] == r.record_type
        url, payload = texts[r.page_id, base64.b32decode(r.payload_digest)]
        assert fields.get("WARC-Target-URI", "") == (url or "").replace("\r", "%0D").replace("\n", "%0A")
        http, _, body = block.partition(b"\r\n\r\n")
        assert f"Content-Length: {len(payload)}".encode() in http
        assert body == (payload if r.record_type == "response" else b"")
        if r.record_type == "revisit":
            assert number(fields["WARC-Refers-To"]) == r.refers_to
            target = [f for f, _ in records if f["WARC-Record-ID"] == fields["WARC-Refers-To"]]
            assert [f["WARC-Type"] for f in target] == ["response"]


def test_payloads_are_stored_once(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), (F.col("id") % 3).cast("string").alias("html"))
    warc.write_archive(docs, str(tmp_path / "a"))
    stored = warc.stored_payloads(spark, str(tmp_path / "a")).select("uses", F.decode("payload", "utf-8")).collect()
    assert sorted(map(tuple, stored)) == [(1666, "2"), (1667, "0"), (1667, "1")]
    got = warc.read_archive(spark, str(tmp_path / "a")).groupBy("record_type", "refers_to").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("response", None, 3), ("revisit", 4997, 1665), ("revisit", 4998, 1666), ("revisit", 4999, 1666)], key=repr
    )


def test_changed_payloads_and_headers_raise(spark, tmp_path):
    docs = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(docs, str(tmp_path / "a"))
    records, payloads = (spark.read.parquet(str(tmp_path / "a" / t)) for t in ("records", "payloads"))
    records.write.parquet(str(tmp_path / "b" / "records"))
    payloads.withColumn("payload", F.encode(F.lit("abd"), "utf-8")).write.parquet(str(tmp_path / "b" / "payloads"))
    with pytest.raises(Exception, match="SHA-256"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    cut = F.encode(F.replace(F.decode("header", "utf-8"), F.lit("Content-Length: 3\r\n\r\n"), F.lit("")), "utf-8")
    records.withColumn("header", cut).write.parquet(str(tmp_path / "c" / "records"))
    payloads.write.parquet(str(tmp_path / "c" / "payloads"))
    with pytest.raises(Exception, match="header"):
        warc.read_archive(spark, str(tmp_path / "c")).collect()


def test_empty_table_and_string_ids(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    docs = spark.createDataFrame([("a:b c/ü", "u", "t"), ("z", "u", "t")], "page_id string, url string, html string")
    got = warc.archive_pages(docs).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == [("a:b c/ü", "revisit", "z"), ("z", "response", None)]
