"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by a join.

An archive is a folder of two tables:

* ``payloads``: ``payload_id`` (SHA-256 of the bytes), ``payload``, ``uses`` (records that refer to it);
* ``records``: ``header`` (every byte of a record before its payload: WARC fields, blank line, HTTP
  header), ``payload_id``, ``uses``, ``whole`` (does the record carry the payload?).

Record = header, payload if ``whole``, then two line ends. Of records with equal payloads the one with
the largest id is a ``response``; the others are ``revisit`` records that refer to it and carry no payload.
Payloads shorter than ``min_bytes`` are always carried.

How: ids, digests and lengths are a narrow table; whose payload is whose is decided on (digest, salt)
sums, so a payload that a third of all rows share never meets in one task. The payloads are combined by
digest before their only shuffle. On reading, a payload that many records carry is repeated once for
every ``SPREAD`` of them, and records take one of its copies. Everything is DataFrame expressions.

Verified: on writing, rows of one SHA-256 must agree in length and SHA-1; on reading, each payload must
hash to its key, and each record's digest, payload and block lengths must be those of its header.
A difference raises.

Defined results: a null text is an empty payload; a null url gives no ``WARC-Target-URI`` field, and line
ends in a url are written as ``%0D`` and ``%0A``; null ids are smaller than all others and come back as
null; of rows with the same id and payload one is the response; other columns are not archived.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import materialise, scratch_path

MIN_BYTES = 0
SALTS = 64
SPREAD = 4096
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _urn(key: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:row:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """``Name: value`` lines; a null value leaves its line out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit("")) for name, value in pairs))


def _http(length: Column) -> Column:
    head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: ")
    return F.concat(head, length.cast("string"), F.lit(END + END))


def _header(whole: Column, date: str) -> Column:
    http = _http(F.col("__bytes"))
    block = F.octet_length(http) + F.when(whole, F.col("__bytes")).otherwise(0)
    url = F.replace(F.replace(F.col("__url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = _fields(
        ("WARC-Type", F.when(whole, F.lit("response")).otherwise(F.lit("revisit"))),
        ("WARC-Record-ID", _urn(F.col("__key"), F.col("__row"))),
        ("WARC-Target-URI", url),
        ("WARC-Date", F.lit(date)),
        ("WARC-Profile", F.when(~whole, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(~whole, _urn(F.col("__best.key"), -F.col("__best.back")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__sha1"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    return F.encode(F.concat(F.lit(f"WARC/1.1{END}"), fields, F.lit(END), http), "utf-8")


def write_archive(
    docs: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE
) -> None:
    """Write one record for every row of ``docs`` into the archive ``path``, which must be new."""
    payload = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), payload.alias("__payload"))
    named = rows.select(
        "__key",
        "__url",
        F.unhex(F.sha2("__payload", 256)).alias("payload_id"),
        base32_sha1(F.col("__payload")).alias("__sha1"),
        F.octet_length("__payload").cast("bigint").alias("__bytes"),
        F.monotonically_increasing_id().alias("__row"),
    )
    named = materialise(named, "warc-rows")  # row numbers stay what they are when a task runs again
    salted = named.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)))
    order = F.struct(F.col("__key").alias("key"), (-F.col("__row")).alias("back"))
    agree = [f(c).alias(f"__{f.__name__}{c}") for c in ("__bytes", "__sha1") for f in (F.min, F.max)]
    parts = salted.groupBy("payload_id", "__salt").agg(F.max(order).alias("__best"), F.count("*").alias("uses"), *agree)
    same = Window.partitionBy("payload_id")  # at most SALTS rows
    differ = (F.min("__min__bytes").over(same) != F.max("__max__bytes").over(same)) | (F.min("__min__sha1").over(same) != F.max("__max__sha1").over(same))
    chosen = parts.select(
        "payload_id",
        "__salt",
        F.max("__best").over(same).alias("__best"),
        F.when(differ, F.raise_error(F.lit("different payloads have one SHA-256")).cast("bigint")).otherwise(F.sum("uses").over(same)).alias("uses"),
    )
    whole = (F.col("__bytes") < min_bytes) | (F.col("__row") == -F.col("__best.back"))
    records = salted.join(chosen, ["payload_id", "__salt"])
    records.select("payload_id", "uses", whole.alias("whole"), _header(whole, date).alias("header")).write.parquet(f"{path}/records")

    once = rows.select(F.unhex(F.sha2("__payload", 256)).alias("payload_id"), F.col("__payload").alias("payload"))
    once.groupBy("payload_id").agg(F.first("payload").alias("payload"), F.count("*").alias("uses")).write.parquet(f"{path}/payloads")


RECORD_COLUMNS = "payload_id binary, uses bigint, whole boolean, header binary"
PAYLOAD_COLUMNS = "payload_id binary, payload binary, uses bigint"


def _copies(uses: Column) -> Column:
    return F.ceil(uses / SPREAD).cast("bigint")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("__fields", rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def _urn_key(urn: Column, kind: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(urn, r"^<urn:row:([^:]*):\d+>$", 1), F.lit(""))).cast(kind)


def stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payloads with ``bytes`` and ``digest``, each one checked against its key."""
    stored = spark.read.schema(PAYLOAD_COLUMNS).parquet(f"{path}/payloads")
    broken = F.raise_error(F.lit("a stored payload does not have the SHA-256 it is stored under"))
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("payload_id"), F.col("payload")).otherwise(broken.cast("binary"))
    stored = stored.withColumn("payload", checked)
    return stored.withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": base32_sha1(F.col("payload"))})


def read_archive(spark: SparkSession, path: str, key_type: str | T.DataType = "bigint") -> DataFrame:
    """All records of an archive, put together again.

    ``key, url, record_type, refers_to, payload_bytes, payload_digest`` (both of the full payload, also
    for a revisit), ``header`` and ``record`` (all bytes of the record).
    """
    kind = key_type.simpleString() if isinstance(key_type, T.DataType) else key_type
    payloads = stored_payloads(spark, path)
    records = spark.read.schema(RECORD_COLUMNS).parquet(f"{path}/records")
    copy = F.pmod(F.xxhash64("header"), _copies(F.col("uses"))).alias("__copy")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), _copies(F.col("uses")) - 1)).alias("__copy")
    fields = F.split_part(F.decode("header", "utf-8"), F.lit(END + END), F.lit(1)).alias("__fields")
    records = records.select("payload_id", copy, "whole", "header", fields)

    # a record that carries its payload needs the bytes, a revisit only the two facts about them
    full = records.where("whole").join(payloads.select("payload_id", copies, "payload", "bytes", "digest"), ["payload_id", "__copy"])
    short = records.where("not whole").join(payloads.select("payload_id", copies, "bytes", "digest"), ["payload_id", "__copy"])
    both = full.unionByName(short.withColumn("payload", F.lit(None).cast("binary")))

    record = F.concat("header", F.coalesce("payload", F.encode(F.lit(""), "utf-8")), F.encode(F.lit(END + END), "utf-8"))
    before = F.octet_length(F.encode(F.concat("__fields", F.lit(END + END)), "utf-8"))
    block = F.octet_length(record) - before - 4
    right = (_field("Content-Length").cast("bigint") == block) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "digest"))
    broken = F.raise_error(F.lit("a record differs from its header"))
    return both.select(
        _urn_key(_field("WARC-Record-ID"), kind).alias("key"),
        _field("WARC-Target-URI").alias("url"),
        F.when(right, _field("WARC-Type")).otherwise(broken.cast("string")).alias("record_type"),
        _urn_key(_field("WARC-Refers-To"), kind).alias("refers_to"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "header",
        record.alias("record"),
    )


def archive_pages(docs: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``docs`` to a new archive in the shared folder and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(docs, path, key, url, text, min_bytes)
    return read_archive(spark, path, docs.schema[key].dataType).withColumnRenamed("key", key)
