"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records by a join.

``write_archive`` builds a WARC/1.1 record for each row and stores two tables under a path: ``headers`` (the exact header
block of each record and the digest that leads to its payload) and ``payloads`` (digest, bytes), one row a digest. Of rows
with equal payloads of at least ``least`` bytes the one with the smallest id becomes a response, the others revisits whose
own block is empty. ``read_archive`` joins the two back to whole records, checks every payload against its digest, and
takes all it returns from the header block as stored. ``record_bytes`` is the record as it stands in a WARC file.

Nulls: a null payload is empty; a null URL leaves WARC-Target-URI out; rows with a null id are revisits where another row
of the payload has an id, else responses. Rows that repeat an id and its payload are responses alike. Line breaks in a URL
are percent-encoded, so that no value can end its header field. Payloads of any length are stored whole. Empty tables give an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, maybe_among

#: Shorter payloads are not worth a revisit record.
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record_id(value: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))


def header_block(id_: Column, url: Column, kind: Column, size: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """Version line and named fields, each with its line end; the empty line that ends the block is not part of it."""
    revisit = kind == "revisit"
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _record_id(id_)),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", clean),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _field("WARC-Refers-To", F.when(revisit, _record_id(refers_to))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(size)),
    )


def write_archive(df: DataFrame, path: str, id_: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archive of ``df`` to ``path``/headers and ``path``/payloads."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8") if dict(df.dtypes)[payload] == "string" else F.col(payload), F.lit(b""))
    rows = df.select(F.col(id_).alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    scratch = Scratch()
    # Only digests and lengths are shuffled to find the first record of each payload.
    marks = scratch.written(rows.select("id", "url", F.octet_length("payload").cast("long").alias("size"), "digest"), "warc-marks")
    first = marks.groupBy("digest").agg(F.min("id").alias("first_id"), F.min("size").alias("a"), F.max("size").alias("b"))
    same = F.assert_true(F.col("a") == F.col("b"), "payloads of one digest differ in length")
    first = first.select("digest", F.when(same.isNull(), F.col("first_id")).alias("first_id"))
    first = scratch.written(first, "warc-first")  # apart, so that Spark can split the rows of a hot digest in the join
    kind = F.when((F.col("size") < least) | F.col("first_id").isNull() | F.col("id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    refers = F.when(F.col("kind") == "revisit", F.col("first_id"))
    headers = marks.join(first, "digest").withColumn("kind", kind).withColumn("refers_to", refers)
    header = header_block(F.col("id"), F.col("url"), F.col("kind"), F.col("size"), F.col("digest"), F.col("refers_to"), date)
    headers.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # The bytes of a payload leave their partition only if its record may be the first of its digest; of several there one goes on.
    stored = maybe_among(rows.select("id", "digest", "payload"), first.withColumnRenamed("first_id", "id"), ["digest", "id"])
    stored.groupBy("digest").agg(F.min("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    scratch.clear()


def _value(name: str) -> Column:
    got = F.regexp_extract("header", rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(got != "", got)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: record_id, target_uri, record_type, refers_to (ids as written), payload_digest, payload_bytes, header, payload.

    Fails if stored bytes do not have the digest they are filed under.
    """
    headers = spark.read.parquet(f"{path}/headers").select("digest", "header")
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = F.assert_true(F.sha2("payload", 256) == F.col("digest"), "stored bytes do not match their digest")
    payloads = payloads.withColumn("payload", F.when(checked.isNull(), F.col("payload")))
    bare = lambda c: F.regexp_extract(c, r"^<urn:record:(.*)>$", 1)
    return headers.join(payloads, "digest", "left").select(
        bare(_value("WARC-Record-ID")).alias("record_id"),
        _value("WARC-Target-URI").alias("target_uri"),
        _value("WARC-Type").alias("record_type"),
        bare(_value("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_value("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "header",
        "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """Adds ``record``: the header block, an empty line, the block (none in a revisit) and two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit(CRLF.encode())
    return records.withColumn("record", F.concat(F.encode("header", "UTF-8"), end, block, end, end))
