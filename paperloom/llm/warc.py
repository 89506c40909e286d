"""Content-addressed web archive: payload bytes once by digest, exact record headers separately.

Two tables make an archive: ``payloads`` (the SHA-256 address, the bytes) and ``headers`` (page_id,
the record's header block byte for byte, the address, and whether the record carries its payload). A
record is its header block, its payload if it carries it, and two line ends: joins on the address put
the original records together again. What a record says is read from those bytes alone, and a
revisit's payload is that of the response it refers to.

Equal addresses must hold equal bytes: a second digest (SHA-512) is compared when payloads are grouped,
which sends each payload once, and every payload is held against its address when it is read.

Defined results: a null html is an empty payload; a null url is an empty target; of equal payloads
the largest page_id is the response, and rows that repeat it are responses too (the same record
again, under the same record id); if all page_ids of a payload are null, all are responses. Line ends
in urls are escaped. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, new_path

#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of five."""

    def four(at: int) -> list[Column]:
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, 1) for shift in (15, 10, 5, 0)]

    return F.concat(*(c for at in range(1, 41, 5) for c in four(at)))


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, captured: str | None = None) -> None:
    """Write the records of ``pages`` (page_id, url, html), captured at a time (as in WARC-Date; else now).

    Payloads are grouped by address with map-side combining, so a payload that a third of all pages
    share is sent once by each task; only ids and digests are joined back.
    """
    captured = captured or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("long").alias("size"))
    second = F.unhex(F.sha2("payload", 512))
    stored = rows.groupBy("address").agg(F.min("payload").alias("payload"), F.min(second).alias("least"), F.max(second).alias("most"))
    differ = F.raise_error(F.concat(F.lit("two payloads share the address "), F.col("address"))).cast("binary")
    stored.select("address", F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(differ).alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = rows.select("page_id", "url", "address", "size", sha1_base32(F.col("payload")).alias("digest"))
    largest = facts.where(F.col("size") >= least_bytes).groupBy("address").agg(F.max("page_id").alias("largest"))
    kinds = facts.join(largest, "address", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("largest"), F.col("page_id").isNull() & F.col("largest").isNotNull()))
    named = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(":"), F.substring("address", 1, 16), F.lit(">"))
    record = F.when(F.col("revisit") | F.col("page_id").isNull(), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(named(F.col("page_id")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record),
        F.lit(f"WARC-Date: {captured}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), named(F.col("largest")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))).cast("string")),
    ]
    block = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.col("http")), "UTF-8")
    kinds.withColumn("http", http).select("page_id", "address", (~F.col("revisit")).alias("whole"), block.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _checked(payloads: DataFrame) -> DataFrame:
    """Payloads whose bytes still have their address; anything else stops the query."""
    bad = F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address")))
    return payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(bad.cast("binary")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id and record, its exact bytes. Only records that carry a payload are joined."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), _checked(spark.read.parquet(f"{path}/payloads"))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    whole = headers.where("whole").join(payloads, "address").select("page_id", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(headers.where("not whole").select("page_id", F.concat("header", end).alias("record")))


def _fields(records: DataFrame) -> DataFrame:
    """What the bytes of records say: page_id, record_id, record_type, said (digest), refers_to_id, payload.

    A record whose lengths don't fit its bytes stops the query.
    """
    bytes_at = F.decode("record", "ISO-8859-1")  # one character for each byte
    gap = F.lit(CRLF * 2)
    split = records.select("page_id", "record", F.locate(CRLF * 2, bytes_at).alias("cut"))
    head = F.expr("substring(record, 1, cut + 1)")
    block = F.expr("substring(record, cut + 4, octet_length(record) - cut - 7)")
    split = split.select("page_id", F.decode(head, "UTF-8").alias("head"), block.alias("block"), (F.substring("record", -4, 4) == F.encode(gap, "UTF-8")).alias("closed"))
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    wrong = F.raise_error(F.concat(F.lit("a record's length differs from its bytes: "), F.col("head"))).cast("binary")
    sound = F.col("closed") & (F.expr("try_cast(length as long)") == F.octet_length("block"))
    said = split.select("page_id", "head", "block", "closed", field("Content-Length").alias("length"), field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("said"), field("WARC-Refers-To").alias("refers_to_id"))
    said = said.withColumn("block", F.when(sound, F.col("block")).otherwise(wrong))
    http = F.locate(CRLF * 2, F.decode("block", "ISO-8859-1"))
    return said.select("page_id", "record_id", "record_type", "said", "refers_to_id", F.substring("block", http + 4, F.octet_length("block")).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the reconstructed records say: kind, reference, and size and digest of the payload's bytes.

    Each record is parsed from its bytes. A revisit has none of its payload's: size and digest are
    those of the response it refers to, and must be what the revisit itself says.
    """
    read = _fields(reconstruct(spark, path)).select("page_id", "record_id", "record_type", "said", "refers_to_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    scratch = Scratch(spark)
    read = scratch.table(read, "records")  # records are put together and parsed once
    responses = read.where("record_type = 'response'")
    referred = responses.where("record_id like '<urn:page:%'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    revisits = read.where("record_type = 'revisit'").select("page_id", "record_type", "said", F.col("refers_to_id").alias("record_id")).join(referred, "record_id", "left")
    both = responses.withColumn("refers_to", F.lit(None).cast("long")).select(*_PARSED).unionByName(revisits.select(*_PARSED))
    wrong = F.raise_error(F.concat(F.lit("header and payload disagree on "), F.coalesce("said", F.lit("?")))).cast("string")
    digest = F.when(F.col("said") == F.concat(F.lit("sha1:"), "payload_digest"), F.col("payload_digest")).otherwise(wrong)
    return both.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


_PARSED = ["page_id", "record_type", "said", "payload_bytes", "payload_digest", "refers_to"]


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder, put its records together again and read them."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    return read_records(pages.sparkSession, path)
