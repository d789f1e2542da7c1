"""Content-addressed web archive: payload bytes stored once, record headers kept apart, records rebuilt by a join.

Layout of a folder: ``payloads/`` holds each distinct payload once under its SHA-256 digest; ``records/`` holds the
exact header block of each WARC record, one per page, with the digest of its payload. A record's bytes are its header
block, its content and two line ends. Of records with equal payloads of ``revisit_from`` bytes or more, that with the
largest page id is a ``response``; the others are ``revisit`` records with an empty content that refer to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.storage import BROADCAST_IDS, materialise

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "page_id long, header string, digest string"


def _payload(html: str = "html"):
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def _record_id(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", revisit_from: int = 1000) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to the folder ``path``.

    A null html has an empty payload, a null url the target ``urn:none``; line ends in urls are percent-encoded so that
    a header stays one line a field. Repeated rows give repeated records; of rows that repeat an id and a payload, all
    are responses if the id is the largest. Copies are found on digests alone; payloads of other copies than the one
    kept are dropped before they move. An empty table gives an empty archive.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    hashed = pages.select(
        "page_id", "url", F.sha2(_payload(), 256).alias("digest"), F.sha1(_payload()).alias("sha1"), F.octet_length(_payload()).cast("long").alias("n")
    )
    hashed = materialise(hashed, "archive-digests")
    holders = materialise(hashed.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n_rows")), "archive-holders")
    linked = hashed.join(holders.filter("n_rows > 1").select("digest", "holder"), "digest", "left")
    same = F.coalesce(F.col("holder").eqNullSafe(F.col("page_id")), F.lit(True)) | F.col("holder").isNull()
    revisit = ~same & (F.col("n") >= revisit_from)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    url = F.replace(F.replace(F.coalesce("url", F.lit("urn:none")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1" + _END),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(field("WARC-Refers-To", _record_id(F.col("holder"))), field("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(_END),
    )
    linked.select("page_id", header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")

    # One row of each digest keeps its payload: that of the largest id, and one of them where rows repeat.
    keyed = pages.select("page_id", F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload"))
    spare = linked.filter("holder is not null and page_id is not null and page_id <> holder").select("page_id", "digest").distinct()
    few = spare.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keyed = keyed.join(F.broadcast(spare) if few else spare, ["page_id", "digest"], "left_anti")
    repeats = hashed.groupBy("page_id", "digest").count().filter("count > 1").limit(1).count()
    nulls = hashed.filter("page_id is null").limit(1).count()
    if repeats or nulls:
        keyed = keyed.dropDuplicates(["digest"])
    keyed.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive, joined with their payloads and parsed from their headers.

    Columns: page_id, record_type, refers_to, url, header, payload (of revisits too), verified (the payload has the
    stored SHA-256 and the header's SHA-1). A payload that many records share is stored once and met in the join.
    """
    records = spark.read.schema(_RECORDS).parquet(f"{path}/records")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    get = lambda name, what: F.nullif(F.regexp_extract("header", rf"\r\n{name}: {what}\r\n", 1), F.lit(""))
    joined = records.join(payloads, "digest", "left")
    return joined.select(
        get("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
        get("WARC-Type", r"(\w+)").alias("record_type"),
        get("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        get("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        "header",
        "payload",
        ((F.sha2("payload", 256) == F.col("digest")) & (F.concat(F.lit("sha1:"), F.sha1("payload")) == get("WARC-Payload-Digest", r"([^\r\n]*)"))).alias("verified"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """(page_id, record): the exact bytes of each WARC record; revisits have no content."""
    content = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), content, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write plain WARC files, one per partition. Records are UTF-8, so Spark's text sink gives their exact bytes."""
    text = F.concat("header", F.when(F.col("record_type") == "revisit", "").otherwise(F.decode("payload", "UTF-8")))
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
