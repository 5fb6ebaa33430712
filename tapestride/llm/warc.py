"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, after a check that rows which share it
agree in length and in a second hash. Exact record headers stand in a table of their own and
name that key; original records come back through a join of the two. Everything runs in
built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Payloads shorter than this are never stored as revisits.
LEAST = 1000


def _facts(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select("page_id", "url", payload.alias("payload"))
    return base.withColumns({"key": F.sha2("payload", 256), "n": F.length("payload").cast("long")})


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, held: Scratch, date: str = "2000-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Writes tables ``payloads`` (key, payload) and ``headers`` (page_id, key, header).

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id
    is the response, others revisit it; rows that repeat that page_id are responses too. A
    null html is an empty payload, a null url an empty target; line ends in a url are
    escaped. An empty table gives an empty archive.
    """
    facts = _facts(pages)
    # Partial aggregation keeps one payload of a key per map task, so copies are not shuffled.
    by_key = facts.groupBy("key").agg(F.first("payload").alias("payload"), F.max("page_id").alias("keeper"), F.min("n").alias("n"), F.max("n").alias("n_most"), F.min(F.xxhash64("payload")).alias("h"), F.max(F.xxhash64("payload")).alias("h_most"))
    same = (F.col("n") == F.col("n_most")) & (F.col("h") == F.col("h_most"))
    checked = by_key.select("key", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary")).alias("payload"), "keeper", "n", F.sha1("payload").alias("sha1"))
    kept = held.write(checked, "payloads").select("key", "keeper", "n", "sha1")
    light = facts.select("page_id", "url", "key").join(kept, "key")
    response = (F.col("n") < least) | F.col("page_id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        _field("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        _field("WARC-Record-ID", urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        F.when(response, F.lit("")).otherwise(F.concat(_field("WARC-Refers-To", urn(F.col("keeper"))), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(response, F.col("n")).otherwise(F.lit(0)).cast("string")),
        _field("WARC-Target-URI", url),
        F.lit("\r\n"),
    )
    held.write(light.select("page_id", "key", header.cast("binary").alias("header")), "headers")


def _read(held: Scratch) -> tuple[DataFrame, DataFrame]:
    read = held.spark.read
    return read.schema("page_id long, key string, header binary").parquet(held.path("headers")), read.schema("key string, payload binary").parquet(held.path("payloads"))


def records(held: Scratch) -> DataFrame:
    """(page_id, record): the original records, header, payload (none in a revisit) and two line ends."""
    headers, payloads = _read(held)
    body = F.when(F.instr(F.col("header").cast("string"), "\r\nWARC-Type: revisit\r\n") > 0, F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "key").select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def read_archive(held: Scratch) -> DataFrame:
    """What the archive holds per page, from the stored headers and the stored payload bytes.

    A payload whose bytes no longer have their key, or whose SHA-1 is not the header's, is an error.
    """
    headers, payloads = _read(held)
    sound = F.sha2("payload", 256) == F.col("key")
    found = payloads.select("key", F.when(sound, F.length("payload").cast("long")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("long")).alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    text = F.col("header").cast("string")
    parsed = headers.select(
        F.nullif(F.regexp_extract(text, r"\r\nWARC-Record-ID: <urn:page:(-?\d*)>", 1), F.lit("")).cast("long").alias("page_id"),
        "key",
        F.regexp_extract(text, r"\r\nWARC-Type: (\w+)", 1).alias("record_type"),
        F.nullif(F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:(-?\d*)>", 1), F.lit("")).cast("long").alias("refers_to"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:(\w+)", 1).alias("said"),
    )
    digest = F.when(F.col("said") == F.col("payload_digest"), F.col("said")).otherwise(F.raise_error(F.lit("a header names another digest")).cast("string"))
    return parsed.join(found, "key").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
