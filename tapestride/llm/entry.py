"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, lines, media, minhash, packing, suffixes, toxicity, urlfilter, vectors, warc
from .common import Scratch, documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies; ``TAPESTRIDE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("TAPESTRIDE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), 80)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(documents(spark, sf_dir, "embeddings"), 0.9)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = Scratch(spark, "warc")
    warc.write_archive(documents(spark, sf_dir, "pages"), held)
    return warc.read_archive(held)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), 1024, 2)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(documents(spark, sf_dir))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(documents(spark, sf_dir, "pages"), rules)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


QUERIES = {"op1_minhash": op1_minhash, "op2_embeddings": op2_embeddings, "op3_suffixes": op3_suffixes, "op4_toxicity": op4_toxicity, "op5_warc": op5_warc, "op6_bpe": op6_bpe, "op7_packing": op7_packing, "op8_url_filter": op8_url_filter, "op9_media": op9_media, "op10_lines": op10_lines}

ORACLE_SQL = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
        FROM f""",
    "op8_url_filter": """
        WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (SELECT b.page_id, b.host, b.path, rh || rp AS rule, v,
                     row_number() OVER (PARTITION BY b.page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
              FROM b LEFT JOIN r ON (b.host = rh OR ends_with(b.host, '.' || rh)) AND starts_with(b.path, rp))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
}
