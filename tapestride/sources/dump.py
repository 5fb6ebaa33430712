"""Page dumps in XML and what is read from their markup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.wikitext import Page

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.IntegerType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_space", T.StringType())]))])),
    ]
)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, source) of every page; ns is 0 and redirect null where they are missing."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return raw.select("title", F.coalesce("ns", F.lit(0)).alias("ns"), F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("source"))


def articles(pages: DataFrame) -> DataFrame:
    """Pages of the main namespace that have a text."""
    return pages.where((F.col("ns") == 0) & (F.coalesce("source", F.lit("")) != ""))


_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField("surface", T.StringType()), T.StructField("destination", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def parse(pages: DataFrame) -> DataFrame:
    """Adds ``text`` and ``links`` (surface, destination, start, end in characters) from ``source``; a page that can't be read goes."""

    @F.pandas_udf(_PARSED)
    def read(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for s in sources:
            try:
                page = Page(s or "")
                rows.append((page.text, [{"surface": a, "destination": b, "start": c, "end": d} for a, b, c, d in page.links]))
            except RecursionError:
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["text", "links"])

    parsed = pages.withColumn("__page", read("source"))
    return parsed.select(*pages.columns, F.col("__page.text").alias("text"), F.col("__page.links").alias("links")).where("text is not null")


def links(parsed: DataFrame) -> DataFrame:
    """One cleaned row per link: source title, position, surface, destination and the surface's form."""
    rows = parsed.select(F.col("title").alias("source"), F.posexplode("links").alias("pos", "l")).select("source", F.col("pos").cast("long").alias("pos"), "l.surface", "l.destination", "l.start", "l.end")
    return tx.clean_links(rows).withColumn("surface_repr", tx.surface_repr(F.split(F.trim("surface"), r"\s+")))


def link_tokens(parsed: DataFrame) -> DataFrame:
    """Token index of each link's first token, by a range join of character offsets within a page."""
    places = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))
    # The offset of a token is the length of the tokens and blanks before it, as text is blank-joined.
    ahead = Window.partitionBy("title").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    before = parsed.select("title", F.posexplode(places).alias("token", "word")).withColumn("at", F.coalesce(F.sum(F.length("word") + 1).over(ahead), F.lit(0)))
    spans = parsed.select("title", F.explode("links").alias("l")).select("title", "l.surface", "l.destination", F.col("l.start").alias("start"), F.col("l.end").alias("end"))
    met = spans.join(before, "title").where("at >= start and at < end")
    return met.groupBy("title", "surface", "destination", "start").agg(F.min("token").cast("long").alias("token"), F.array_sort(F.collect_list(F.struct("token", "word"))).alias("words"))
