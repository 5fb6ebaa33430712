"""Link statistics: counts, redirect resolution, conditional probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

ANCHOR = r'(<a href="[^"]*">[^<]*</a>)'


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(source, pos, surface, destination) of every anchor, in the order of the page."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(ANCHOR), F.lit(1))
    rows = pages.select(F.col(id_col).alias("source"), F.posexplode(found).alias("pos", "a"))
    part = lambda k: F.regexp_extract("a", r'<a href="([^"]*)">([^<]*)</a>', k)
    return rows.select("source", F.col("pos").cast("long").alias("pos"), part(2).alias("surface"), F.regexp_replace(part(1), "^/", "").alias("destination"))


def with_ids(links: DataFrame) -> DataFrame:
    return links.withColumn("id", F.concat_ws("-", F.lit("L"), F.col("source").cast("string"), F.lpad(F.col("pos").cast("string"), 8, "0"), "surface"))


def surface_document_counts(links: DataFrame) -> DataFrame:
    """Per surface its smallest raw form and the number of pages that link it."""
    return links.groupBy("surface_repr").agg(F.min("surface").alias("surface"), F.countDistinct("source").alias("n_docs"))


def pair_counts(links: DataFrame, key: str, target: str) -> DataFrame:
    return links.groupBy(key, target).agg(F.count("*").alias("cnt"))


def resolve(counts: DataFrame, redirects: DataFrame, target: str, rounds: int = 3) -> DataFrame:
    """Follows redirects (from, to) from ``target``, ``rounds`` hops at most; the plan is unrolled."""
    step = redirects.select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    for _ in range(rounds):
        counts = counts.join(step, F.col(target) == F.col("__from"), "left").withColumn(target, F.coalesce("__to", target)).drop("__from", "__to")
    return counts


def conditional(counts: DataFrame, key: str, target: str) -> DataFrame:
    """P(target | key) from counts; counts that came to share a target are added up first.

    The totals are an aggregate of their own and joined back, so that a key with a third of all
    rows is reduced before the shuffle and is no single task's window.
    """
    summed = counts.groupBy(key, target).agg(F.sum("cnt").alias("cnt"))
    totals = counts.groupBy(F.col(key).alias("__key")).agg(F.sum("cnt").alias("__total"))
    return summed.join(totals, F.col(key) == F.col("__key")).select(key, target, (F.col("cnt") / F.col("__total")).alias("prob"))


def redirects_of(destinations: DataFrame) -> DataFrame:
    """(from, to): destinations whose normal form differs and is a destination too."""
    names = destinations.select("destination").distinct()
    moved = names.select(F.col("destination").alias("from"), tx.normalised(F.col("destination")).alias("to")).where("`from` <> `to`")
    return moved.join(names, F.col("to") == F.col("destination"), "left_semi")


def status(pages: DataFrame) -> DataFrame:
    """Flags and class of a page (title, redirect, ns, source)."""
    flags = {"is_disambiguation": tx.is_disambiguation(F.col("title"), F.col("source")), "is_list": tx.is_list(F.col("title")), "is_redirect": F.coalesce(F.col("redirect") != "", F.lit(False))}
    special = F.col("is_disambiguation") | F.col("is_list") | F.col("is_redirect")
    return pages.withColumns(flags).withColumn("status", F.when(special, "special").otherwise("normal"))


def first_rank(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


#: Bytes of a table that may be sent to every executor.
SMALL = 32 << 20


def is_small(df: DataFrame, *texts: str, most: int = SMALL) -> bool:
    """Whether ``df`` was measured to have ``most`` bytes at most, 64 a row and those of its text columns."""
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]
    got = df.agg(F.count("*"), *sizes).first()
    return 64 * got[0] + sum(got[1:]) <= most


def small(df: DataFrame, *texts: str, most: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it ``is_small``."""
    return F.broadcast(df) if is_small(df, *texts, most=most) else df
