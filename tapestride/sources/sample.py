"""A dump in XML made from the driver's pages, for queries that start from markup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import ANCHOR


def escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markup(pages: DataFrame, main: bool = False) -> DataFrame:
    """(title, ns, redirect, source): anchors become wiki links; a url with a query redirects to the one without.

    Every fifth page is of namespace 1, or none if ``main``.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(1))
    links = F.transform(found, lambda a: F.regexp_replace(a, '<a href="/?([^"]*)">([^<]*)</a>', "[[$1|$2]]"))
    url = F.coalesce("url", F.lit(""))
    return pages.select(url.alias("title"), (F.lit(0) if main else F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("ns"), F.when(F.contains(url, F.lit("?")), F.split_part(url, F.lit("?"), F.lit(1))).alias("redirect"), F.concat_ws(" ", F.lit("'''page'''"), F.array_join(links, " ")).alias("source"))


def write_dump(pages: DataFrame, at: str, main: bool = False) -> None:
    redirect = F.when(F.col("redirect").isNotNull(), F.concat(F.lit('<redirect title="'), escaped("redirect"), F.lit('" />'))).otherwise(F.lit(""))
    page = F.concat(F.lit("<page><title>"), escaped("title"), F.lit("</title><ns>"), F.col("ns").cast("string"), F.lit("</ns>"), redirect, F.lit('<revision><text xml:space="preserve">'), escaped("source"), F.lit("</text></revision></page>"))
    markup(pages, main).select(page.alias("value")).mapInArrow(_rooted, "value string").write.mode("overwrite").text(at)


def _rooted(batches):
    """Puts one root around the pages of a file."""
    yield pa.RecordBatch.from_arrays([pa.array(["<mediawiki>"])], ["value"])
    yield from batches
    yield pa.RecordBatch.from_arrays([pa.array(["</mediawiki>"])], ["value"])
