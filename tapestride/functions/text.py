"""Text as column expressions: tokens, surface forms, predicates on pages, link cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of letters of any script.
LETTERS = r"\p{L}+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, in order; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({LETTERS})"), F.lit(1))


def normalised(text: Column) -> Column:
    """The letters alone, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""))


def without_punctuation(words: Column) -> Column:
    """Tokens that do not consist of ASCII punctuation only."""
    return F.filter(words, lambda w: ~F.regexp_like(w, F.lit(r"^\p{Punct}+$")))


def surface_repr(words: Column) -> Column:
    """Unstemmed tokens joined by a blank, the form in which mentions meet the dictionary."""
    return F.array_join(without_punctuation(words), " ")


def is_list(title: Column) -> Column:
    return title.startswith("List of") | title.startswith("Lists of")


def is_disambiguation(title: Column, source: Column) -> Column:
    """By the title, or by a disambiguation template that does not merely ask for one."""
    found = F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"(\{\{disambiguation.*?\}\})"), F.lit(1))
    return title.contains("(disambiguation)") | F.exists(found, lambda m: ~F.contains(m, F.lit("disambiguation needed")))


def contains_slice(tokens_of: Column, part: Column) -> Column:
    """Whether a blank-joined surface is a run of whole tokens of another one."""
    return F.contains(F.concat(F.lit(" "), tokens_of, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def context(words: Column, start: Column, spread: int = 25) -> Column:
    """Exactly ``2 * spread + 1`` tokens around a position, shifted at the ends; null if there are fewer."""
    size = 2 * spread + 1
    first = F.least(F.greatest(start - spread, F.lit(0)), F.size(words) - size)
    return F.when(F.size(words) >= size, F.slice(words, (first + 1).cast("int"), F.lit(size)))


def stable_id(text: Column) -> Column:
    """A non-negative id of a string, ten digits."""
    return F.lpad(F.abs(F.xxhash64(text) % F.lit(10_000_000_000)).cast("string"), 10, "0")


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash of UTF-16 units that JVM strings have, as a long."""
    return F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("int").cast("long")


def in_bucket(text: Column, buckets: int, bucket: int) -> Column:
    """Hash sampling of titles; the absolute value is taken in 64 bits, so no title is left out."""
    return F.abs(string_hash(text)) % buckets == bucket


_DROPPED = r"^:?(Image|File|Category):"


def clean_links(links: DataFrame) -> DataFrame:
    """Cleaned ``surface`` and ``destination`` of internal links; rows that are none go.

    In this order: media and category links go; an empty surface takes the destination; an
    anchor goes (a surface that equalled the destination follows); white space and quote
    pairs around a surface go, line breaks become blanks; ``http://`` destinations go; the
    destination starts upper-case; rows without surface go. Nulls count as empty.
    """
    d, s = F.trim(F.coalesce("destination", F.lit(""))), F.coalesce("surface", F.lit(""))
    out = links.withColumns({"destination": d, "surface": s}).where(~F.regexp_like("destination", F.lit(_DROPPED)))
    out = out.withColumn("surface", F.when(F.trim("surface") == "", F.col("destination")).otherwise(F.col("surface")))
    at = F.instr("destination", "#")
    bare = F.when(at > 1, F.substring("destination", F.lit(1), at - 1)).otherwise(F.col("destination"))
    out = out.withColumn("__bare", bare).withColumn("surface", F.when(F.col("surface") == F.col("destination"), F.col("__bare")).otherwise(F.col("surface")))
    out = out.withColumn("destination", F.col("__bare")).drop("__bare")
    surface = F.trim(F.regexp_replace("surface", r"[\r\n]+", " "))
    for _ in range(3):
        surface = F.trim(F.regexp_replace(surface, r"^(?:''+|\"|')(.+?)(?:''+|\"|')$", "$1"))
    quoted = F.regexp_like("surface", F.lit(r"^\s*(''|\"[^\"]*\"\s*$|'[^']*'\s*$)"))
    out = out.withColumn("surface", F.when(quoted, surface).otherwise(F.trim(F.regexp_replace("surface", r"[\r\n]+", " "))))
    out = out.where(~F.col("destination").startswith("http://"))
    head = F.substring("destination", 1, 1)
    upper = F.concat(F.when(F.length(F.upper(head)) == 1, F.upper(head)).otherwise(head), F.expr("substring(destination, 2)"))
    return out.withColumn("destination", upper).where(F.regexp_like("surface", F.lit(r"[\p{L}\p{N}]")))
