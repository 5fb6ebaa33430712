"""Candidates of mentions and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import small

GROUPS = {"nn": ["NN", "NNS"], "nnp": ["NNP", "NNPS"], "jj": ["JJ", "JJR", "JJS"], "vb": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"], "cd": ["CD"], "sym": ["SYM"], "w": ["WDT", "WP", "WP$", "WRB"]}


def candidates(mentions: DataFrame, probs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row per mention and destination of its surface with a probability above the threshold.

    The destinations are measured, so they should be a written table, and sent to all executors if
    they are small: a frequent surface is then no single task's join.
    """
    some = probs.where(F.col("prob") > threshold).select(F.col("surface").alias("surface_repr"), F.col("destination").alias("candidate"), F.col("prob").alias("surface_prob"))
    return mentions.join(small(some, "surface_repr"), "surface_repr")


def grouped_candidates(mentions: DataFrame, probs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """As ``candidates``, but one row per mention, with an array ``candidates`` of (candidate, surface_prob)."""
    some = probs.where(F.col("prob") > threshold).groupBy(F.col("surface").alias("surface_repr"))
    some = some.agg(F.collect_list(F.struct(F.col("destination").alias("candidate"), F.col("prob").alias("surface_prob"))).alias("candidates"))
    return mentions.join(F.broadcast(some), "surface_repr")


def second_order(df: DataFrame, value: str, prefix: str, group: str = "id") -> DataFrame:
    """Adds rank (dense, from 1, largest first), distance to the top and to the next lower value (null if none).

    A group holds one mention's candidates. The next lower value is found among distinct values,
    so ties share it.
    """
    w = Window.partitionBy(group)
    ordered = w.orderBy(F.desc(value))
    out = df.withColumns({f"{prefix}_rank": F.dense_rank().over(ordered).cast("double"), f"{prefix}_delta_top": F.max(value).over(w) - F.col(value)})
    # Of equal values all but the last see themselves as next; the last of them sees the lower one.
    after = F.lead(value).over(ordered)
    out = out.withColumn("__next", F.when(after < F.col(value), after))
    share = F.max("__next").over(Window.partitionBy(group, value))
    return out.withColumn(f"{prefix}_delta_succ", F.col(value) - share).drop("__next")


def second_order_within(df: DataFrame, candidates: str, values: dict[str, str]) -> DataFrame:
    """``second_order`` of a mention's array of candidates, then a row per candidate; ``values`` has the prefix of each value."""
    ordered = {f"__{p}": F.sort_array(F.array_distinct(F.col(f"{candidates}.{v}")), asc=False) for v, p in values.items()}
    rest = [c for c in df.columns if c != candidates]
    rows = df.withColumns(ordered).select(*rest, *ordered, F.inline(candidates))
    for v, p in values.items():
        all_, rank = F.col(f"__{p}"), F.array_position(f"__{p}", F.col(v))
        rows = rows.withColumns({f"{p}_rank": rank.cast("double"), f"{p}_delta_top": F.get(all_, F.lit(0)) - F.col(v), f"{p}_delta_succ": F.col(v) - F.get(all_, rank.cast("int"))})
    return rows.drop(*ordered)


def pos_flags(tags: Column) -> list[Column]:
    """Whether any tag of the mention belongs to each group, as 0 or 1."""
    return [F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, own))), F.lit(False)).cast("double").alias(f"pos_{name}") for name, own in GROUPS.items()]


def noun(tags: Column, start: Column, length: Column) -> Column:
    """Whether a tag in the run starts with N."""
    return F.exists(F.slice(tags, (start + 1).cast("int"), length.cast("int")), lambda t: t.startswith("N"))


def training_rows(rows: DataFrame, linked: DataFrame, entire_group: bool = False) -> DataFrame:
    """Leaves out rows of dictionary hits whose candidate the same page links to.

    ``rows`` has id, kind ("hit" or "link"), source, candidate; ``linked`` has source,
    destination. ``entire_group`` leaves out all rows of such a hit; links always stay.
    """
    marks = linked.select("source", F.col("destination").alias("candidate")).distinct().withColumn("__linked", F.lit(True))
    marked = rows.join(marks, ["source", "candidate"], "left")
    bad = F.col("kind").eqNullSafe("hit") & F.col("__linked").isNotNull()
    if entire_group:
        bad = F.col("kind").eqNullSafe("hit") & F.col("id").isNotNull() & F.max(bad).over(Window.partitionBy("id"))
    return marked.withColumn("__bad", bad).where("kind in ('hit', 'link') and not __bad").select(rows.columns)


def decisions(rows: DataFrame, positive: Column, group: str = "id") -> DataFrame:
    """SEED where exactly one candidate of a mention is positive, CANDIDATE for all positives of others."""
    n = F.sum(F.when(positive, 1).otherwise(0)).over(Window.partitionBy(group))
    return rows.withColumn("__n", n).where(positive).withColumn("node_type", F.when(F.col("__n") == 1, "SEED").otherwise("CANDIDATE")).drop("__n")
