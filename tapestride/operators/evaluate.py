"""Evaluation: threshold sweeps, precision and recall, ROC points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ["n_filtered", "n_actual", "n_potential", "tp", "fp", "subset_fp", "fn"]


def sweep(hits: DataFrame, actual: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per document and threshold the counts of a sweep over hit probabilities.

    ``hits`` (doc_id, surface, prob) and ``actual`` (doc_id, surface) are distinct. Positives are
    hits with prob >= threshold; ``subset_fp`` are false ones that are a run of tokens of an
    actual surface; ``fn`` counts only actual surfaces that some hit matches without threshold.
    Documents with hits or actual surfaces appear. Each surface of a document becomes one row, and
    each run of tokens of an actual surface meets it by equality; the thresholds are columns until
    a document's rows are added up.
    """
    none = F.lit(None).cast("double")
    words = F.split("surface", " ")
    runs = actual.select("doc_id", words.alias("w")).where("w is not null").select("doc_id", "w", F.posexplode(F.sequence(F.lit(1), F.size("w"))).alias("i", "n"))
    runs = runs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("surface"))
    mark = lambda df, prob, kind: df.select("doc_id", "surface", prob.alias("prob"), *[F.lit(int(k == kind)).alias(k) for k in ("is_hit", "n_same", "n_inside")])
    rows = mark(hits, F.col("prob").cast("double"), "is_hit").unionByName(mark(actual, none, "n_same")).unionByName(mark(runs, none, "n_inside"))
    rows = rows.groupBy("doc_id", "surface").agg(F.max("prob").alias("prob"), F.max("is_hit").alias("is_hit"), F.sum("n_same").alias("n_same"), F.max("n_inside").alias("n_inside"))
    rows = rows.where("is_hit + n_same > 0")
    # Null names equal nothing.
    named = F.col("doc_id").isNotNull() & F.col("surface").isNotNull()
    hit, true, inside = F.col("prob").isNotNull(), named & (F.col("n_same") > 0), named & (F.col("n_inside") > 0)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = [F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n_same")).otherwise(0)).alias("n_actual"), n(hit & true).alias("n_potential")]
    for k, t in enumerate(thresholds):
        pos = F.coalesce(F.col("prob") >= float(t), F.lit(False))
        sums += [n(pos).alias(f"pos{k}"), n(pos & true).alias(f"tp{k}"), n(pos & ~true & inside).alias(f"sub{k}")]
    totals = rows.groupBy("doc_id").agg(*sums)
    per = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"pos{k}").alias("n_filtered"), "n_actual", "n_potential", F.col(f"tp{k}").alias("tp"), (F.col(f"pos{k}") - F.col(f"tp{k}")).alias("fp"), F.col(f"sub{k}").alias("subset_fp"), (F.col("n_potential") - F.col(f"tp{k}")).alias("fn")) for k, t in enumerate(thresholds)]
    return totals.select("doc_id", F.inline(F.array(*per)))


def ratio(a: Column, b: Column) -> Column:
    """Null, not an error, where there is nothing to divide by."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def summary(per_document: DataFrame) -> DataFrame:
    """Counters added up per threshold, with the share of hits kept, precision, recall and F1.

    The totals are a row per threshold, so the window over all of them stays that small.
    """
    total = per_document.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    out = total.withColumn("most", F.max("n_filtered").over(Window.partitionBy(F.lit(1))))
    p, p2, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fp") - F.col("subset_fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("threshold", *COUNTERS, ratio(F.col("n_filtered"), F.col("most")).alias("filter_ratio"), p.alias("precision"), p2.alias("precision_without_subsets"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def roc(scored: DataFrame, thresholds: list[int]) -> DataFrame:
    """tp, fp, tn, fn, tpr and fpr per threshold from rows (value, label boolean); positive at value >= threshold."""
    rows = scored.select("value", "label", F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds])).alias("threshold"))
    pos, true = F.col("value") >= F.col("threshold"), F.col("label")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy("threshold").agg(n(pos & true).alias("tp"), n(pos & ~true).alias("fp"), n(~pos & ~true).alias("tn"), n(~pos & true).alias("fn"))
    return out.withColumns({"tpr": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def prf(found: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row of precision, recall and F1 of two sets of keys; precision is -1 where nothing was found."""
    both = found.select(keys).distinct().withColumn("f", F.lit(1)).join(actual.select(keys).distinct().withColumn("a", F.lit(1)), keys, "full")
    return _prf(both)


def prf_of_marks(rows: DataFrame, found: Column, actual: Column, keys: list[str]) -> DataFrame:
    """As ``prf`` of two sets that are marked in the same rows, which are read once."""
    mark = lambda c: F.max(F.when(c, 1))
    return _prf(rows.where(found | actual).groupBy(*keys).agg(mark(found).alias("f"), mark(actual).alias("a")))


def _prf(both: DataFrame) -> DataFrame:
    one = both.agg(F.count("f").alias("n_found"), F.count("a").alias("n_actual"), F.count(F.col("f") + F.col("a")).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("n_found")), ratio(F.col("tp"), F.col("n_actual"))
    return one.select("n_found", "n_actual", "tp", F.coalesce(p, F.lit(-1.0)).alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
