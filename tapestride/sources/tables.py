"""Readers and sinks of derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the tables a run derives, under its output folder.
CATALOGUE = ["wiki-pages", "all-links", "redirects", "surface-document-counts", "surface-probs", "context-link-probs", "plain-texts", "language-models", "document-word-counts", "trie-hits", "entire-text-surfaces", "surface-link-probs", "surface-evaluation", "training-data", "classification", "neighbours", "random-walk-results"]
EVALUATION = "threshold double, n_filtered long, n_actual long, n_potential long, tp long, fp long, subset_fp long, fn long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def path(folder: str, name: str) -> str:
    if name not in CATALOGUE:
        raise KeyError(name)
    return f"{folder}/{name}"


def write_tsv(df: DataFrame, at: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(at)


def read_tsv(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """Rows with as many columns as the schema; others are dropped, as are values of another type."""
    return spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema(schema).csv(at)


def read_counts(spark: SparkSession, at: str) -> DataFrame:
    """(surface_repr, surface, n_docs) of a tab-separated file; rows whose count is no number go."""
    raw = spark.read.option("sep", "\t").schema("surface_repr string, surface string, n string").csv(at)
    return raw.select("surface_repr", "surface", F.expr("try_cast(n as bigint)").alias("n_docs")).where("n_docs is not null")


def read_evaluations(spark: SparkSession, at: str) -> DataFrame:
    """Evaluation rows of all tab-separated files below a folder."""
    return spark.read.option("sep", "\t").option("recursiveFileLookup", True).schema(EVALUATION).csv(at)


def write_text(df: DataFrame, at: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(at)


def cached(spark: SparkSession, at: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path; it is made and written first if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
