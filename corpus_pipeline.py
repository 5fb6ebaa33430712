"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestride.llm import lines, minhash, packing, suffixes, toxicity
from tapestride.llm.common import Scratch, documents, unused
from tapestride.llm.entry import tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, trained on labelled ones among them, scores 0.7 or more go.

    Null and empty texts score as texts without toxic tokens; ids are not looked at, so rows that
    repeat go or stay together; very long texts are scored whole. An empty table gives no rows.
    """
    return toxicity.reject(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines met before, exactly or but for an edit or two, go; every document stays.

    The line of the smallest id stays, there the uppermost. Null texts stay null; documents with
    a null id stay as they are; rows that repeat an id each keep their uppermost line. A column
    ``n_removed`` of the documents passes through, as other columns do.
    """
    (name,) = unused(docs, "n_removed")
    if name != "n_removed":
        docs = docs.withColumnRenamed("n_removed", name)
    cleaned = _measured(lines.deduplicate(docs).drop("n_removed"))
    return cleaned if name == "n_removed" else cleaned.withColumnRenamed(name, "n_removed")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Documents without id stay, and so do null and empty texts, which are like no other. Rows that
    repeat an id go or stay together. An empty table gives no rows; columns may have any name.
    """
    (gone,) = unused(docs, "gone")
    ids = minhash.near_duplicates(docs).where("doc_id is not null and not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur twice go, wherever they occur; every document stays.

    All occurrences go, so there are no ties; repeated rows lose their texts, null ids or not. Null
    texts stay null, those under 200 bytes whole. Columns may have any name.
    """
    return _measured(suffixes.deduplicate(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their sequence and place there.

    Null and empty texts are the end id alone; repeated rows are packed as often as they come, null
    ids stay null, texts over 1024 tokens are cut, never dropped. An empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path(), 1024, 2)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("best-fit packing", pack),
]

#: The stages before the last train a model, chain edit distances and hash windows of bytes;
#: no SQL gives their rows, so tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    held = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = held.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            held.drop(f"stage-{i - 1}")
    return docs
