"""Cost-sensitive classification of candidates."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``features``; a null column gives 0 and a mark beside it, as trees have no branch for missing values."""
    marked = df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in columns} | {f"{c}__value": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    names = [x for c in columns for x in (f"{c}__value", f"{c}__missing")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(marked).drop(*names)


def train_forest(train: DataFrame, columns: list[str], label: str, trees: int = 20, seed: int = 1):
    """A random forest over the columns; see ``save`` and ``load``."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=6, seed=seed).fit(assemble(train, columns).withColumn(label, F.col(label).cast("double")))


def expected_cost(df: DataFrame, model, columns: list[str], false_negative: float = 1.0, false_positive: float = 1.0) -> DataFrame:
    """Adds ``p1`` and ``predicted``: 1 where that has the smaller expected cost."""
    scored = model.transform(assemble(df, columns)).withColumn("p1", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("predicted", (F.col("p1") > false_positive / (false_positive + false_negative)).cast("int"))


def save(model, at: str) -> None:
    model.write().overwrite().save(at)


def load(at: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(at)
