"""Labelled samples and logistic fits."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: A model is fitted on so many labelled documents at most: those with the smallest digests of their id.
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents outside the held-out fold.

    The chosen ids are few by that bound, so they are sent to all tasks and the documents aren't shuffled.
    """
    label = F.col(label_col).cast("int")
    chosen = (
        labels.where(label.isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD_OUT))
        .select(F.col(id_col).alias("_id"), label.alias("label"))
        .orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id", "label")
        .limit(limit)
    )
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "label")


def fit_logistic(examples: DataFrame, intercept: bool, ridge: float = 1e-4) -> tuple[list[float], float] | None:
    """Weights and intercept for (features array<double>, label 0 or 1); None where there aren't both labels."""
    data = examples.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")).persist()
    try:
        if data.select("label").distinct().count() < 2:
            return None
        model = LogisticRegression(fitIntercept=intercept, regParam=ridge, maxIter=100).fit(data)
        return [float(x) for x in model.coefficients], float(model.intercept)
    finally:
        data.unpersist()
