"""A quality classifier by Bradley-Terry pairwise ranking.

A document has a score w.x over measures x of its whole text.  Labelled documents give preference pairs (label 1 over
label 0), and w minimises the logistic loss of the pairs' feature differences, so only the order matters.  The scores'
quantile at the share of label 0 is the threshold; scores are shifted so that it stands at 0.3.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from morphlake.storage import numbered
from .common import fold, table
from .learning import FOLDS, HELD_OUT, fit_logistic
from .textops import Block, blocks, first_of_each, shingles, word_hashes, words

CUT = 0.3
BINS = 1000
BROADCAST_EXAMPLES = 10_000
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "mark", "bar", "symbol", "wide")
_CLASS = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]], _CLASS[[ord(c) for c in "!?"]], _CLASS[[ord(c) for c in "|/\\_=<>"]] = 5, 6, 7
_CLASS[128:] = CLASSES.index("wide")


def measures(b: Block) -> np.ndarray:
    """One row of measures for each text of the block, each between about 0 and 4."""
    n = b.n
    size = np.diff(b.bounds)
    rows = np.repeat(np.arange(n), size)
    of_class = np.bincount(rows * len(CLASSES) + _CLASS[b.data], minlength=n * len(CLASSES)).reshape(n, -1)
    shares = of_class / np.maximum(size, 1)[:, None]
    w = words(b)
    counts = np.bincount(w.row, minlength=n)
    some = np.maximum(counts, 1)
    h = word_hashes(w)
    distinct = np.bincount(first_of_each(w.row, h)[0], minlength=n)
    repeats = np.bincount(w.row[1:][(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])], minlength=n) if len(h) else np.zeros(n)
    all_rows, all_shingles = shingles(w, n)
    every = np.maximum(np.bincount(all_rows, minlength=n), 1)
    fresh = np.bincount(first_of_each(all_rows, all_shingles)[0], minlength=n) / every
    length = np.bincount(w.row, weights=(w.end - w.start), minlength=n) / some
    ratio = distinct / some
    return np.column_stack(
        [
            *(np.sqrt(shares[:, k]) for k in range(len(CLASSES))),
            np.log1p(size) / 4,
            np.log1p(counts) / 4,
            np.minimum(length, 40) / 10,
            ratio,
            1 - np.minimum(1, ratio * np.sqrt(some) / 8),
            np.sqrt(repeats / some),
            1 - fresh,
            (1 - fresh) ** 0.5,
            np.minimum(1, of_class[:, 4] / some * 4),
            shares[:, 1] / np.maximum(shares[:, 0] + shares[:, 1] + shares[:, 9], 1e-9),
        ]
    ).astype(np.float64)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, features) of each row."""
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, features array<double>"
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n).cast(id_type), pa.array(list(measures(b)), type=pa.list_(pa.float64()))], names=["_id", "features"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def training_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(features, label, deal) of all labelled documents outside the held-out fold; deal is an order without meaning.

    Documents are measured before they meet their labels, so that no text is shuffled.
    """
    learnt = F.col(id_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD_OUT)
    label = F.col(label_col).cast("int")
    chosen = labels.where(label.isin(0, 1) & learnt).select(F.col(id_col).alias("_id"), label.alias("label"))
    return measured(docs.where(learnt), id_col, text_col).join(chosen, "_id").select("features", "label", F.xxhash64("_id", "features").alias("deal"))


def preference_pairs(examples: DataFrame) -> DataFrame:
    """(features, label): differences of a preferred and a rejected example, every other one turned round.

    Each example is in one pair at least: the k-th of the more frequent label meets the k-th of the other, counted in a
    circle.
    """
    n1, n0 = examples.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    placed = numbered(examples.select("features", "label", "deal"), ["label", "deal"], "k").withColumn("k", F.col("k") - F.when(F.col("label") == 1, n0 + 1).otherwise(1))
    many, few = (1, 0) if n1 >= n0 else (0, 1)
    one = placed.where(F.col("label") == many).select("k", F.pmod("k", F.lit(max(1, min(n0, n1)))).alias("j"), F.col("features").alias("x"))
    other = placed.where(F.col("label") == few).select(F.col("k").alias("j"), F.col("features").alias("y"))
    # Where the other label is that rare, each of its examples meets many.
    pairs = one.join(F.broadcast(other) if min(n0, n1) <= BROADCAST_EXAMPLES else other, "j")
    won = F.pmod("k", F.lit(2)) == 0
    return pairs.select(F.zip_with("x", "y", lambda a, b: F.when(won == F.lit(many == 1), a - b).otherwise(b - a)).alias("features"), won.cast("int").alias("label"))


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column, between two values as ``percentile`` has it; None of an empty table.

    The range that holds it is cut into BINS until all its values are equal, so that no task or driver gets all values.
    """
    value = F.col(column)
    n, low, high = values.agg(F.count(value), F.min(value), F.max(value)).first()
    place = share * ((n or 1) - 1)
    rank = before = int(place)
    while n and low < high:
        at = F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1))
        for _, count, low, high in sorted(values.where(value.between(low, high)).groupBy(at.alias("bin")).agg(F.count(value), F.min(value), F.max(value)).collect()):
            if before < count:
                break
            before -= count
    if not n or place == rank:
        return low
    upto, above = values.agg(F.count_if(value <= low), F.min(F.when(value > low, value))).first()
    return low if upto > rank + 1 else (rank + 1 - place) * low + (place - rank) * above


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[float], float]:
    """Weights and the shift of the scores.  Without examples of both labels all scores are the threshold's."""
    examples = training_examples(docs, labels, id_col, text_col, label_col).persist()
    try:
        fitted = fit_logistic(preference_pairs(examples), intercept=False)
        if fitted is None:
            return [], math.log(CUT / (1 - CUT))
        weights = fitted[0]
        score = F.aggregate(F.zip_with("features", F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        scored = examples.select(score.alias("score"), "label").persist()
        try:
            share = scored.agg(F.avg(1 - F.col("label"))).first()[0]
            return weights, math.log(CUT / (1 - CUT)) - quantile(scored, "score", share)
        finally:
            scored.unpersist()
    finally:
        examples.unpersist()


def score(docs: DataFrame, model: tuple[list[float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: score is between 0 and 1, predicted is 1 from 0.3 on.

    Null and empty texts are scored like any other text, by their measures; equal texts have equal scores.  Rows with a
    null id and repeated rows are scored too; an empty table gives an empty result; other columns are ignored.
    """
    weights, shift = model
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                raw = (measures(b) * np.array(weights)).sum(axis=1) if weights else np.zeros(b.n)
                p = 1 / (1 + np.exp(-np.clip(raw + shift, -500, 500)))
                p = p if weights else np.full(b.n, CUT)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n).cast(id_type), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts as good (rows with a null id are judged by their text too)."""
    weights, shift = fit(docs, labels)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(at)):
                raw = (measures(b) * np.array(weights)).sum(axis=1) if weights else np.zeros(b.n)
                good = 1 / (1 + np.exp(-np.clip(raw + shift, -500, 500))) >= CUT if weights else np.ones(b.n, dtype=bool)
                yield batch.slice(b.first, b.n).filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_quality."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
