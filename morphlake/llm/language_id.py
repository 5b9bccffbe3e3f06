"""Language identification by the nearest of several centroids per language.

A text is the vector of its n-grams' TF-IDF weights, of length 1; n-grams are runs of one to three bytes of the text in lower
case, with blanks for all ASCII characters but letters, and fall into a fixed number of buckets by hash.  Document
frequencies come from all training documents.  Each language's vectors are clustered by spherical k-means over a bounded
sample, so that a language of several kinds of text has a centroid for each.  A text gets the language of the centroid of
the highest cosine; where that is below what nearly all of the centroid's own sample reaches, the prediction is not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import best_of_each, cut, fold, table
from .textops import Block, blocks

FOLDS, HELD_OUT = 3, 1
BUCKETS = 4096
ORDERS = (1, 2, 3)
SAMPLE = 1000  # training documents of each language that the centroids are fitted on: those with the smallest digests of their id
CENTROIDS, ROUNDS = 4, 6
LANGUAGES = 1000  # the most frequent so many are learned
REJECTED = 0.01  # of a centroid's sample that lies further away than texts which are accepted
UNKNOWN = "und"
ROWS = 512  # texts whose vectors are held at once
BROADCAST_IDS = 100_000

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123], _LETTER[128:] = np.arange(97, 123), np.arange(128, 256)


def gram_counts(b: Block) -> np.ndarray:
    """How often each text of a small block has n-grams of each bucket; texts are in lower case."""
    data, row = _LETTER[b.data], np.repeat(np.arange(b.n), np.diff(b.bounds))
    blank = data == 32
    kept = ~blank
    kept[1:] |= ~blank[:-1] | (row[1:] != row[:-1])
    data, row = data[kept].astype(np.uint32), row[kept]
    counts = np.zeros(b.n * BUCKETS, dtype=np.int64)
    for k in ORDERS:
        n = len(data) - k + 1
        if n <= 0:
            break
        gram = np.full(n, k, dtype=np.uint32)
        for j in range(k):
            gram = gram << np.uint32(8) | data[j : j + n]
        whole = row[:n] == row[k - 1 :]
        bucket = gram * np.uint32(2654435761) >> np.uint32(20)
        counts += np.bincount((row[:n] * BUCKETS + bucket)[whole], minlength=len(counts))
    return counts.reshape(b.n, BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1; texts without n-grams have zeros."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # the cosine from which a centroid accepts a text
    idf: np.ndarray


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """The buckets' weights by all texts of the column ``text``: each task sends one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            for b in blocks(batch.column(0)):
                for part in b.parts(ROWS):
                    df[:BUCKETS] += (gram_counts(part) > 0).sum(axis=0)
                    n += part.n
        df[BUCKETS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(df)], names=["bucket", "docs"])

    sums = texts.select("text").mapInArrow(run, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in sums:
        df[r.bucket] = r.docs
    return (np.log((df[BUCKETS] + 1) / (df[:BUCKETS] + 1)) + 1).astype(np.float32)


def sample_vectors(known: DataFrame, idf: np.ndarray, n: int, sizes: dict[str, int]) -> DataFrame:
    """(lang, buckets, values): sparse vectors of n texts of each language at most, from (id, lang, text).

    Of a language of many texts only ids with small digests are ranked, some four times as many as are wanted, so that no
    task gets more of them than that.
    """
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, (4 * n + 100) / size))]), F.col("lang"))
    few = known.select("id", "lang").where(F.col("id").isNotNull() & (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") <= share * float(1 << 32)))
    chosen = cut(best_of_each(few, ["lang"], [digest, "id"], n, "_place").select("id", "lang"))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                for part in b.parts(ROWS):
                    x = vectors(gram_counts(part), idf)
                    at = [np.flatnonzero(v) for v in x]
                    sparse = [pa.array([k.astype(np.uint16).tobytes() for k in at], type=pa.binary()), pa.array([v[k].tobytes() for v, k in zip(x, at, strict=True)], type=pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), *sparse], names=["lang", "buckets", "values"])

    found = known.join(chosen, ["id", "lang"], "left_semi").select("lang", "text").mapInArrow(run, "lang string, buckets binary, values binary")
    return best_of_each(found, ["lang"], [F.md5("values"), "buckets"], n, "place")  # rows that share an id don't make it larger


def _dense(buckets: pa.Array, values: pa.Array) -> np.ndarray:
    x = np.zeros((len(buckets), BUCKETS), dtype=np.float32)
    for i, (k, v) in enumerate(zip(buckets, values, strict=True)):
        x[i, np.frombuffer(k.as_buffer(), dtype=np.uint16)] = np.frombuffer(v.as_buffer(), dtype=np.float32)
    return x


def _of_language(model: Model) -> dict[str, np.ndarray]:
    return {lang: np.array([i for i, x in enumerate(model.languages) if x == lang]) for lang in dict.fromkeys(model.languages)}


def _assigned(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, nearest centroid of their language, cosine)."""
    own = _of_language(model)
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            some = batch.slice(low, ROWS)
            x = _dense(some.column("buckets"), some.column("values"))
            cosine = x @ model.centroids.T
            nearest = np.zeros(len(x), dtype=np.int64)
            for i, lang in enumerate(some.column("lang").to_pylist()):
                nearest[i] = own[lang][np.argmax(cosine[i, own[lang]])]
            yield x, nearest, cosine[np.arange(len(x)), nearest]


def cluster(sample: DataFrame, model: Model) -> Model:
    """The model after a round of k-means: tasks add up the vectors that are nearest to each centroid, and the sums are added by centroid."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x, nearest, _ in _assigned(batches, model):
            for k in np.unique(nearest).tolist():
                total[k] = total.get(k, 0) + x[nearest == k].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([v.tobytes() for v in total.values()], type=pa.binary())], names=["centroid", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.float64) for c in group.column("sums").chunks for x in c)
        return pa.table({"centroid": group.column("centroid")[:1], "sums": pa.array([total.tobytes()], type=pa.binary())})

    schema = "centroid int, sums binary"
    centroids = model.centroids.copy()
    for r in sample.mapInArrow(sums, schema).groupBy("centroid").applyInArrow(add, schema).collect():
        total = np.frombuffer(r.sums, dtype=np.float64)
        centroids[r.centroid] = total / max(np.sqrt((total * total).sum()), 1e-12)
    return Model(model.languages, centroids, model.least, model.idf)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE, n_centroids: int = CENTROIDS) -> Model:
    """A model of the languages of docs; rows without a language or a letter teach nothing.

    The driver holds the centroids and one weight for each bucket; it gets at most LANGUAGES x n_centroids vectors.
    """
    text = F.col(text_col)
    known = docs.where(F.col(lang_col).isNotNull() & F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.lower(text).alias("text"))
    learned = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not learned:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros(0), np.ones(BUCKETS, dtype=np.float32))
    known = known.where(F.col("lang").isin(list(learned))) if len(learned) == LANGUAGES else known
    idf = inverse_frequencies(known)
    sample = cut(sample_vectors(known, idf, per_language, learned))
    first = sample.where(F.col("place") <= n_centroids).orderBy("lang", "place").collect()
    start = _dense(pa.array([bytes(r.buckets) for r in first], type=pa.binary()), pa.array([bytes(r["values"]) for r in first], type=pa.binary()))
    model = Model([r.lang for r in first], start, np.zeros(len(first)), idf)
    for _ in range(ROUNDS):
        model = cluster(sample, model)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nearest, cosine in _assigned(batches, model):
            yield pa.RecordBatch.from_arrays([pa.array(nearest), pa.array(cosine.astype(np.float64))], names=["centroid", "cosine"])

    for r in sample.mapInArrow(distances, "centroid long, cosine double").groupBy("centroid").agg(F.percentile("cosine", F.lit(REJECTED)).alias("least")).collect():
        model.least[r.centroid] = r.least
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row.

    score is the cosine to the nearest centroid.  A text that is null or has no letter gets ``und`` and 0, and so does every
    text where the model has no language.  accepted tells whether the text is as near as nearly all of the centroid's own
    sample; lang_pred is the nearest language all the same.  Equal texts have equal results; texts are read whole; repeated
    rows and null ids are predicted like others; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            has_letter = batch.column(2).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                for part in b.parts(ROWS):
                    cosine = vectors(gram_counts(part), model.idf) @ model.centroids.T
                    known = has_letter[part.first : part.first + part.n] & bool(model.languages)
                    best = np.where(known, cosine.argmax(axis=1), len(model.languages)) if model.languages else np.zeros(part.n, dtype=np.int64)
                    score = np.where(known, np.clip(np.append(cosine, np.zeros((part.n, 1), dtype=np.float32), axis=1)[np.arange(part.n), best], 0, 1), 0.0).astype(np.float64)
                    accepted = known & (score >= np.append(model.least, 2.0)[best])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n).cast(id_type), pa.array(names[best], type=pa.string()), pa.array(score), pa.array(accepted)], names=[id_col, "lang_pred", "score", "accepted"])

    text = F.col(text_col)
    asked = docs.select(F.col(id_col), F.lower(text).alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return asked.mapInArrow(run, f"{id_col} {kind.simpleString()}, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_language_id."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return predict(docs, model).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
