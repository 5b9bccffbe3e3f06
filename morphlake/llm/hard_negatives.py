"""Hard negatives by Kronecker-packed products of whole-number vectors.

A component x stands as floor(256 x).  Vectors are gathered in blocks, and every block of anchors meets every block of
candidates.  There, candidates' components, biased so that none is negative, stand side by side in the fields of wide
integers: one multiplication by an anchor's component multiplies all of a word's fields, and the fields of the words' sum
are the exact products of the anchor with each candidate, once the biases are taken off.  Words of up to 53 bits are kept
in doubles, which hold such integers exactly, so that a matrix product adds them up; wider fields stand in one long
integer of Python's for each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import best_of_each, cut, meet, table

SCALE = 256
LARGEST = (1 << 23) - 1  # components are cut off here, at 32768 as they are given
WORD_BITS = 53  # of the whole numbers that a double holds exactly
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 3, 9  # tenths of the positive's score
ANCHORS = 512  # of a block
BLOCK_COMPONENTS, BLOCK_ROWS = 1 << 18, 4096  # of a block of candidates

_BLOCK = "n int, size long, ids binary, labels binary, lengths binary, components binary"
_NAMES = ("n", "size", "ids", "labels", "lengths", "components")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, components) of the rows that take part, components as whole numbers.

    A row with a null id, label or vector, or with a null or non-finite component, takes no part.
    """
    x = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    whole = lambda c: F.least(F.greatest(F.floor(SCALE * c.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, finite))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, whole).alias("components"))


def pack_field(values: np.ndarray, bits: int, fields: int) -> np.ndarray:
    """Rows of components (candidate, component) as words (component, word): ``fields`` neighbours side by side in each."""
    n, size = values.shape
    padded = np.zeros((-(-n // fields) * fields, size), dtype=np.int64)
    padded[:n] = values
    shifts = np.int64(1) << (np.int64(bits) * np.arange(fields))
    return (padded.reshape(-1, fields, size) * shifts[None, :, None]).sum(axis=1).T.astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a with those of b, both of whole numbers and equally long.

    b's components are packed; a's multiply them.  Both are biased by their least component.
    """
    size = a.shape[1]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bias_a, bias_b = int(a.min()), int(b.min())
    shifted_a, shifted_b = a - bias_a, b - bias_b
    bits = max(1, (size * int(shifted_a.max()) * int(shifted_b.max())).bit_length())
    fields = WORD_BITS // bits
    if fields:
        words = (shifted_a.astype(np.float64) @ pack_field(shifted_b, bits, fields)).astype(np.int64)
        parts = [words >> np.int64(bits * k) & np.int64((1 << bits) - 1) for k in range(fields)]
        raw = np.stack(parts, axis=2).reshape(len(a), -1)[:, : len(b)]
    else:  # one long integer for each component, with a field of eight bytes for each candidate
        long = [int.from_bytes(np.ascontiguousarray(shifted_b[:, k]).astype("<u8").tobytes(), "little") for k in range(size)]
        raw = np.empty((len(a), len(b)), dtype=np.int64)
        for i, row in enumerate(shifted_a.tolist()):
            total = sum(x * y for x, y in zip(row, long, strict=True))
            raw[i] = np.frombuffer(total.to_bytes(8 * len(b), "little"), dtype="<i8")
    return raw + bias_b * a.sum(axis=1)[:, None] + bias_a * b.sum(axis=1)[None, :] - size * bias_a * bias_b


def in_blocks(rows: DataFrame, most_rows: int, most_components: int) -> DataFrame:
    """Blocks of (id, label, components) with the number of their partition as ``g``; rows of a block stand by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, labels, lengths, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(ids, kind="stable")
            starts = np.cumsum(lengths) - lengths
            new = lengths[order]
            at = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new) + np.repeat(starts[order], new)
            blobs = [ids[order].tobytes(), labels[order].tobytes(), new.astype(np.int32).tobytes(), flat[at].astype(np.int32).tobytes()]
            columns = [pa.array([len(ids)], type=pa.int32()), pa.array([sum(map(len, blobs))], type=pa.int64()), *(pa.array([x], type=pa.binary()) for x in blobs), pa.array([group], type=pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "g"])

        for batch in batches:
            lists = batch.column(2)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            flat, ids, labels = lists.flatten().to_numpy(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            low = 0
            while low < len(batch):
                room = most_components - sum(len(x[3]) for x in held)
                high = min(low + most_rows - sum(len(x[0]) for x in held), int(np.searchsorted(ends, ends[low] + room, side="right")) - 1)
                if high <= low:
                    if held:
                        yield flush()
                        continue
                    high = low + 1
                held.append((ids[low:high], labels[low:high], np.diff(ends[low : high + 1]), flat[ends[low] : ends[high]]))
                low = high
        if held:
            yield flush()

    return rows.select("id", "label", "components").mapInArrow(run, f"{_BLOCK}, g int")


class Vectors:
    """A block of vectors, the shorter ones filled up with zeros."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str, length: int):
        of = lambda name, kind: np.frombuffer(batch.column(prefix + name)[i].as_buffer(), dtype=kind)
        self.ids, self.labels, lengths = of("ids", np.int64), of("labels", np.int64), of("lengths", np.int32).astype(np.int64)
        self.values = np.zeros((len(self.ids), length), dtype=np.int64)
        row = np.repeat(np.arange(len(self.ids)), lengths)
        self.values[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = of("components", np.int32)

    @staticmethod
    def both(batch: pa.RecordBatch, i: int) -> tuple[Vectors, Vectors]:
        """The anchors and the candidates of a pair of blocks."""
        length = max(int(np.frombuffer(batch.column(p + "lengths")[i].as_buffer(), dtype=np.int32).max(initial=0)) for p in ("a_", ""))
        return Vectors(batch, i, "a_", length), Vectors(batch, i, "", length)


def first_of_row(row: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores of each row, ties by smaller id; what agrees in both counts once."""
    order = np.lexsort((ids, -score, row))
    r, s, d = row[order], score[order], ids[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    order, r = order[new], r[new]
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return order[place < n]


def _pairs(blocks: DataFrame, anchors: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of candidates with blocks of anchors, whose columns are named a_*."""
    named = anchors.select(F.col("g").alias("a_g"), F.col("size").alias("a_size"), *[F.col(x).alias(f"a_{x}") for x in ("ids", "labels", "lengths", "components", *extra)])
    return meet(blocks.drop("g", "size", "n"), named, "a_g", "a_size")


def positives(blocks: DataFrame, anchors: DataFrame, n: int = POSITIVES) -> DataFrame:
    """(g, anchor, anchor_id, positive_id, positive_score): each anchor's n best rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, b = Vectors.both(batch, i)
                found = []
                for label in np.intersect1d(a.labels, b.labels):
                    mine, those = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
                    score = products(a.values[mine], b.values[those])
                    other = a.ids[mine][:, None] != b.ids[those][None, :]
                    if score.shape[1] > n:  # what is below a row's n-th best isn't among the first n different ones, but for equal rows
                        least = _nth_best(np.where(other, score, np.iinfo(np.int64).min), b.ids[those], n)
                        other &= score >= least[:, None]
                    row, col = np.nonzero(other)
                    kept = first_of_row(row, score[row, col], b.ids[those][col], n)
                    found.append((mine[row[kept]], b.ids[those][col[kept]], score[row[kept], col[kept]]))
                if found:
                    row, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    group = np.full(len(row), batch.column("a_g")[i].as_py(), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, row.astype(np.int32), a.ids[row], ids, score)], names=["g", "anchor", "anchor_id", "positive_id", "positive_score"])

    found = _pairs(blocks, anchors).mapInArrow(run, "g int, anchor int, anchor_id long, positive_id long, positive_score long")
    return best_of_each(found, ["g", "anchor"], [F.desc("positive_score"), "positive_id"], n, "_place").drop("_place")


def _nth_best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """For each row, a score that its n best different candidates reach.  Candidates of one id stand together and count once."""
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        score = np.maximum.reduceat(score, starts, axis=1)
    if score.shape[1] <= n:
        return np.full(len(score), np.iinfo(np.int64).min)
    return np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]


def negatives(blocks: DataFrame, anchors: DataFrame, n: int = NEGATIVES) -> DataFrame:
    """(g, anchor, anchor_id, positive_id, positive_score, negative_id, negative_score, rank).

    anchors has each anchor's positives too: how many (a_n_positives), their ids and scores.
    """
    names = ("g", "anchor", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, b = Vectors.both(batch, i)
                of = lambda name, kind: np.frombuffer(batch.column(f"a_{name}")[i].as_buffer(), dtype=kind)  # noqa: E731, B023
                counts, positive, reached = of("n_positives", np.int32).astype(np.int64), of("positives", np.int64), of("scores", np.int64)
                score, row = products(a.values, b.values), np.repeat(np.arange(len(counts)), counts)
                low, high = -(-LOW * reached // 10), HIGH * reached // 10
                # Candidates that any positive of the anchor may have, then those of each positive.
                least, most = np.full(len(a.ids), np.iinfo(np.int64).max), np.full(len(a.ids), np.iinfo(np.int64).min)
                np.minimum.at(least, row, low)
                np.maximum.at(most, row, high)
                at, col = np.nonzero((score >= least[:, None]) & (score <= most[:, None]) & (a.labels[:, None] != b.labels[None, :]))
                value = score[at, col]
                order = np.lexsort((b.ids[col], -value, at))
                at, col, value = at[order], col[order], value[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1]) | (value[1:] != value[:-1]) | (b.ids[col[1:]] != b.ids[col[:-1]])
                at, col, value = at[new], col[new], value[new]
                # A pair's candidates are a stretch of its anchor's, from the highest allowed score on.
                values, place = np.unique(value, return_inverse=True)
                width = len(values) + 1
                key = at * width + len(values) - place
                first = np.searchsorted(key, row * width + len(values) - (np.searchsorted(values, high, side="right") - 1))
                last = np.searchsorted(key, row * width + len(values) - np.searchsorted(values, low), side="right")
                size = np.clip(last - first, 0, n)
                k = np.repeat(np.arange(len(row)), size)
                x = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                if len(k):
                    group = np.full(len(k), batch.column("a_g")[i].as_py(), dtype=np.int32)
                    columns = (group, row[k].astype(np.int32), a.ids[row[k]], positive[k], reached[k], b.ids[col[x]], value[x])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))

    found = _pairs(blocks, anchors, ("n_positives", "positives", "scores")).mapInArrow(run, "g int, anchor int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return best_of_each(found, ["g", "anchor", "positive_id"], [F.desc("negative_score"), "negative_id"], n, "rank")


def with_positives(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks of anchors with what ``positives`` found: a block's positives are as many as POSITIVES allows, so they fit in a row."""
    packed = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("anchor", "positive_id", "positive_score"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[list[bytes]] = [[], [], []]
            for n, rows in zip(batch.column("n").to_pylist(), batch.column("found").to_pylist(), strict=True):
                rows = rows or []
                new[0].append(np.bincount([r["anchor"] for r in rows], minlength=n).astype(np.int32).tobytes())
                new[1].append(np.array([r["positive_id"] for r in rows], dtype=np.int64).tobytes())
                new[2].append(np.array([r["positive_score"] for r in rows], dtype=np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*_NAMES, "g")), *(pa.array(x, type=pa.binary()) for x in new)], names=[*_NAMES, "g", "n_positives", "positives", "scores"])

    return anchors.join(packed, "g", "left").select(*_NAMES, "g", "found").mapInArrow(run, f"{_BLOCK}, g int, n_positives binary, positives binary, scores binary")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, components).

    An anchor's positives are its n_positives best rows of its label with another id; the negatives of a pair are the
    n_negatives best rows of other labels whose score is from LOW to HIGH tenths of the positive's.  Higher scores come first,
    then smaller ids.  A shorter vector counts as filled up with zeros.  Candidates that agree in id and score count once, and
    so do repeated anchors; two anchors of one id that differ are mined each for itself.  No other row of the label, or no
    candidate in the range, gives no row; an empty table gives an empty result.  Components beyond 32768 count as that; scores
    are exact for up to 8192 components.
    """
    anchors = cut(rows.where(is_anchor).distinct())
    blocks = cut(in_blocks(rows, BLOCK_ROWS, BLOCK_COMPONENTS))
    # One block for each partition of anchors; as many rows in all, so that all but very long vectors fit.
    dealt = anchors.repartition(-(-anchors.count() // ANCHORS) or 1)
    queries = cut(renumbered(in_blocks(dealt, ANCHORS, BLOCK_COMPONENTS)))
    found = cut(positives(blocks, queries, n_positives))
    queries = cut(with_positives(queries, found))
    return negatives(blocks, queries, n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def renumbered(blocks: DataFrame) -> DataFrame:
    """The blocks with numbers 0, 1, ... as ``g``: a partition may have given several."""
    from morphlake.storage import numbered

    return numbered(blocks.withColumn("_key", F.md5("ids")), ["g", "_key"], "_no").withColumn("g", (F.col("_no") - 1).cast("int")).drop("_key", "_no")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_hard_negatives."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.pmod("id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.pmod("id", F.lit(100)) == 0)
