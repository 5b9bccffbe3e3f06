"""Ranked lexical search by presence masks over an inverted index.

The index is a table of blocks of documents: a block has, for each of its terms by hash, the places of the documents that
hold it and how often they do.  Each block of items meets each block of documents.  There an item's terms are bitmaps over
the block's documents; read across, the bits of a document are its mask, the set of the item's terms that it holds, and
documents are grouped by mask.  A mask's maximum is what its documents could score at best: the sum of its terms' weights
times their greatest impacts in the block.  Masks are evaluated by descending maximum, and the search of the block ends
when no mask left can reach the last of the best documents so far, be they of this block or of earlier ones of the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.storage import numbered

from .common import cut, meet, table
from .textops import NO_TERM, blocks, word_hashes, words

FIRST = 10
BASE, LENGTH = 25, 75  # hundredths of a document's m: fixed, and by its length
INDEX_BYTES, INDEX_DOCS = 8 << 20, 1 << 14  # of the texts of an index block
ITEMS = 256  # of a block
CELLS = 1 << 24  # of an item's terms x documents at once
STEP = 128  # documents evaluated at first; twice as many each time
BROADCAST_TERMS = 1_000_000

_INDEX = "n_docs long, n_tokens long, ids binary, known binary, lengths binary, terms binary, starts binary, places binary, often binary, often_bytes int"


def term_counts(b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, how often) of a block's texts, sorted by term and row, and how many terms each text has."""
    w = words(b, NO_TERM)
    h = word_hashes(w)
    order = np.lexsort((w.row, h))
    h, row = h[order], w.row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h))), np.bincount(w.row, minlength=b.n)


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index blocks of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, lengths, found, n_docs, n_bytes = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            term, place, often = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(term, kind="stable")  # each text block's are sorted already, and stand by place
            term, place, often = term[order], place[order], often[order]
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, dtype=np.int64)
            kind = np.min_scalar_type(int(often.max(initial=0)))
            blobs = [np.concatenate(ids), np.concatenate(known), n, term[starts], np.append(starts, len(term)).astype(np.uint32), place.astype(np.uint16), often.astype(kind)]
            columns = [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), *(pa.array([x.tobytes()], type=pa.binary()) for x in blobs), pa.array([kind.itemsize], type=pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _INDEX.split(", ")])

        for batch in batches:
            for b in blocks(batch.column(1)):
                for part in b.parts(INDEX_DOCS):
                    if n_docs and (n_docs + part.n > INDEX_DOCS or n_bytes + len(part.data) > INDEX_BYTES):
                        yield flush()
                        ids, known, lengths, found, n_docs, n_bytes = [], [], [], [], 0, 0
                    term, row, often, n = term_counts(part)
                    own = batch.column(0).slice(part.first, part.n)
                    ids.append(own.fill_null(0).to_numpy())
                    known.append(own.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
                    lengths.append(n.astype(np.int64))
                    found.append((term, row + n_docs, often))
                    n_docs, n_bytes = n_docs + part.n, n_bytes + len(part.data)
        if n_docs:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _INDEX)


def frequencies(found: DataFrame) -> DataFrame:
    """(term, df_part): how many documents of each index block hold each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                n = np.diff(np.frombuffer(starts.as_buffer(), dtype=np.uint32).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), dtype=np.int64)), pa.array(n)], names=["term", "df_part"])

    return found.select("terms", "starts").mapInArrow(run, "term long, df_part long")


def item_terms(items: DataFrame) -> DataFrame:
    """(no, terms, counts) of (no, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                term, row, often, _ = term_counts(b)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(b.n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(x[order].view(np.int64))) for x in (term, often)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), *lists], names=["no", "terms", "counts"])

    return items.select("no", "text").mapInArrow(run, "no long, terms array<long>, counts array<long>")


class DocumentBlock:
    """An index block, with the documents' m."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_docs: int, n_tokens: int):
        of = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
        self.ids, self.known, n = of("ids", np.int64), of("known", np.uint8).astype(bool), of("lengths", np.int64)
        self.terms, self.starts = of("terms", np.uint64), of("starts", np.uint32).astype(np.int64)
        self.places, self.often = of("places", np.uint16), of("often", f"u{batch.column('often_bytes')[i].as_py()}")
        if LENGTH * int(n.max(initial=0)) * n_docs < 1 << 63:
            self.m = BASE + LENGTH * n * n_docs // max(n_tokens, 1)
        else:
            self.m = np.array([BASE + LENGTH * x * n_docs // max(n_tokens, 1) for x in n.tolist()], dtype=np.int64)

    def postings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, place, impact) of the terms at these places of the index; a slot is a place in ``at``."""
        size = self.starts[at + 1] - self.starts[at]
        slot = np.repeat(np.arange(len(at)), size)
        where = np.arange(len(slot)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[at], size)
        place, often = self.places[where].astype(np.int64), self.often[where].astype(np.int64)
        return slot, place, 1_000_000_000 * often // (1000 * often + 8 * self.m[place])


def masks_of(slot: np.ndarray, place: np.ndarray, n_slots: int, n: int) -> np.ndarray:
    """For each document, the set of slots that it has, as bits of one or more 64-bit numbers."""
    bitmaps = np.zeros((-(-n_slots // 64) * 64, n), dtype=bool)
    bitmaps[slot, place] = True
    return np.ascontiguousarray(np.packbits(bitmaps, axis=0, bitorder="little").T).view(np.uint64)


def grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks, and each document's."""
    if masks.shape[1] == 1:
        some, group = np.unique(masks[:, 0], return_inverse=True)
        return some[:, None], group
    some, group = np.unique(masks, axis=0, return_inverse=True)
    return some, group.reshape(-1)


def best_documents(block: DocumentBlock, at: np.ndarray, weight: np.ndarray, first: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the block's first documents for an item; only scores from ``least`` on are wanted."""
    slot, place, impact = block.postings(at)
    n = len(block.ids)
    step = max(1, CELLS // max(len(at), 1))
    places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for low in range(0, n, step):  # once, but for very long items
        here = slice(None) if step >= n else np.flatnonzero((place >= low) & (place < low + step))
        own, p, x = slot[here], place[here] - low, impact[here]
        masks, group = grouped(masks_of(own, p, len(at), min(step, n - low)))
        top = np.zeros(len(at), dtype=np.int64)
        np.maximum.at(top, own, x)
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")[:, : len(at)]
        most = bits.astype(np.int64) @ (top * weight)
        bound = most[group]
        wanted = np.flatnonzero(bound >= least)
        by_mask = wanted[np.lexsort((group[wanted], -bound[wanted]))]
        bound = bound[by_mask]
        impacts = np.zeros((len(at), min(step, n - low)), dtype=np.int32)  # at most 1,000,000 each
        impacts[own, p] = x
        done, size = 0, STEP
        while done < len(by_mask) and bound[done] >= least:
            stop = min(len(by_mask), done + size)
            if stop < len(by_mask):  # a mask's documents stay together
                stop = int(np.searchsorted(-bound, -bound[stop - 1], side="right"))
            some = by_mask[done:stop]
            places, scores = np.concatenate([places, some + low]), np.concatenate([scores, weight @ impacts[:, some].astype(np.int64)])
            done, size = stop, 2 * size
            if len(scores) >= first:
                least = max(least, int(np.partition(scores, len(scores) - first)[len(scores) - first]))
                kept = scores >= least
                places, scores = places[kept], scores[kept]
    places, scores = places[scores >= least], scores[scores >= least]
    order = np.lexsort((block.ids[places], ~block.known[places], -scores))[:first]
    return places[order], scores[order]


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", first: int = FIRST) -> DataFrame:
    """(item, rank, id, score): each item's ``first`` documents of the highest scores above 0, equal ones by ascending id.

    Terms are runs of ASCII letters and digits and of all characters from U+0080 on, with A-Z in lower case, of whole texts.
    A term is known by its 64-bit hash.  Texts that are null, empty or without terms are not among the counted documents
    and score nothing; so do items without a term that a document has.  Every row is a document of its own, repeated rows
    too (rows that agree in id and score have neighbouring ranks); null ids stand last among equal scores.  A repeated
    item counts once; two items of one id with different texts get ranks each for itself.  Ids are whole numbers.  Empty
    tables give an empty result; other columns are ignored.
    """
    found = cut(index(docs, id_col, text_col))
    n_docs, n_tokens = found.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    n_docs, n_tokens = n_docs or 0, n_tokens or 0
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    asked = cut(numbered(asked, ["item", "text"], "no"))
    terms = cut(item_terms(asked).select("no", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("no", F.col("t.terms").alias("term"), F.col("t.counts").alias("often")))
    wanted = terms.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    df = frequencies(found).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df_part").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = terms.join(df, "term").select("no", "term", (weight * F.col("often")).alias("weight")).where("weight > 0")
    of_item = weighted.groupBy("no").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    numbers = F.floor((F.col("no") - 1) / ITEMS).cast("int").alias("g")
    queries = cut(of_item.groupBy(numbers).agg(F.array_sort(F.collect_list(F.struct("no", "terms"))).alias("items")).withColumn("size", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + 16 * F.size(x["terms"]) + 8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[int, np.ndarray] = {}  # the best scores of each item in this task so far
        for batch in batches:
            for i in range(len(batch)):
                block = DocumentBlock(batch, i, n_docs, n_tokens)
                own = batch.column("items")[i].values
                numbers, lists = own.field("no").to_numpy(), own.field("terms")
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                flat = lists.flatten()
                term, weight = flat.field("term").to_numpy().view(np.uint64), flat.field("weight").to_numpy()
                at = np.minimum(np.searchsorted(block.terms, term), max(len(block.terms) - 1, 0))
                there = block.terms[at] == term if len(block.terms) else np.zeros(len(term), dtype=bool)
                out: list[tuple[np.ndarray, ...]] = []
                for no, a, b in zip(numbers.tolist(), ends[:-1], ends[1:], strict=True):
                    some = a + np.flatnonzero(there[a:b])
                    if not len(some):
                        continue
                    before = lowest.get(no, np.zeros(0, dtype=np.int64))
                    least = int(before[0]) if len(before) >= first else 1
                    places, scores = best_documents(block, at[some], weight[some], first, least)
                    if len(places):
                        out.append((np.full(len(places), no), places, scores))
                        lowest[no] = np.sort(np.concatenate([before, scores]))[-first:]
                if out:
                    no, places, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(block.ids[places], mask=~block.known[places]), pa.array(scores)], names=["no", "id", "score"])

    best = meet(found, queries, "g", "size").mapInArrow(run, "no long, id long, score long")
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= first)
    return ranked.join(asked.select("no", "item"), "no").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_lexical_search."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
