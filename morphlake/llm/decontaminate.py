"""Benchmark decontamination by pigeonhole edit matching.

A text is its words in lower case with single blanks between them.  A test item of m characters may stand in a document
with up to k = floor(rate * m) edits.  Cut into k + 1 pieces, at least one piece then stands there unchanged, so all
pieces of a block of items go into one Aho-Corasick automaton, and around each piece hit Myers' bit-parallel algorithm
measures the item's smallest edit distance to any part of that stretch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, table, without

RATE = 0.08
MIN_CHARS = 32
BLOCK_ITEMS = 4000
BLOCK_CHARS = 4_000_000
ROWS = 64

_WORDS = re.compile(r"\w+")
_ready: dict[str, tuple] = {}


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall(text or "")).lower()


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): one more than the edits allowed, of about equal length."""
    n = int(rate * len(item)) + 1
    cuts = [j * len(item) // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(masks: dict[str, int], m: int, text: str, anchored: bool = False, ends: set[int] | None = None) -> tuple[int, int]:
    """(distance, end) of the part of text that is nearest to a pattern of m characters; ends are exclusive.

    masks has, for each character, the pattern's positions as bits.  anchored: only parts that begin at text's start.
    ends: only parts that end at one of these.
    """
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = whole, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & whole), up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & whole, (mh << 1) & whole
        up, down = mh | (~(xv | ph) & whole), ph & xv
        if score < best and (ends is None or j in ends):
            best, end = score, j
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def prepare(items: list[tuple[int, str]], rate: float) -> tuple:
    """The automaton over all pieces, and the items' normal texts."""
    found: dict[str, list[tuple[int, int]]] = {}
    for item, (_, text) in enumerate(items):
        for at, piece in pieces(text, rate):
            found.setdefault(piece, []).append((item, at))
    automaton = ahocorasick.Automaton()
    for piece, places in found.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, [(i, text, masks_of(text), masks_of(text[::-1])) for i, text in items]


def nearest_words(masks: dict[str, int], m: int, text: str, found: list[int], k: int) -> tuple[int, int, int]:
    """(distance, start, stop) of the nearest part between whole words that begins up to k from a place of ``found``."""
    best, last = (k + 1, 0, 0), -1
    for at in found:
        for start in range(max(0, at - k, last + 1), min(len(text), at + k + 1)):
            last = start
            if start and text[start - 1] != " ":
                continue
            part = text[start : start + m + k]
            ends = {j for j in range(max(1, m - k), len(part) + 1) if start + j == len(text) or text[start + j] == " "}
            distance, size = nearest(masks, m, part, True, ends)
            if size and distance < best[0]:
                best = (distance, start, start + size)
    return best


def leaks(text: str, automaton: ahocorasick.Automaton, items: list[tuple], rate: float, min_chars: int) -> Iterator[tuple[int, int, int, int]]:
    """(item id, distance, start, end) of each item found in a normal text, at its best place."""
    if len(text) < 1:
        return
    starts: dict[int, set[int]] = {}
    for end, (length, places) in automaton.iter(text):
        for item, at in places:
            starts.setdefault(item, set()).add(end + 1 - length - at)
    for item, found in sorted(starts.items()):
        item_id, pattern, masks, back = items[item]
        m = len(pattern)
        k = int(rate * m)
        if m < min_chars:
            distance, start, stop = nearest_words(masks, m, text, sorted(found), k)
            if distance <= k:
                yield item_id, distance, start, stop
            continue
        best = (k + 1, 0, 0)
        reach = -1
        for at in sorted(found):
            # An item may begin up to k before or after where its piece says; stretches that overlap are searched once.
            low, high = max(0, at - k, reach - m - 2 * k), min(len(text), at + m + k)
            if high <= reach:
                continue
            reach = high
            distance, end = (0, at + m - low) if at >= 0 and text.startswith(pattern, at) else nearest(masks, m, text[low:high])
            if distance < best[0]:
                stop = low + end
                _, size = nearest(back, m, text[max(0, stop - m - k) : stop][::-1], anchored=True)
                best = (distance, stop - size, stop)
                if not distance:
                    break
        distance, start, stop = best
        if distance <= k:
            yield item_id, distance, start, stop


def place(text: str, start: int, stop: int) -> tuple[int, int]:
    """The words of text that the part from start to stop of its normal text touches, as an interval of text."""
    at, first, last = 0, None, 0
    for w in _WORDS.finditer(text):
        size = len(w.group().lower())
        if at + size > start and first is None:
            first = w.start()
        if at < stop:
            last = w.end()
        else:
            break
        at += size + 1
    return first or 0, last


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items' normal texts in blocks of a fixed size: what the driver holds and broadcasts at once doesn't grow with the benchmark."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = normal(row[1])
        if not text:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(text) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, item, distance, start, end) for each document and benchmark item that it holds within the error budget.

    start and end are the interval of the document's own text, distance the edits between the normal texts.  An item
    of fewer than min_chars characters must stand between whole words.  Null or empty texts and items match nothing;
    repeated rows give repeated results; an empty benchmark or table gives no rows.  Texts are searched whole.
    The leaks of a block of items are written before the next block is read, and its broadcast is released.
    """
    spark = docs.sparkSession
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {benchmark.schema[item_col].dataType.simpleString()}, distance int, start int, end int"
    names = [id_col, item_col, "distance", "start", "end"]
    types = [to_arrow_type(docs.schema[id_col].dataType), to_arrow_type(benchmark.schema[item_col].dataType), pa.int32(), pa.int32(), pa.int32()]
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _ready:  # a worker keeps the automaton of one block
                _ready.clear()
                _ready[name] = prepare(sent.value, rate)
            automaton, items = _ready[name]
            for batch in batches:
                rows = []
                for at in range(0, len(batch), ROWS):
                    part = batch.slice(at, ROWS)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        for item, distance, start, stop in leaks(normal(text), automaton, items, rate, min_chars):
                            rows.append((doc, item, distance, *place(text, start, stop)))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=names)

        found = cut(docs.select(id_col, text_col).mapInArrow(search, schema))
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item.  Rows with a null id that hold one go as well; see find_leaks."""
    return without(docs, id_col, find_leaks(docs, benchmark, id_col, **options).select(id_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_decontamination: the leaks of the benchmark into the documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
