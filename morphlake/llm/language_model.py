"""An interpolated modified Kneser-Ney trigram model, counted in Spark and kept as sorted hash arrays.

Words: each task counts the words of some millions of tokens and deals the counts by the word's hash.  Triples: each task
counts the triples of neighbouring tokens and deals them by their middle word, so that one shard has all that is known of
a pair's last word and of a pair as a context; the triples of a frequent middle word are spread by their last word as
well, and their contexts' sums are dealt once more.  A shard sums its triples, writes its sorted arrays to the shared
folder, and sends on how many different words each word followed.  A pair is also the context of the next word, and most
contexts were followed by one word once: those are not stored.  Scoring: every task maps the arrays into memory and looks
up the sorted hashes of a block of texts at once.

An executor's workers share its memory, so a task holds a token as nine bytes until it counts its triples, makes keys a
part at a time, and sends what it deals in rows and batches of bounded size.
"""

from __future__ import annotations

import mmap
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from io import BytesIO
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint_dir, cut, fold, partitions, setting, table
from .textops import Block, blocks, mix64, word_hashes, words

FOLDS, HELD_OUT = 7, 2
TOKENS_AT_ONCE = 2_500_000
SHARD_CHARS = 1 << 25  # characters of text for each shard; with few of them the session's number of partitions
FREQUENT = 500_000  # a word of more tokens is spread over shards, and with it all words of its bucket
SPREAD_BITS = 20  # buckets of words by hash: what tasks know of frequent words has this fixed size
OPEN, OPEN_BYTES = 20_000, 256 << 20  # arrays that a worker has mapped at once (a system allows some 65,000), and bytes of those that it had to read
SHORT = np.uint64(24)  # n-grams know a word by the other 40 bits of its hash, words are counted by all of it
BEGIN, END = np.uint64(1) << SHORT, np.uint64(2) << SHORT
PART = 1 << 17  # rows for which keys are made at once
PIECE, BATCH_BYTES = 10_000, 4 << 20  # dealt rows that travel as one value (below half a region of a small heap), and bytes that are sent at once
_ROLE = np.uint64(0x9E3779B97F4A7C15)
_DEALT = {"words": ("u8", "u4"), "triples": ("s", "s", "s", "u4"), "contexts": ("u8", "u4", "u4", "u4", "u4"), "kinds": ("s", "u4")}  # columns of what is dealt; "s" is a 40-bit one


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array; a repeated task writes the same again."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    out = BytesIO()
    np.save(out, array)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(out.getbuffer())
    store.move(draft, f"{path}/{name}.npy")


def get(folder: str, name: str) -> tuple[np.ndarray, int]:
    """An array and the bytes that it takes of the worker's memory: none where it can be mapped, all where the store isn't mounted."""
    store, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}.npy"
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            np.lib.format.read_magic(f)
            shape, _, kind = np.lib.format.read_array_header_1_0(f)
            own = {"trackfd": False} if sys.version_info >= (3, 13) else {}  # else every mapping keeps a descriptor
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **own)
            return np.frombuffer(mapped, dtype=kind, count=shape[0], offset=f.tell()), 0
    with store.open_input_stream(path) as source:
        array = np.load(BytesIO(source.read()))
    return array, array.nbytes


class Opened:
    """Arrays by name, opened when they are asked for; those that were not used for longest are closed again."""

    def __init__(self, folder: str, most: int, most_bytes: int):
        self.folder, self.most, self.most_bytes = folder, most, most_bytes
        self.held: OrderedDict[str, tuple[np.ndarray, int]] = OrderedDict()
        self.bytes = 0

    def __getitem__(self, name: str) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name][0]
        array, size = get(self.folder, name)
        self.held[name] = array, size
        self.bytes += size
        while len(self.held) > 1 and (len(self.held) > self.most or self.bytes > self.most_bytes):
            self.bytes -= self.held.popitem(last=False)[1][1]
        return array


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of all tokens by 63-bit hashes; each text ends with END."""
    w = words(b)
    h = word_hashes(w) | np.uint64(4)
    counts = np.bincount(w.row, minlength=b.n)
    current = np.empty(len(h) + b.n, dtype=np.uint64)
    current[np.arange(len(h)) + w.row] = h
    current[np.cumsum(counts + 1) - 1] = END
    return np.repeat(np.arange(b.n), counts + 1), current


def begins(row: np.ndarray) -> np.ndarray:
    """Which tokens are the first of their text."""
    return np.diff(row, prepend=-1) != 0


def triples(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token by its 40 bits, after the two before it; a text begins after two BEGIN."""
    w, first = word >> SHORT, begins(row)
    v = one_before(w, first)
    return one_before(v, first), v, w


def one_before(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What stands before each token; BEGIN where a text begins."""
    v = np.roll(w, 1)
    v[first] = BEGIN >> SHORT
    return v


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _ROLE ^ mix64(b))


def pair_context(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Keys of contexts of two words are even, those of one word odd."""
    return pair_key(u, v) & ~np.uint64(1)


def word_context(v: np.ndarray) -> np.ndarray:
    return mix64(v) | np.uint64(1)


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return pair_key(pair_key(u, v), w)


def in_parts(of: Callable[..., np.ndarray], *columns: np.ndarray, kind: type = np.uint64) -> np.ndarray:
    """of(*columns), made of PART rows at a time, so that what it needs in between stays small."""
    out = np.empty(len(columns[0]), dtype=kind)
    for a in range(0, len(out), PART):
        out[a : a + PART] = of(*(c[a : a + PART] for c in columns))
    return out


def buckets_of(w: np.ndarray) -> np.ndarray:
    """The buckets of words by their 40 bits."""
    return (mix64(w) >> np.uint64(64 - SPREAD_BITS)).astype(np.int64)


def is_spread(w: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Which words are in a bucket of a frequent word."""
    return spread[buckets_of(w)]


def spread_buckets(frequent: list[int]) -> np.ndarray:
    """The buckets with a frequent word, as one flag for each."""
    out = np.zeros(1 << SPREAD_BITS, dtype=bool)
    out[frequent] = True
    return out


def shard_of_pair(v: np.ndarray, w: np.ndarray, spread: np.ndarray, n: int) -> np.ndarray:
    """The shard of the pair and of all triples that end with it."""
    return shard_of(np.where(is_spread(v, spread), pair_key(v, w), mix64(v)), n)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _deal(what: str, shards: np.ndarray, *columns: np.ndarray, sort: int = 0) -> Iterator[tuple[int, str, bytes]]:
    """(shard, what, bytes of the columns) of rows, PIECE of them at most; 40-bit columns take five bytes.

    A shard's rows keep their order, or are sorted by the first ``sort`` columns.
    """
    order = np.argsort(shards, kind="stable")
    first = np.flatnonzero(np.diff(shards[order], prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(order)), strict=False):
        rows = order[a:b]
        if sort:
            rows = rows[np.lexsort([c[rows] for c in columns[:sort][::-1]])]
        for piece in (rows[k : k + PIECE] for k in range(0, len(rows), PIECE)):
            yield int(shards[piece[0]]), what, b"".join((_first_bytes(c[piece]) if t == "s" else c[piece].astype(t)).tobytes() for t, c in zip(_DEALT[what], columns, strict=True))


def _first_bytes(x: np.ndarray, n: int = 5) -> np.ndarray:
    """Numbers below 256 ** n as rows of n bytes."""
    return np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _read(group: pa.Table, what: str) -> list[np.ndarray]:
    """The columns that _deal wrote, of all the group's rows of this kind together."""
    values = [x.as_buffer() for x in _values(group, what)]
    sizes = [5 if t == "s" else np.dtype(t).itemsize for t in _DEALT[what]]
    out = [np.zeros(sum(map(len, values)) // sum(sizes), dtype="u8" if t == "s" else t) for t in _DEALT[what]]
    first = 0
    for raw in values:
        n, at = len(raw) // sum(sizes), 0
        for column, t, size in zip(out, _DEALT[what], sizes, strict=True):
            if t == "s":
                column[first : first + n].view(np.uint8).reshape(-1, 8)[:, :5] = np.frombuffer(raw, dtype=np.uint8, count=5 * n, offset=at).reshape(-1, 5)
            else:
                column[first : first + n] = np.frombuffer(raw, dtype=t, count=n, offset=at)
            at += n * size
        first += n
    return out


def _batches(rows: Iterable[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some BATCH_BYTES."""
    held: list[tuple[int, str, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary()))], names=["shard", "what", "counts"])


def _values(group: pa.Table, what: str) -> list[pa.Scalar]:
    """The group's rows of this kind, not copied."""
    return [x for of, x in zip(group.column("what").to_pylist(), group.column("counts"), strict=True) if of == what]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, each key's number among them, and how often it is there.

    Equal keys needn't keep their order, so a faster sort does than np.unique takes.
    """
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    number = np.empty(len(k), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return k[starts], order[starts], number, np.diff(np.append(starts, len(k)))


def _sums(order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts in the order, and the keys' first places."""
    k = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return starts, order[starts]


def _add(order: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of n over each run."""
    return np.add.reduceat(n[order].astype(np.int64), starts) if len(starts) else np.zeros(0, dtype=np.int64)


def discounts(n: list[int]) -> list[float]:
    """The modified discounts for counts 1, 2 and more, from how many things have the counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate((d1, d2, d3), 1)]


def spread_of(order: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run: how many things were counted once, twice and more often, and the sum of the counts."""
    return np.column_stack([_add(order, starts, x) for x in (n == 1, n == 2, n > 2, n)])


def pack(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A sorted hash array: keys in buckets of some 64 by their first bits, their next 24 bits, and a byte of value.

    A value is one number, or what spread_of gives.  255 says that it is among the few that are stored whole.  At any size,
    about one missing key in 300,000 is taken for another.
    """
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        del order
    bits = max(len(keys).bit_length() - 6, 0)
    starts = np.searchsorted((keys >> np.uint64(1)) >> np.uint64(63 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    if values.shape[1] == 1:
        code = np.minimum(values[:, 0], 255)
    else:
        code = np.where((values[:, 2] == 0) & (values[:, 0] < 16) & (values[:, 1] < 15), values[:, 0] * 16 + values[:, 1], 255)
    large = np.flatnonzero(code == 255)
    head = np.array([bits, len(keys), len(large), values.shape[1]], dtype=np.int64)
    rest = _first_bytes((keys << np.uint64(bits)) >> np.uint64(40), 3)
    columns = (head, values[large].astype(np.int64), starts, large.astype(np.uint32), rest, code.astype(np.uint8))
    return np.concatenate([np.ascontiguousarray(x).reshape(-1).view(np.uint8) for x in columns])


def pack_contexts(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """pack without the contexts of two words that one word followed once."""
    stored = (keys & np.uint64(1) == 1) | (values[:, 0] != 1) | (values[:, 3] != 1)
    return pack(keys[stored], values[stored])


class Packed:
    """Reads what pack wrote."""

    def __init__(self, raw: np.ndarray):
        self.bits, self.n, n_large, self.width = raw[:32].view(np.int64).tolist()
        at, views = 32, []
        for kind, n in ((np.int64, n_large * self.width), (np.uint32, (1 << self.bits) + 1), (np.uint32, n_large), (np.uint8, 3 * self.n), (np.uint8, self.n)):
            size = n * np.dtype(kind).itemsize
            views.append(raw[at : at + size].view(kind))
            at += size
        whole, self.starts, self.large, _, self.code = views
        self.whole = whole.reshape(-1, self.width)
        # Four bytes from every third on; the byte too many of the last key is the first of the values.
        self.fours = np.ndarray((self.n,), dtype="<u4", buffer=raw[at - 4 * self.n :], strides=(3,))

    def rest(self, place: np.ndarray) -> np.ndarray:
        return self.fours[np.minimum(place, self.n - 1)] & np.uint32(0xFFFFFF)  # take would copy all of an array with strides

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, 0 where they are missing: binary search in all buckets at once."""
        out = np.zeros((len(keys), self.width), dtype=np.int64)
        if not self.n:
            return out
        bucket = ((keys >> np.uint64(1)) >> np.uint64(63 - self.bits)).astype(np.int64)
        wanted = ((keys << np.uint64(self.bits)) >> np.uint64(40)).astype(np.uint32)
        low, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        high = end.copy()
        while (searching := low < high).any():
            middle = (low + high) >> 1
            less = searching & (self.rest(middle) < wanted)
            low = np.where(less, middle + 1, low)
            high = np.where(searching & ~less, middle, high)
        at = np.flatnonzero((low < end) & (self.rest(low) == wanted))
        place = low[at]
        code = self.code[place].astype(np.int64)
        out[at] = code[:, None] if self.width == 1 else np.column_stack([code >> 4, code & 15, code * 0, (code >> 4) + 2 * (code & 15)])
        large = np.flatnonzero(code == 255)
        out[at[large]] = self.whole[np.searchsorted(self.large, place[large])]
        return out


_ROWS = "shard int, what string, counts binary"


def _tally(n: np.ndarray) -> list[int]:
    return [int(np.sum(n == k)) for k in range(1, 5)]


def count_words(docs: DataFrame, text_col: str, folder: str, n_shards: int, frequent: int) -> tuple[int, int, list[int], list[int]]:
    """Store the count of each word; (tokens, words, shards, buckets of words of more than frequent tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            w = np.concatenate(held)
            held.clear()
            w, n = np.unique(w, return_counts=True)
            return _batches(_deal("words", shard_of(w, n_shards), w, n))

        for batch in batches:
            for b in blocks(batch.column(0)):
                held.append(tokens(b)[1])
                if sum(map(len, held)) >= TOKENS_AT_ONCE:
                    yield from flush()
        if held:
            yield from flush()

    def merge(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        w, n = _read(group, "words")
        order = np.argsort(w)
        starts, at = _sums(order, w)
        n, w = _add(order, starts, n), w[at]
        put(folder, f"word-{shard}", w)
        put(folder, f"word-n-{shard}", n.astype(np.min_scalar_type(n.max())))
        often = np.unique(buckets_of(w[n > frequent] >> SHORT)).tolist()
        return pa.table({"shard": [shard], "tokens": [int(n.sum())], "words": [len(w)], "frequent": pa.array([often], type=pa.list_(pa.int64()))})

    done = cut(docs.select(text_col).mapInArrow(count, _ROWS).groupBy("shard").applyInArrow(merge, "shard long, tokens long, words long, frequent array<long>"))
    sums = done.select("shard", "tokens", "words").collect()
    frequent_buckets = sorted(r[0] for r in done.select(F.explode("frequent")).distinct().collect())
    return sum(r.tokens for r in sums), sum(r.words for r in sums), sorted(r.shard for r in sums), frequent_buckets


def count_triples(held: list[tuple[np.ndarray, np.ndarray]], spread: np.ndarray, n_shards: int) -> Iterator[pa.RecordBatch]:
    """Deal the counts of the triples in some (tokens by 40 bits, which of them begin a text), and empty that list."""
    w, first = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    v = one_before(w, first)
    key = in_parts(triple_key, one_before(v, first), v, w)
    del v  # made again, as the sort needs the room
    order = np.argsort(key)
    starts, at = _sums(order, key)
    n = np.diff(np.append(starts, len(order))).astype(np.uint32)
    del key, order, starts
    v = one_before(w, first)
    u = one_before(v, first)[at]
    v, w = v[at], w[at]
    del at, first
    shards = in_parts(lambda v, w: shard_of_pair(v, w, spread, n_shards), v, w, kind=np.int32)
    yield from _batches(_deal("triples", shards, v, w, u, n, sort=2))


def train(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> dict:
    """Count the texts of docs; returns the model: its folder, its shards' numbers, a few totals, and the buckets of frequent words.

    Texts and what is dealt reach the workers in batches of BATCH_BYTES too: else a batch may be a whole shard's.
    """
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        return _train(docs, text_col, frequent)


def _train(docs: DataFrame, text_col: str, frequent: int) -> dict:
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    n_shards = max(partitions(spark), chars // SHARD_CHARS)
    folder = f"{checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.replace("file:", "", 1)
    n_tokens, n_words, word_shards, often = count_words(docs, text_col, folder, n_shards, frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        spread = spread_buckets(often)
        for batch in batches:
            for b in blocks(batch.column(0)):
                row, word = tokens(b)
                held.append((word >> SHORT, begins(row)))
                del row, word
                if sum(len(x[0]) for x in held) >= TOKENS_AT_ONCE:
                    yield from count_triples(held, spread, n_shards)
        if held:
            yield from count_triples(held, spread, n_shards)

    def merge(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        spread = spread_buckets(often)
        v, w, u, n = _read(group, "triples")
        key = in_parts(triple_key, u, v, w)
        order = np.argsort(key)
        starts, at = _sums(order, key)
        n = _add(order, starts, n)
        del order, starts
        u, v, w, key = u[at], v[at], w[at], key[at]
        del at
        put(folder, f"triple-{shard}", pack(key, n[:, None]))
        tallies = _tally(n)
        key = in_parts(pair_context, u, v)
        del u
        order = np.argsort(key)
        starts, at = _sums(order, key)
        # A context that one word followed once isn't stored, if this shard knows all of it.
        kinds = np.diff(np.append(starts, len(order)))
        wanted = (kinds > 1) | (n[at] > 1) | in_parts(lambda x: is_spread(x, spread), v[at], kind=bool)
        order = order[np.repeat(wanted, kinds)]
        starts, at = _sums(order, key)
        contexts = [(key[at], v[at], spread_of(order, starts, n))]
        del n, kinds, wanted
        key = in_parts(pair_key, v, w)
        order = np.argsort(key)
        starts, at = _sums(order, key)
        kinds, key, v, w = np.diff(np.append(starts, len(order))), key[at], v[at], w[at]
        put(folder, f"pair-{shard}", pack(key, kinds[:, None]))
        tallies += [*_tally(kinds), len(kinds)]
        order = np.argsort(v)
        starts, at = _sums(order, v)
        contexts.append((word_context(v[at]), v[at], spread_of(order, starts, kinds)))
        key, of, values = (np.concatenate(x) for x in zip(*contexts, strict=True))
        del contexts, kinds, v
        split = is_spread(of, spread)
        put(folder, f"context-{shard}", pack_contexts(key[~split], values[~split]))
        key, values = key[split], values[split]
        order = np.argsort(key)
        dealt = _deal("contexts", shard_of(key[order], n_shards), key[order], *values[order].T)
        order = np.argsort(w)
        starts, at = _sums(order, w)
        w, kinds = w[at], np.diff(np.append(starts, len(order)))
        dealt = chain(dealt, _deal("kinds", shard_of(mix64(w), n_shards), w, kinds), [(-1 - shard, "tallies", np.array(tallies, dtype=np.int64).tobytes())])
        return pa.Table.from_batches(list(_batches(dealt)))

    def finish(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        if shard < 0:
            return pa.table({"shard": [shard], "tallies": [np.frombuffer(_values(group, "tallies")[0].as_buffer(), dtype=np.int64).tolist()]})
        key, *values = _read(group, "contexts")
        order = np.argsort(key)
        starts, at = _sums(order, key)
        put(folder, f"split-{shard}", pack_contexts(key[at], np.column_stack([_add(order, starts, x) for x in values])))
        w, kinds = _read(group, "kinds")
        key = mix64(w)
        order = np.argsort(key)
        starts, at = _sums(order, key)
        kinds = _add(order, starts, kinds)
        put(folder, f"kinds-{shard}", pack(key[at], kinds[:, None]))
        return pa.table({"shard": [shard], "tallies": [[*_tally(kinds), len(kinds)]]})

    counted = docs.select(text_col).mapInArrow(count, _ROWS).groupBy("shard").applyInArrow(merge, _ROWS)
    done = counted.groupBy("shard").applyInArrow(finish, "shard long, tallies array<long>").collect()
    high = np.sum([[0] * 9, *(r.tallies for r in done if r.shard < 0)], axis=0).tolist()
    low = np.sum([[0] * 5, *(r.tallies for r in done if r.shard >= 0)], axis=0).tolist()
    return {
        "folder": folder,
        "n_shards": n_shards,
        "shards": {"words": word_shards, "triples": sorted(-1 - r.shard for r in done if r.shard < 0), "kinds": sorted(r.shard for r in done if r.shard >= 0)},
        "frequent": often,
        "tokens": n_tokens,
        "words": n_words,
        "pairs": high[8],
        "kinds": low[4],
        "few": low[:2],
        "discounts": [discounts(low[:4]), discounts(high[4:8]), discounts(high[:4])],
    }


def _interpolate(n: np.ndarray, d: np.ndarray, context: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The discounted share of counts n in their contexts, and p for what the discounts leave."""
    total = context[:, 3]
    return np.where(total > 0, (n - d[np.minimum(n, 3)] + (context[:, :3] @ d[1:]) * p) / np.maximum(total, 1), p)


class Model:
    """The arrays of a trained model; OPEN of them are mapped at once."""

    def __init__(self, model: dict):
        self.m = model
        self.spread = spread_buckets(model["frequent"])
        self.shards = {k: set(v) for k, v in model["shards"].items()}
        self.opened = Opened(model["folder"], OPEN, OPEN_BYTES)

    def by_shard(self, keys: np.ndarray, shards: np.ndarray, width: int, find) -> np.ndarray:
        """find(shard, keys) for the different keys of each shard, in their order, so that arrays are read forwards."""
        different, at, back, _ = distinct(keys)
        shards = shards[at]
        out = np.zeros((len(different), width), dtype=np.int64)
        order = np.argsort(shards, kind="stable")
        numbers, first = np.unique(shards[order], return_index=True)
        for number, a, b in zip(numbers.tolist(), first, np.append(first[1:], len(order)), strict=False):
            out[order[a:b]] = find(number, different[order[a:b]])
        return out[back]

    def of(self, name: str, kind: str, keys: np.ndarray, shards: np.ndarray, width: int = 1) -> np.ndarray:
        """What the arrays ``name`` have for the keys; kind: the shards that have such arrays."""
        return self.by_shard(keys, shards, width, lambda k, x: Packed(self.opened[f"{name}-{k}"]).find(x) if k in self.shards[kind] else 0)

    def count(self, word: np.ndarray) -> np.ndarray:
        """How often the training texts have each word."""

        def find(shard: int, keys: np.ndarray) -> np.ndarray | int:
            if shard not in self.shards["words"]:
                return 0
            known, n = self.opened[f"word-{shard}"], self.opened[f"word-n-{shard}"]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.where(known[place] == keys, n[place], 0)[:, None]

        return self.by_shard(word, shard_of(word, self.m["n_shards"]), 1, find)[:, 0]

    def context(self, keys: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What spread_of gave for contexts that end with the words last."""
        out, split, n = np.zeros((len(keys), 4), dtype=np.int64), is_spread(last, self.spread), self.m["n_shards"]
        out[split] = self.of("split", "kinds", keys[split], shard_of(keys[split], n), 4)
        out[~split] = self.of("context", "triples", keys[~split], shard_of(mix64(last[~split]), n), 4)
        return out

    def score(self, b: Block) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text of a block."""
        m, n_shards = self.m, self.m["n_shards"]
        row, word = tokens(b)
        u, v, w = triples(row, word)
        first = begins(row)
        low, middle, high = (np.array([0.0, *d]) for d in m["discounts"])
        # Different words and pairs are looked up once; a token's context is the word or pair that ends before it.
        different, _, of_word, _ = distinct(word)
        short = different >> SHORT
        count = self.count(different)[of_word]
        kinds = self.of("kinds", "kinds", mix64(short), shard_of(mix64(short), n_shards))[:, 0][of_word]
        pairs = max(m["pairs"], 1)
        spread = low[1] * m["few"][0] + low[2] * m["few"][1] + low[3] * (m["kinds"] - sum(m["few"]))
        p = (kinds - low[np.minimum(kinds, 3)]) / pairs + (spread / pairs if m["pairs"] else 1.0) / (m["kinds"] + 1)
        key, at, of_pair, _ = distinct(pair_key(v, w))
        shards = shard_of_pair(v[at], w[at], self.spread, n_shards)
        followed = self.of("pair", "triples", key, shards)[:, 0][of_pair]
        begin = BEGIN >> SHORT
        before = lambda of, n: np.where(first, n, np.roll(of, 1))
        ends = np.append(short, begin)
        p = _interpolate(followed, middle, self.context(word_context(ends), ends)[before(of_word, len(different))], p)
        two = np.append(key, pair_key(np.array([begin]), np.array([begin])))
        context = self.context(two & ~np.uint64(1), np.append(w[at], begin))[before(of_pair, len(key))]
        seen = np.where(first, m["tokens"] > 0, np.roll(followed > 0, 1))
        context[seen & (context[:, 3] == 0)] = (1, 0, 0, 1)
        shards = shards[of_pair]
        p = _interpolate(self.of("triple", "triples", triple_key(u, v, w), shards)[:, 0], high, context, p)
        base = np.log10((count + 1) / (m["tokens"] + m["words"] + 1))
        add = lambda x: np.bincount(row, weights=x, minlength=b.n)
        return np.bincount(row, minlength=b.n), np.bincount(row[count > 0], minlength=b.n), add(base), add(np.log10(p))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row.

    A null or empty text has one token, its end.  A word that the training texts don't have gets the share that the
    unigrams leave to unknown words; after words that no training text has in this order the shorter context decides.  Rows with a null id and repeated
    rows are scored like others; a model of no texts gives every token probability 1; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = None
        for batch in batches:
            mapped = mapped or Model(model)
            for b in blocks(batch.column(1)):
                n, known, base, own = mapped.score(b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n).cast(id_type), pa.array(n, type=pa.int64()), pa.array(known, type=pa.int64()), pa.array(np.full(b.n, model["tokens"])), pa.array(base), pa.array(own)],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of all texts together."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_language_model."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return score(docs, model).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
