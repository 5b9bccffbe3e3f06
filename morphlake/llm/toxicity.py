"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context windows of their hits.

The lexicon is learned: words, and stems of several words (written ``stem*``), that stand in toxic training documents
and hardly in others.  A state of the Levenshtein
automata is a set of (trie node, edits) pairs, so one deterministic automaton reads a word once for all terms; the
words of a block of texts step through its table together.  A hit counts by its term and its edits, more if other hits
are within its window, less if quotation marks stand around it.  A logistic fit weighs the sums of each document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold, table
from .learning import FOLDS, HELD_OUT, fit_logistic, training_sample
from .textops import blocks

CUT = 0.5
SURE = 6.63  # of a likelihood-ratio test: chance alone gives so much to one word in a hundred
LEAST_SPREAD = 0.02  # of the toxic documents that a term stands in
LEAST_SHARE = 0.5
WINDOW = 8
QUOTED, MISSPELLED, CROWD = 0.25, 0.6, 0.25
EDITS = ((5, 0), (9, 1), (65, 2))  # below these lengths, so many edits; longer words are no misspellings of others
LONGEST = EDITS[-1][0]  # letters from which a term has no automaton: it is looked up as it is
STEM_EDITS = ((8, 0), (10**9, 1))
STEM_SIZES, STEM_FORMS = (4, 10), 3
STATES = 60_000
OPENING, CLOSING = "“«„", "”»"

_KNOWN = 0x20000  # above all letters that have two cases


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, is it part of a word, and quotation mark (1 opens, 2 closes, 3 either) of the lower code points."""
    lower, inside, quote = np.arange(_KNOWN, dtype=np.uint32), np.ones(_KNOWN, dtype=bool), np.zeros(_KNOWN, dtype=np.uint8)
    for c in range(_KNOWN):
        x = chr(c)
        low = x.lower()
        lower[c] = ord(low) if len(low) == 1 and ord(low) < _KNOWN else c
        inside[c] = x.isalnum() or x in "@$"
        quote[c] = 1 if x in OPENING else 2 if x in CLOSING else 3 * (x == '"')
    return lower, inside, quote


class Words:
    """The words of a block of texts by code points."""

    def __init__(self, texts: pa.Array, tables: tuple):
        lower, inside, quote = tables
        texts = texts.cast(pa.large_string()).fill_null("")
        self.n = len(texts)
        raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.minimum(raw, _KNOWN - 1)
        self.points = np.where(raw < _KNOWN, lower[at], raw)
        is_in = inside[at] | (raw >= _KNOWN)
        n = len(raw)
        starts, ends = is_in.copy(), is_in.copy()
        if n:
            starts[1:] &= ~is_in[:-1]
            ends[:-1] &= ~is_in[1:]
            cuts = self.bounds[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            starts[cuts] = is_in[cuts]
            ends[cuts - 1] = is_in[cuts - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.bounds, self.start, side="right") - 1
        marks = quote[at] * (raw < _KNOWN)
        self.quotes = np.concatenate([[0], np.cumsum(marks > 0)])
        self.opened = np.concatenate([[0], np.cumsum((marks == 1).astype(np.int64) - (marks == 2))])
        self.either = np.concatenate([[0], np.cumsum(marks == 3)])

    def text(self, i: int) -> str:
        """The i-th word, in lower case."""
        return self.points[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def edits_of(term: str) -> int:
    stem = term.endswith("*")
    return next((k for length, k in (STEM_EDITS if stem else EDITS) if len(term) - stem < length), 0)


class TooManyStates(ValueError):
    """One automaton can't hold the terms; Lexicon deals them to several."""


class Automaton:
    """Deterministic table of the Levenshtein automata of all terms, over the terms' letters and one for all others."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        letters = sorted({c for t in terms for c in t.rstrip("*")})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        reach = [0]  # the most edits that a term below the node may have
        ends: dict[int, int] = {}
        stems: dict[int, int] = {}
        for number, term in enumerate(terms):
            node, most = 0, edits_of(term)
            reach[0] = max(reach[0], most)
            for c in term.rstrip("*"):
                if self.letters[c] not in children[node]:
                    children[node][self.letters[c]] = len(children)
                    children.append({})
                    reach.append(0)
                node = children[node][self.letters[c]]
                reach[node] = max(reach[node], most)
            (stems if term.endswith("*") else ends)[node] = number

        def closed(pairs: dict[int, int]) -> frozenset[tuple[int, int]]:
            """With the terms' letters that the word leaves out; each node with its fewest edits."""
            todo = [node for node in pairs if node >= 0]
            while todo:
                node = todo.pop()
                for child in children[node].values():
                    e = pairs[node] + 1
                    if e <= reach[child] and pairs.get(child, 99) > e:
                        pairs[child] = e
                        todo.append(child)
            whole = [(e, -1 - node if node < 0 else stems[node]) for node, e in pairs.items() if node < 0 or node in stems and e <= edits_of(terms[stems[node]])]
            if whole:  # whatever follows a stem, the word is a hit; only fewer edits are a better one
                e, number = min(whole)
                return frozenset({(-1 - number, e), *((node, x) for node, x in pairs.items() if node >= 0 and x < e)})
            return frozenset(pairs.items())

        def step(state: frozenset, letter: int) -> frozenset:
            out: dict[int, int] = {}

            def add(node: int, e: int) -> None:
                if e <= reach[node] and out.get(node, 99) > e:
                    out[node] = e

            for node, e in state:
                if node < 0:
                    out[node] = e
                    continue
                add(node, e + 1)
                for c, child in children[node].items():
                    add(child, e + (c != letter))
            return closed(out)

        start = closed({0: 0})
        numbers = {frozenset(): 0, start: 1}
        order, table_rows = [frozenset(), start], []
        while len(table_rows) < len(order):
            state = order[len(table_rows)]
            row = []
            for letter in range(len(letters) + 1):
                stays = not state or len(state) == 1 and min(state)[0] < 0
                new = state if stays else step(state, letter)
                if new not in numbers:
                    numbers[new] = len(order)
                    order.append(new)
                row.append(numbers[new])
            table_rows.append(row)
            if len(order) > STATES:
                raise TooManyStates
        self.next = np.array(table_rows, dtype=np.int32)
        self.term = np.full(len(order), -1, dtype=np.int32)
        self.edits = np.zeros(len(order), dtype=np.int32)
        for i, state in enumerate(order):
            found = [(e, -1 - node if node < 0 else ends[node]) for node, e in state if node < 0 or node in ends and e <= edits_of(terms[ends[node]])]
            if found:
                self.edits[i], self.term[i] = min(found)
        size = [len(t.rstrip("*")) for t in terms]
        self.longest = max((n + edits_of(t) for n, t in zip(size, terms, strict=True)), default=0)
        self.shortest = min((n - edits_of(t) for n, t in zip(size, terms, strict=True)), default=1)
        self.whole = np.array([len(state) == 1 and min(state)[0] < 0 for state in order], dtype=bool)
        self.classes = np.zeros(_KNOWN, dtype=np.int32)
        for c, i in self.letters.items():
            if ord(c) < _KNOWN:
                self.classes[ord(c)] = i

    @classmethod
    def of(cls, fields: dict) -> Automaton:
        """The automaton whose fields were sent as plain data."""
        out = cls.__new__(cls)
        vars(out).update(fields)
        return out

    def read(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words near a term."""
        size = w.end - w.start
        word = np.flatnonzero(size >= self.shortest)
        state = np.ones(len(word), dtype=np.int32)
        hits, states = [], []
        for j in range(self.longest + 1):
            done = (size[word] == j) | self.whole[state]
            hits.append(word[done])
            states.append(state[done])
            word, state = word[~done], state[~done]
            if not len(word):
                break
            points = w.points[w.start[word] + j]
            letter = np.where(points < _KNOWN, self.classes[np.minimum(points, _KNOWN - 1)], 0)
            state = self.next[state, letter]
            alive = state > 0
            word, state = word[alive], state[alive]
        hits, states = np.concatenate(hits) if hits else word, np.concatenate(states) if states else state
        found = self.term[states] >= 0
        hits, states = hits[found], states[found]
        order = np.argsort(hits)
        return hits[order], self.term[states][order], self.edits[states][order]


class Long:
    """Terms of LONGEST letters and more: pasted keys and the like, which only match as they are."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.places = {t: i for i, t in enumerate(terms)}
        self.sizes = np.unique([len(t) for t in terms])

    def read(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits), as Automaton.read."""
        word = np.flatnonzero(np.isin(w.end - w.start, self.sizes))
        term = np.array([self.places.get(w.text(i), -1) for i in word], dtype=np.int32)
        return word[term >= 0], term[term >= 0], np.zeros(int((term >= 0).sum()), dtype=np.int32)


class Lexicon:
    """Any number of terms of any length: one automaton, or several where one would have more than ``STATES`` states."""

    def __init__(self, terms: list[str]):
        self.parts: list[tuple[np.ndarray, dict]] = []
        long = [i for i, t in enumerate(terms) if len(t) >= LONGEST]
        if long:
            self.parts.append((np.array(long, dtype=np.int32), {"long": [terms[i] for i in long]}))
        short = [i for i, t in enumerate(terms) if len(t) < LONGEST]
        todo = [sorted(short, key=lambda i: terms[i])] if short or not long else []
        while todo:
            numbers = sorted(some := todo.pop())
            try:
                self.parts.append((np.array(numbers, dtype=np.int32), vars(Automaton([terms[i] for i in numbers]))))
            except TooManyStates:  # one term alone has fewer
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]

    @staticmethod
    def read(parts: list[tuple[np.ndarray, Automaton | Long]], w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like Automaton.read: of the hits of one word, that of the fewest edits, and stems before words."""
        found = [(word, numbers[term], edits, np.array([not t.endswith("*") for t in a.terms], dtype=bool)[term]) for numbers, a in parts for word, term, edits in [a.read(w)]]
        if len(found) == 1:
            return found[0][:3]
        word, term, edits, plain = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((term, plain, edits, word))
        word, term, edits = word[order], term[order], edits[order]
        first = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
        return word[first], term[first], edits[first]


def _received(parts: list[tuple[np.ndarray, dict]]) -> list[tuple[np.ndarray, Automaton | Long]]:
    return [(numbers, Long(fields["long"]) if "long" in fields else Automaton.of(fields)) for numbers, fields in parts]


def window_sums(w: Words, parts: list[tuple[np.ndarray, Automaton | Long]], weights: np.ndarray, allowed: set[str]) -> np.ndarray:
    """One row of sums for each text.  allowed: words near a term that are none of its misspellings."""
    word, term, edits = Lexicon.read(parts, w)
    if allowed and len(word):
        keep = np.array([e == 0 or w.text(i) not in allowed for i, e in zip(word, edits, strict=True)], dtype=bool)
        word, term, edits = word[keep], term[keep], edits[keep]
    row, n_words = w.row[word], np.bincount(w.row, minlength=w.n)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    low, high = np.maximum(word - WINDOW, first_word[row]), np.minimum(word + WINDOW + 1, first_word[row + 1])
    near = np.searchsorted(word, high) - np.searchsorted(word, low) - 1
    last = np.minimum(high, len(w.start)) - 1
    left, right, at, begin = w.start[low], w.end[last], w.start[word], w.bounds[row]
    right = np.minimum(w.bounds[row + 1], right + 1)
    around = (w.quotes[at] > w.quotes[np.maximum(left - 1, begin)]) & (w.quotes[right] > w.quotes[w.end[word]])
    quoted = around & (((w.either[at] - w.either[begin]) % 2 == 1) | (w.opened[at] - w.opened[begin] > 0))
    value = weights[term] * np.where(edits > 0, MISSPELLED, 1.0) * np.where(quoted, QUOTED, 1.0) * (1 + CROWD * np.minimum(near, 4))
    total = lambda mask: np.log1p(np.bincount(row[mask], minlength=w.n))
    most = np.zeros(w.n)
    np.maximum.at(most, row, value)
    sums = np.bincount(row, weights=value, minlength=w.n)
    return np.column_stack([total((edits == 0) & ~quoted), total((edits > 0) & ~quoted), total(quoted), np.log1p(sums), np.log1p(most), np.minimum(1, sums * 20 / np.maximum(n_words, 20))])


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[float]]:
    """Terms and their weights: all words and stems of the sample that mark toxic documents beyond chance.

    A term must stand in a fiftieth of the toxic documents at least: rarer words mark single documents and their copies.
    That also bounds the terms, by fifty times a document's words.  Beside a stem, what it covers stays wherever it may
    have more edits than the stem.  A weight is the logarithm of how much likelier a document with the term is toxic than one of the sample.
    """
    # Copies of one document are one witness: mostly they agree in the five words with the least hashes.
    key = F.slice(F.array_sort(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda x: F.xxhash64(x)))), 1, 5)
    sample = sample.withColumn("_key", F.coalesce(F.array_join(key, ","), F.lit(""))).dropDuplicates(["_key", "label"]).drop("_key").persist()
    n_toxic, n_clean = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    least, base = LEAST_SPREAD * n_toxic, math.log((n_toxic + 0.5) / (n_clean + 0.5))
    share = n_toxic / max(n_toxic + n_clean, 1)
    if not 0 < share < 1:
        sample.unpersist()
        return [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables()
        for batch in batches:
            for b in blocks(batch.column(0)):
                w = Words(batch.column(0).slice(b.first, b.n), tables)
                label = batch.column(1).slice(b.first, b.n).to_numpy(zero_copy_only=False)
                text = w.points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                seen: dict[str, list[int]] = {}
                for row, words in _by_row(w, text):
                    for x in words:
                        n = seen.setdefault(x, [0, 0])
                        n[0] += 1
                        n[1] += int(label[row])
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array([n for n, _ in seen.values()], type=pa.int64()), pa.array([t for _, t in seen.values()], type=pa.int64())], names=["word", "docs", "toxic"])

    words = sample.select("text", "label").mapInArrow(run, "word string, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).persist()
    low, high = STEM_SIZES
    sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length("word")))
    stems = (
        words.where(F.length("word") >= low)
        .select(F.explode(F.transform(sizes, lambda n: F.left("word", n))).alias("stem"), "docs", "toxic")
        .groupBy("stem")
        .agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"), F.count_if(F.col("toxic") > 0).alias("forms"))
        .where(F.col("forms") >= STEM_FORMS)
        .select(F.concat("stem", F.lit("*")).alias("word"), "docs", "toxic")
    )
    surely = F.log((F.col("toxic") + 0.5) / (F.col("docs") - F.col("toxic") + 0.5)) - base
    part = lambda n, of: F.when(n > 0, n * F.log(n / (F.col("docs") * of))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), share) + part(F.col("docs") - F.col("toxic"), 1 - share))
    marks = (F.col("toxic") >= least) & (F.col("toxic") >= LEAST_SHARE * F.col("docs")) & (F.col("toxic") > share * F.col("docs")) & (ratio >= SURE)
    rows = words.where(F.length("word") > 2).unionByName(stems).where(marks).select("word", surely.alias("weight")).collect()
    words.unpersist()
    sample.unpersist()
    kept: dict[str, float] = {}
    for word, weight in sorted(((r["word"], r["weight"]) for r in rows), key=lambda x: (not x[0].endswith("*"), len(x[0]), x)):
        body = word.rstrip("*")
        over = [f"{body[:n]}*" for n in range(low, len(body) + (not word.endswith("*")))]
        if any(kept.get(x, -99.0) >= weight - 1 and edits_of(x) >= edits_of(word) for x in over):
            continue  # a stem is as sure and has as many edits
        kept[word] = weight
    best = sorted(kept.items(), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in best], [x for _, x in best]


def _by_row(w: Words, text: str) -> Iterator[tuple[int, set[str]]]:
    """The distinct words of each text."""
    cut = np.searchsorted(w.row, np.arange(w.n + 1))
    for row in range(w.n):
        yield row, {text[a:b] for a, b in zip(w.start[cut[row] : cut[row + 1]], w.end[cut[row] : cut[row + 1]], strict=True)}


def _near_words(sample: DataFrame, terms: list[str]) -> list[str]:
    """Words of the sample's clean documents that are near a term: they are words of their own."""

    sent = sample.sparkSession.sparkContext.broadcast(Lexicon(terms).parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts = _tables(), _received(sent.value)
        for batch in batches:
            for b in blocks(batch.column(0)):
                w = Words(batch.column(0).slice(b.first, b.n), tables)
                word, _, edits = Lexicon.read(parts, w)
                found = {w.text(i) for i, e in zip(word, edits, strict=True) if e}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), type=pa.string())], names=["word"])

    return [r[0] for r in sample.where("label = 0").select("text").mapInArrow(run, "word string").distinct().orderBy("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The lexicon, the exceptions and the weights of the sums, from a bounded sample of labelled documents.

    One half of the sample gives the lexicon and the exceptions by which the other half's sums are taken, so the fit sees
    them on texts that they don't come from.
    """
    sample = training_sample(docs, labels, id_col, text_col, label_col).withColumn("half", F.pmod(F.crc32(F.md5(F.col("text").cast("binary")).cast("binary")), F.lit(2))).persist()
    try:
        first, second = sample.where("half = 0").select("text", "label"), sample.where("half = 1").select("text", "label")
        terms, weights = learn_lexicon(first)
        model = {"terms": terms, "weights": weights, "allowed": _near_words(first, terms) if terms else [], "sums": None}
        features = second.mapInArrow(_runner(docs.sparkSession, model, "label", pa.int32()), "features array<double>, label int")
        model["sums"] = fit_logistic(features, intercept=True)
        model["allowed"] = _near_words(sample.select("text", "label"), terms) if terms else []
        return model
    finally:
        sample.unpersist()


def _runner(spark: SparkSession, model: dict, other: str, other_type: pa.DataType):
    """A mapInArrow function from (text, other) to (features, other), or (other, score, predicted) once sums are fitted.

    The automata are built once and sent to all tasks; each has at most STATES states.
    """
    sent = spark.sparkContext.broadcast(Lexicon(model["terms"]).parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts = _tables(), _received(sent.value)
        weights, allowed = np.array(model["weights"] or [0.0]), set(model["allowed"])
        for batch in batches:
            for b in blocks(batch.column(0)):
                x = window_sums(Words(batch.column(0).slice(b.first, b.n), tables), parts, weights, allowed)
                given = batch.column(1).slice(b.first, b.n).cast(other_type)
                if model["sums"] is None:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float64())), given], names=["features", other])
                else:
                    p = 1 / (1 + np.exp(-np.clip((x * np.array(model["sums"][0])).sum(axis=1) + model["sums"][1], -500, 500)))
                    yield pa.RecordBatch.from_arrays([given, pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=[other, "score", "predicted"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: score is between 0 and 1, predicted is 1 from 0.5 on.

    Null and empty texts have no hits and get the score of a text without any.  Without labels of both kinds every score
    is 0.  Rows with a null id and repeated rows are scored like others; an empty table gives an empty result; other
    columns are ignored.
    """
    model = model | {"sums": model["sums"] or ([0.0] * 6, -500.0)}
    kind = docs.schema[id_col].dataType
    run = _runner(docs.sparkSession, model, id_col, to_arrow_type(kind))
    return docs.select(text_col, id_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
