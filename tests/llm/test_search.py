"""Lexical search, hard negatives and language identification on awkward rows and against brute force."""

import math
import os
import random
import re
import sys
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from morphlake.llm import audio, common, hard_negatives, language_id, language_model, lexical_search, pii, toxicity, urls
from tests.llm.test_operators import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, first):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:first], 1)]
    return sorted(map(repr, out))


def test_search_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(k, prose(k % 40, rnd.randint(1, 60))) for k in range(160)]
    docs += [(200, ""), (201, None), (202, "!! --"), (203, "Ünï-cødé τέλος ünï"), (204, prose(1, 9000)), docs[3], docs[3], (None, docs[5][1]), (-7, docs[5][1]), (205, "RARE rare word")]
    items = [(1, prose(2, 12)), (2, "the ünï Τέλος rare"), (3, ""), (4, None), (5, "!!"), (6, "nowhere"), (1, prose(2, 12)), (1, prose(9, 3)), (None, "rare"), (7, " ".join(f"w{k}" for k in range(70)) + " " + prose(4, 90))]
    given = spark.createDataFrame([(i, t, 0, "x", 5, 1) for i, t in docs], "doc_id long, text string, no int, terms string, score int, id int")
    asked = spark.createDataFrame([(i, t, 3, 4) for i, t in items], "item_id long, text string, rank int, item int")
    want = brute_search(docs, [x for x in items if x[1] is not None], 5)
    got = lexical_search.search(given, asked, first=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    # Small blocks, few cells at once and no broadcast give the same.
    for name, value in (("INDEX_DOCS", 7), ("CELLS", 64), ("STEP", 2), ("ITEMS", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "CELL_BLOCKS", 2)
    assert sorted(map(repr, map(tuple, lexical_search.search(given, asked, first=5).collect()))) == want
    none = spark.createDataFrame([], given.schema)
    assert lexical_search.search(none, asked).count() == 0 == lexical_search.search(given, asked.where("false")).count()


def test_masks_of_many_terms():
    rnd = np.random.default_rng(1)
    has = rnd.random((130, 50)) < 0.3
    slot, place = np.nonzero(has)
    masks = lexical_search.masks_of(slot, place, 130, 50)
    assert masks.shape == (50, 3)
    for d in range(50):
        assert {t for t in range(130) if int(masks[d, t // 64]) >> (t % 64) & 1} == set(np.flatnonzero(has[:, d]).tolist())


@pytest.mark.parametrize(("size", "largest"), [(1, 3), (64, 200), (7, 1 << 12), (40, 1 << 22), (3, (1 << 23) - 1)])
def test_packed_products_are_exact(size, largest):
    rnd = np.random.default_rng(size)
    a, b = rnd.integers(-largest, largest + 1, (9, size)), rnd.integers(-largest, largest + 1, (13, size))
    assert (hard_negatives.products(a, b) == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]).all()
    assert (hard_negatives.products(np.full((2, size), largest), np.full((3, size), -largest)) == -size * largest * largest).all()


def brute_negatives(rows, n_positives, n_negatives):
    """rows: (id, label, components)."""
    rows = sorted(set(rows))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, label, x in rows:
        if i % 100:
            continue
        scored = sorted({(-dot(x, y), j, own == label) for j, own, y in rows if j != i})
        positives = [(j, -s) for s, j, same in scored if same][:n_positives]
        for j, p in positives:
            fit = sorted({(s, k) for s, k, same in scored if not same and 30 * p <= -100 * s <= 90 * p})[:n_negatives]
            out |= {(i, j, rank, k, p, -s) for rank, (s, k) in enumerate(fit, 1)}
    return out


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    vector = lambda n=6: [rnd.choice([-0.5, -0.25, 0.0, 0.125, 0.5, 1.0]) for _ in range(n)]
    rows = [(k, vector(), k % 3) for k in range(0, 400)] + [(k, vector(3), 1) for k in range(400, 410)] + [(k, [], 2) for k in (500, 501)]
    rows += [rows[7], rows[100], rows[8], (600, [0.25] * 6, 2), (601, [0.25] * 6, 2), (602, [100000.0, -1e30, 0.5, 0.0, 0.0, 0.0], 0)]
    bad = [(700, None, 1), (None, vector(), 1), (800, vector(), None), (900, [float("nan")] * 6, 1), (1000, [float("inf"), *vector(5)], 1), (1100, [None, *vector(5)], 1)]
    table = spark.createDataFrame([(i, v, y, 1, 2, "x") for i, v, y in rows + bad], "vec_id long, embedding array<float>, label int, id int, g int, components string")
    usable = hard_negatives.usable(table)
    cut = lambda v: max(-hard_negatives.LARGEST, min(hard_negatives.LARGEST, math.floor(256 * float(np.float32(v)))))
    plain = [(i, y, tuple(cut(x) for x in v)) for i, v, y in rows]
    assert usable.count() == len(plain)
    want = brute_negatives(plain, 5, 10)
    anchor = F.pmod("id", F.lit(100)) == 0
    assert len(want) > 100
    got = hard_negatives.mine(usable, anchor)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    for name, value in (("ANCHORS", 2), ("BLOCK_ROWS", 16), ("BLOCK_COMPONENTS", 90)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "CELL_BLOCKS", 2)
    assert {tuple(r) for r in hard_negatives.mine(usable, anchor, 3, 2).collect()} == brute_negatives(plain, 3, 2)
    assert hard_negatives.mine(usable.where("false"), anchor).count() == 0 == hard_negatives.mine(usable.where("id % 100 <> 0"), anchor).count()


SYLLABLES = {"xx": ["ka", "to", "mi", "ru", "shi"], "yy": ["sch", "ung", "ein", "ver", "heit"], "zz": ["ция", "про", "ста", "ние", "ого"]}


def made(lang, seed, n):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n)).capitalize()


def test_language_id(spark):
    rows = [(k, made(lang, k, 5 + k % 30), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 60)]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "123 ²½ -- 4", "zz"), (903, made("xx", 1, 4000), None), (904, "ka", "xx"), (905, "漢字", None), (None, rows[0][1], "xx"), rows[4], (906, made("yy", 7, 9).upper(), None)]
    table = lambda rs: spark.createDataFrame([(i, t, x, 1, 2.0, "x", 3) for i, t, x in rs], "doc_id long, text string, lang string, place int, score double, _text string, centroid int")
    model = language_id.fit(table(rows), per_language=20, n_centroids=3)
    assert sorted(set(model.languages)) == ["xx", "yy", "zz"] and len(model.languages) == 9
    got = language_id.predict(table(rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert sum(by_id[i].lang_pred == x for i, _, x in rows) == len(rows)
    assert [(by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) for i in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert (by_id[903].lang_pred, by_id[904].lang_pred, by_id[906].lang_pred, by_id[None].lang_pred) == ("xx", "xx", "yy", "xx")
    assert by_id[905].lang_pred in SYLLABLES and not by_id[905].accepted
    assert sum(by_id[i].accepted for i, _, _ in rows) > 0.6 * len(rows)
    again = language_id.predict(table(rows), language_id.fit(table(rows), per_language=20, n_centroids=3)).collect()
    assert {(r.doc_id, r.lang_pred) for r in again} == {(r.doc_id, r.lang_pred) for r in got if r.doc_id is not None and r.doc_id < 900}
    none = language_id.fit(table(odd[:1]))
    assert {(r.lang_pred, r.score) for r in language_id.predict(table(rows), none).collect()} == {("und", 0.0)}
    assert language_id.predict(table([]), model).count() == 0


def test_vectors_against_brute_force():
    from morphlake.llm.textops import blocks
    import pyarrow as pa

    texts = ["ab  c", "", "x1y", "ýß"]
    (b,) = blocks(pa.array(texts))
    counts = language_id.gram_counts(b)
    for text, row in zip(texts, counts, strict=True):
        data = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in text.encode())
        data = re.sub(rb" +", b" ", data)
        want = np.zeros(language_id.BUCKETS, dtype=np.int64)
        for k in language_id.ORDERS:
            for j in range(len(data) - k + 1):
                gram = k
                for c in data[j : j + k]:
                    gram = (gram << 8 | c) & 0xFFFFFFFF
                want[(gram * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        assert (row == want).all()


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k}", 1) for k in range(40)] + [(99, None, 1)], "i int, key string, n int")
    facts = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "key string, v int")
    for how in ("left", "inner"):
        got = sorted(map(repr, common.join_hot(rows, facts, "key", how).select("i", "key", "v").collect()))
        assert got == sorted(map(repr, rows.join(facts, "key", how).select("i", "key", "v").collect()))


def test_long_terms_and_long_urls(spark):
    import pyarrow as pa

    terms = ["x" * 20_000, "nitwit", "y" * 64, "y" * 65]
    parts = toxicity._received(toxicity.Lexicon(terms).parts)
    w = toxicity.Words(pa.array(["X" * 20_000 + " nitvit " + "y" * 66 + " " + "y" * 65 + " " + "x" * 19_999]), toxicity._tables())
    word, term, edits = toxicity.Lexicon.read(parts, w)
    assert list(zip(word.tolist(), term.tolist(), edits.tolist(), strict=True)) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 0)]
    long = "https://x.net/es/" + "/".join(f"w{k}" for k in range(60))
    pages = [(k, f"https://a{k % 7}.org/p{k % 9}/{k}") for k in range(500)] + [(1000 + k, long) for k in range(8)] + [(2000, long.replace("/es/", "/de/"))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(got) == len(pages) and got[1000].rule == "net/es/" and got[2000].verdict == "block" and len(got[2000].mined) == urls.LONGEST


def test_open_arrays_are_bounded(tmp_path):
    for k in range(300):
        language_model.put(str(tmp_path), f"a-{k}", np.arange(k + 1))
    language_model.put(str(tmp_path), "none", np.zeros(0, dtype=np.uint64))
    opened, before = language_model.Opened(str(tmp_path), 8, 1 << 20), len(os.listdir("/proc/self/fd"))
    for k in [*range(300), *range(299, -1, -1)]:
        assert opened[f"a-{k}"][-1] == k and len(opened.held) <= 8
    assert list(opened.held)[-1] == "a-0" and len(opened["none"]) == 0
    many = language_model.Opened(str(tmp_path), 1000, 1 << 20)
    assert [len(many[f"a-{k}"]) for k in range(300)] == list(range(1, 301)) and len(many.held) == 300
    assert sys.version_info < (3, 13) or len(os.listdir("/proc/self/fd")) < before + 20


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_window_sums(text, terms, weights, allowed):
    """The six sums of a text, word by word and character by character."""
    low = text.lower()
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
    hits = []
    for n, (a, b) in enumerate(found):
        near = min(((edit_distance(low[a:b], t), k) for k, t in enumerate(terms) if edit_distance(low[a:b], t) <= toxicity.edits_of(t)), default=None)
        if near and not (near[0] and low[a:b] in allowed):
            hits.append((n, *near))
    plain, wrong, quoted_hits, values = 0, 0, 0, []
    for n, edits, term in hits:
        a, b = found[n]
        window = range(max(0, n - toxicity.WINDOW), min(len(found), n + toxicity.WINDOW + 1))
        near = sum(m in window for m, _, _ in hits) - 1
        left, right = max(found[window[0]][0] - 1, 0), min(found[window[-1]][1] + 1, len(text))
        marks = toxicity.OPENING + toxicity.CLOSING + '"'
        around = any(c in marks for c in text[left:a]) and any(c in marks for c in text[b:right])
        inside = text[:a].count('"') % 2 == 1 or sum(c in toxicity.OPENING for c in text[:a]) > sum(c in toxicity.CLOSING for c in text[:a])
        quoted = around and inside
        values.append(weights[term] * (toxicity.MISSPELLED if edits else 1) * (toxicity.QUOTED if quoted else 1) * (1 + toxicity.CROWD * min(near, 4)))
        quoted_hits, plain, wrong = quoted_hits + quoted, plain + (not quoted and not edits), wrong + (not quoted and edits > 0)
    return [math.log1p(plain), math.log1p(wrong), math.log1p(quoted_hits), math.log1p(sum(values)), math.log1p(max(values, default=0)), min(1, sum(values) * 20 / max(len(found), 20))]


def test_window_sums_against_brute_force():
    import pyarrow as pa

    terms, weights, allowed = ["nitwit", "scoundrel", "oaf", "blockheaded"], np.array([1.5, 2.0, 0.5, 3.0]), {"nitwits"}
    rnd = random.Random(8)
    some = ["nitwit", "Nitvit", "nitwits", "scoundrel", "scoundrl", "oaf", "oat", "blockhaeded", "a", "word", '"', "“", "”", "«", "»", "Ünï", "x."]
    texts = ["", "nitwit", '"nitwit" he said', *(" ".join(rnd.choice(some) for _ in range(rnd.randint(1, 60))) for _ in range(60))]
    parts = toxicity._received(toxicity.Lexicon(terms).parts)
    got = toxicity.window_sums(toxicity.Words(pa.array(texts), toxicity._tables()), parts, weights, allowed)
    assert got == pytest.approx(np.array([brute_window_sums(t, terms, weights, allowed) for t in texts]))


def test_audio_features_against_brute_force():
    payload = bytes(np.random.default_rng(2).integers(0, 256, 640).astype(np.uint8)) + b"\x80" * 640 + bytes(range(256)) * 3 + b"\x80" * 256
    got = audio.analyse(audio.write_wave(payload))
    x = (np.frombuffer(payload, dtype=np.uint8).astype(float) - 128) / 128
    n = audio.TAPS * audio.UP
    h = np.array([np.sinc((k - (n - 1) / 2) / 4) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1))) * 3 / 4 for k in range(n)])
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    y = np.convolve(stuffed, h)[: len(stuffed)][:: audio.DOWN]  # zeros between the samples, a low-pass filter, every fourth value
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / (audio.FRAME - 1)) for k in range(audio.FRAME)])
    dft = np.exp(-2j * math.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    top = 2595 * math.log10(1 + 6000 / 700)
    edges = [700 * (10 ** (top * k / (audio.BANDS + 1) / 2595) - 1) for k in range(audio.BANDS + 2)]
    mels, energies = [], []
    for at in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        frame = y[at : at + audio.FRAME] * window
        power = np.abs(dft @ frame) ** 2
        bands = []
        for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
            total = 0.0
            for k, p in enumerate(power):
                hz = k * 12_000 / audio.FRAME
                total += p * max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid)))
            bands.append(math.log(total + 1e-6))
        mels.append(bands)
        energies.append(math.log(sum(v * v for v in frame) / audio.FRAME + 1e-6))
    flat = got.tensors.reshape(-1, audio.BANDS)
    assert flat[: len(mels)] == pytest.approx(np.array(mels), abs=1e-6) and not flat[len(mels) :].any()
    low, high = (min(energies) + part * (max(energies) - min(energies)) for part in (audio.LOW, audio.HIGH))
    ms, on, segments = audio.HOP / 12, False, []
    for k, e in enumerate([*energies, -math.inf]):
        if not on and e > high:
            on = True
            segments.append([k * ms])
        elif on and (e < low or k == len(energies)):
            on = False
            segments[-1].append(k * ms)
    assert len(segments) >= 2 and got.segments.tolist() == pytest.approx(np.array(segments))


def test_months_stay(spark):
    texts = ["Mr. May spoke. In May it rains.", "Mrs. Anna Smith left; Smith and ANNA came back on Monday."]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert re.fullmatch(r"Mr\. (?!May)\w+ spoke\. In May it rains\.", got[0])
    name, surname = re.match(r"Mrs\. (\w+) (\w+) left", got[1]).groups()
    assert got[1] == f"Mrs. {name} {surname} left; {surname} and {name.upper()} came back on Monday." and "Smith" not in got[1]


class Captured:
    """Takes the place of documents and keeps the functions that tasks would run."""

    def __init__(self):
        self.functions, self.sparkSession = [], MagicMock()

    def select(self, *_):
        return self

    agg = groupBy = select

    def first(self):
        return [0]

    def collect(self):
        return []

    def mapInArrow(self, function, _):
        self.functions.append(function)
        return self

    applyInArrow = mapInArrow


def test_language_model_tasks_take_little_memory(tmp_path, monkeypatch):
    """A task that counts or merges triples takes few bytes for each, and sends bounded values and batches."""
    docs, shards = Captured(), 2
    for name, value in (("F", MagicMock()), ("checkpoint_dir", lambda _: str(tmp_path)), ("partitions", lambda _: shards), ("count_words", lambda *_: (0, 0, [], []))):
        monkeypatch.setattr(language_model, name, value)
    language_model.train(docs)
    count, merge, _ = docs.functions
    size = language_model.TOKENS_AT_ONCE // 4
    monkeypatch.setattr(language_model, "TOKENS_AT_ONCE", size)
    draw = np.random.default_rng(0)
    words = np.array([f"w{k}" for k in range(20_000)])
    texts = pa.array([" ".join(words[(draw.pareto(0.8, 500) * 9).astype(np.int64) % len(words)]) for _ in range(2 * size // 500)])
    list(count(iter([pa.record_batch([texts.slice(0, 10)], names=["text"])])))  # tables that every worker has
    tracemalloc.start()
    try:
        rows = []
        for batch in count(iter([pa.record_batch([texts], names=["text"])])):
            assert batch.nbytes < 8 << 20
            rows += batch.filter(pa.compute.equal(batch.column("shard"), 0)).to_pylist()
            assert max(map(len, batch.column("counts").to_pylist())) < 1 << 18
            del batch
        held = sum(len(r["counts"]) for r in rows)
        assert tracemalloc.get_traced_memory()[1] - held < 112 * size
        group = pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("what", pa.string()), ("counts", pa.binary())]))
        rows.clear()
        n = held // 19
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        merge(group)
        assert tracemalloc.get_traced_memory()[1] - before < 95 * n
    finally:
        tracemalloc.stop()
