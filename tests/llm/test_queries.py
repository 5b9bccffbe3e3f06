"""The registered queries and the pipeline on small tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from morphlake.llm import decontaminate, learning, mixing, ngram_join, pii, quality, queries, urls
from tests.llm.test_operators import WORDS, prose, shingle_set

ITEM = prose(99, 25)


def spoilt(t):
    return " ".join(f"{w.upper()}!!" for w in t.split())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for k in range(240):
        bad, toxic = k % 4 == 0, k % 6 == 1
        text = spoilt(prose(k, 50)) if bad else prose(k, 50)
        docs.append((k, text + (" dreadful nitwit " + text[:30] + " nitwit scoundrel" if toxic else ""), f"s{k % 3}" if k % 7 else None))
        labels.append((k, int(not bad), int(toxic)))
    base = prose(1000, 60)
    docs += [(300, base, "s0"), (301, base.upper().lower(), "s1"), (302, base + " tail end", "s2"), (303, f"{prose(1001, 30)} {ITEM} {prose(1002, 9)}", "s0"), (304, f"{prose(1003, 40)} Mrs. Anna Smith, mail a.smith@x.org; Anna left", "s1"), (305, "", "s0"), (306, None, None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    turns = [(c, n, "user" if n % 2 == 0 else "assistant", f"turn {n} <|of {c}") for c in range(12) for n in range(c % 5 + 1)]
    spark.createDataFrame([*turns, (3, None, "assistant", "unnumbered"), (4, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    hosts = ("www.example.com", "a.example.com", "b.net", "c.org", "shop.c.org")
    pages = [(k, f"https://{hosts[k % 5]}/{'en' if k % 2 else 'es'}/{'offer' if k % 3 else 'news'}/{k}?id={k}", "") for k in range(200)] + [(900, None, ""), (901, "none", ""), (902, "x://HOST", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vectors = [(k, [((k * j) % 17 - 8) / 16 for j in range(1, 9)], k % 10) for k in range(230)] + [(300, None, 1), (400, [0.5] * 8, None), (500, [None] * 8, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize(("name", "column", "cut"), [("op2_quality", "quality", 0.3), ("op3_toxicity", "toxic", 0.5)])
def test_classifiers(spark, sf_dir, name, column, cut):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    assert set(got) == set(documents(spark, sf_dir))
    for i, r in got.items():
        assert r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [i for i in labels if fold(i, 5) == 0]
    assert len(held) > 30 and sum(got[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_chat_query(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in queries.QUERIES["op4_chat_preferences"](spark, sf_dir).collect()}
    assert set(got) == {t[0] for t in turns}

    def show(side):
        out, spans = "", []
        for _, role, text in side:
            start = len(out) + len(f"<|{role}|>\n")
            out += f"<|{role}|>\n" + text.replace("<|", "< |") + "<|end|>\n"
            spans += [f"{start}-{len(out)}"] if role == "assistant" else []
        return out, ";".join(spans)

    for c, r in got.items():
        mine = sorted(((n is not None, n or 0), role, text or "") for i, n, role, text in turns if i == c)
        numbers = sorted({n for i, n, role, _ in turns if i == c and role == "assistant" and n is not None})
        before = [text for i, n, role, text in turns if i == c and role == "assistant" and len(numbers) > 1 and n == numbers[-2]]
        stale = max([t for t in before if t is not None], default="")
        other = sorted((n, role, stale if role == "assistant" and numbers and n == (True, numbers[-1]) else text) for n, role, text in mine)
        same = 0
        while same < len(mine) and mine[same][1:] == other[same][1:]:
            same += 1
        assert (r.prompt, r.prompt_turns) == (show(mine[:same])[0], same)
        assert (r.chosen, r.chosen_spans) == show(mine[same:]) and (r.rejected, r.rejected_spans) == show(other[same:])


def test_url_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op5_url_filter"](spark, sf_dir).collect()}
    facts, labelled = {}, []
    for p in pages.collect():
        rest = p.url.split("://", 1)[1] if p.url and "://" in p.url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(h + q, v) for v, h, q in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        words = lambda kind, t, by: {kind + ("#" if x.isdigit() else x) for x in re.split(by, t) if x}
        asked = re.sub("=[^&]*", "", (re.search(r"\?([^#]*)", p.url or "") or ["", ""])[1])
        items = sorted(words("host:", host, r"\.") | words("path:", path, "[/._-]") | words("query:", asked, "&"))
        facts[p.page_id] = (host, path, rule, verdict, items)
        if verdict and items:
            labelled.append((items, verdict))
    rules = urls.mine(spark.createDataFrame(labelled, "items array<string>, verdict string")).collect()
    assert rules
    for i, (host, path, rule, verdict, items) in facts.items():
        fits = [r for r in rules if items and set(r.antecedent) <= set(items)]
        best = max(fits, key=lambda r: (r.confidence, len(r.antecedent), r.support, r.rule_id), default=None)
        want = verdict or (best.verdict if best else urls.DEFAULT)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, want)


def test_audio_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op7_audio"](spark, sf_dir).collect()}
    for i, d in documents(spark, sf_dir).items():
        raw = (d.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_language_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op13_language_id"](spark, sf_dir).collect()}
    for i, d in documents(spark, sf_dir).items():
        assert got[i].held_out == (fold(i, 3) == 1) and (got[i].lang_pred == "und") == (not d.text) and 0 <= got[i].score <= 1


def test_folds_of_language_model(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_model"](spark, sf_dir).collect()}
    docs = documents(spark, sf_dir)
    train = Counter(w for i, d in docs.items() if fold(i, 7) != 2 for w in [*WORDS.findall((d.text or "").lower()), ""])
    for i, d in docs.items():
        w = [*WORDS.findall((d.text or "").lower()), ""]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (fold(i, 7) == 2, len(w), sum(train[x] > 0 for x in w), sum(train.values()))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in queries.QUERIES["op2_quality"](spark, sf_dir).where("predicted = 1").collect()}
    kept = corpus_pipeline.good_quality(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    sets, root = {i: shingle_set(rows[i].text) for i in sorted(good)}, {}
    for i, s in sets.items():
        near = [root[j] for j in root if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j])]
        root[i] = min([i, *near])
    firsts = {i for i in root if root[i] == i}
    kept = corpus_pipeline.without_near_duplicates(spark, kept, sf_dir)
    assert {r.doc_id for r in kept.collect()} == firsts and {301, 302}.isdisjoint(firsts)
    clean = {i for i in firsts if decontaminate.normal(ITEM) not in decontaminate.normal(rows[i].text)}
    kept = corpus_pipeline.without_benchmark(spark, kept, sf_dir)
    assert {r.doc_id for r in kept.collect()} == clean and (303 in firsts) == (303 not in clean) == (303 in good)
    texts = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, kept, sf_dir).collect()}
    assert set(texts) == clean and {i for i in clean if texts[i] != rows[i].text} == {304} & clean
    assert 304 not in clean or not re.search("Anna|Smith|smith", texts[304])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == clean
    assert all(r.size == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size for r in out)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_columns_that_clash(spark):
    rows = [(k, prose(1, 40) if k % 2 else f"{prose(k, 20)} {ITEM}", "s", 1, 1, 1, 1, 1) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int, _gone int, _bad int, _text int, _copy int")
    bench = spark.createDataFrame([(1, ITEM, 5)], "item_id long, text string, gone int")
    assert sorted(r.doc_id for r in ngram_join.keep_first(df).collect()) == [0, 1, 2]
    kept = decontaminate.decontaminate(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == df.columns
    assert pii.pseudonymize(df).columns == df.columns and mixing.mix(df).count() == 4
    assert quality.keep_good(df, spark.createDataFrame([], "doc_id long, quality int")).columns == df.columns


@pytest.fixture(scope="module")
def many_labels(spark):
    """(documents, labels, ids of label 0): all of label 0 come after the first SAMPLE ids by digest."""
    ids = sorted((i for i in range(27_000) if fold(i, learning.FOLDS) != learning.HELD_OUT), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    bad = set(ids[learning.SAMPLE :])
    docs = spark.createDataFrame([(i, "SHOUTED!! WORDS!!" if i in bad else "some quiet words") for i in ids], "doc_id long, text string").repartition(8)
    return docs, spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int"), bad


def test_quality_learns_all_labels(spark, many_labels):
    docs, labels, bad = many_labels
    weights, _ = quality.fit(docs, labels)
    assert any(abs(w) > 0.1 for w in weights)
    examples = quality.training_examples(docs, labels, "doc_id", "text", "quality")
    assert examples.count() == docs.count() and quality.preference_pairs(examples).count() == learning.SAMPLE
    rnd = np.random.default_rng(2)
    for values in ([], [0.5], [2.0, 1.0], [1.0] * 9 + [2.0, 3.0], [*rnd.normal(size=500), *([0.25] * 200), 1e9, -1e-300]):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for share in (0.0, 0.3, 0.5, 0.77, 1.0):
            got, want = quality.quantile(df, "x", share), df.agg(F.percentile("x", F.lit(share))).first()[0]
            assert got == want or abs(got - want) <= 1e-12 * abs(want)


def test_pipeline_learns_all_labels(spark, many_labels, tmp_path):
    docs, labels, bad = many_labels
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert kept.where(F.col("text") == "some quiet words").count() == learning.SAMPLE == kept.count()


def test_pipeline_compiles_no_stages(spark, sf_dir, monkeypatch):
    key, docs = "spark.sql.codegen.wholeStage", spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, seen, kind = spark.conf.get(key), {}, type(docs)
    for name in ("checkpoint", "first", "isEmpty", "count", "collect", "toLocalIterator"):
        monkeypatch.setattr(kind, name, lambda self, *a, name=name, f=getattr(kind, name), **b: seen.setdefault(name, set()).add(spark.conf.get(key)) or f(self, *a, **b))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir)
        assert spark.conf.get(key) == before
    assert {"checkpoint", "first", "isEmpty", "count"} <= set(seen) and set().union(*seen.values()) == {"false"}
