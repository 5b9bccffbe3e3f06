"""The lexicon operators on a small hand-made lexicon."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from morphlake.functions import marks
from morphlake.functions.text import capitalize, is_lower, is_upper, like_case
from morphlake.operators import cases, clean, compat, compounds, lookups, stats, variants, words
from morphlake.schema import AUGMENTED
from morphlake.sources import lexicon_table, lexicon_text, marks_text, settings_text, words_text

NOUN = [f"{c}{n}{g}" for n in ("ET", "FT") for g in ("", "gr") for c in ("NF", "ÞF", "ÞGF", "EF")]
HEST = ("hestur", "hest", "hesti", "hests", "hesturinn", "hestinn", "hestinum", "hestsins", "hestar", "hesta", "hestum", "hesta", "hestarnir", "hestana", "hestunum", "hestanna")
BOK = ("bók", "bók", "bók", "bókar", "bókin", "bókina", "bókinni", "bókarinnar", "bækur", "bækur", "bókum", "bóka", "bækurnar", "bækurnar", "bókunum", "bókanna")


def entry(ord_, bin_id, ofl, bmynd, mark, hluti="alm", einkunn=1, birting="K", beinkunn=1, malsnid=""):
    return (ord_, bin_id, ofl, hluti, einkunn, malsnid, "", 0, birting, bmynd, mark, beinkunn, "", "", "")


@pytest.fixture(scope="module")
def lex(spark):
    rows = [entry("hestur", 1, "kk", f, m) for f, m in zip(HEST, NOUN, strict=True)] + [entry("hestur", 1, "kk", "hestinu", "ÞGFETgr2", beinkunn=2)]
    rows += [entry("bók", 2, "kvk", f, m) for f, m in zip(BOK, NOUN, strict=True)]
    rows += [entry("góður", 3, "lo", f, m) for f, m in (("góður", "FSB-KK-NFET"), ("góðan", "FSB-KK-ÞFET"), ("góðum", "FSB-KK-ÞGFET"), ("góði", "FVB-KK-NFET"), ("betri", "MST-KK-NFET"))]
    rows += [entry("lesa", 4, "so", f, m) for f, m in (("lesa", "GM-NH"), ("les", "GM-FH-NT-1P-ET"), ("lest", "GM-FH-NT-2P-ET"), ("las", "GM-FH-ÞT-1P-ET"), ("lesast", "MM-NH"), ("lesi", "GM-VH-NT-3P-ET"))]
    rows += [entry("Hestur", 5, "kk", "Hestur", "NFET", "örn"), entry("hesta", 6, "so", "hesta", "GM-NH", einkunn=2)]
    rows += [entry("maki", 7, "kk", f, m, birting="S") for f, m in (("maki", "NFET"), ("maka", "ÞFET"), ("maka", "ÞGFET"))]
    rows += [entry("leyndur", 8, "kk", "leyndur", "NFET", birting="G"), entry("nýr", 900, "kk", "nýr", "NFET")]
    rows += [entry("þýskur", 9, "lo", "þýsk", "FSB-KVK-NFET"), entry("saman", 10, "ao", "saman", "FST")]
    rows += [entry("á", 11, "kvk", "á", "NFET"), entry("Á", 12, "kvk", "Á", "NFET"), entry("b.", 13, "kk", "b.", "NFET"), entry("C", 14, "kk", "C", "NFET")]
    rows += [entry("gul", 15, "hk", "gul", "NFET"), entry("gul", 15, "hk", "guli", "ÞGFET"), entry("gulur", 16, "lo", "gul", "FSB-KVK-NFET"), entry("gulur", 16, "lo", "gulri", "FSB-KVK-ÞGFET")]
    order = [(o, m, k) for o in ("kk", "kvk", "hk") for k, m in enumerate(NOUN)] + [("lo", "FSB-KK-NFET", 0), ("lo", "FSB-KK-ÞFET", 1), ("lo", "FSB-KK-ÞGFET", 2)]
    order += [("so", m, k) for k, m in enumerate(("GM-NH", "GM-FH-NT-1P-ET", "GM-FH-NT-2P-ET", "GM-FH-ÞT-1P-ET", "MM-NH", "GM-VH-NT-3P-ET"))]
    template = [("legur", "FSB-KK-NFET", 0), ("lega", "FSB-KK-ÞFFT", 1), ("lega", "FVB-KK-ÞFET", 2)]
    parts = [("bókar", True, False), ("hest", True, True), ("hests", True, False), ("hestur", False, True), ("maki", False, True), ("bók", True, True), ("arhestur", False, False), ("góður", False, True)]
    return lookups.Lexicon(
        spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in ('bin_id', 'einkunn', 'millivisun', 'beinkunn') else 'string'}" for c in AUGMENTED)).persist(),
        900,
        spark.createDataFrame(order, "ofl string, mark string, pos int"),
        spark.createDataFrame(template, "ending string, mark string, seq int"),
        spark.createDataFrame(parts, "part string, is_prefix boolean, is_suffix boolean"),
    )


def asked(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "w string")


def few(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_text(spark):
    df = asked(spark, "abC dE", "", "12", "ÞÓR", "þór").select("w", capitalize(F.col("w")).alias("c"), is_lower(F.col("w")).alias("l"), is_upper(F.col("w")).alias("u"))
    assert few(df, "w", "c", "l", "u") == sorted([("abC dE", "Abc de", False, False), ("", "", False, False), ("12", "12", False, False), ("ÞÓR", "Þór", False, True), ("þór", "Þór", True, False)])
    assert asked(spark, "Á").select(like_case(F.lit("ás"), F.lit("ÁST")).alias("x")).first().x == "ÁS"


@pytest.mark.parametrize(("mark", "want"), [("ÞGFETgr", ["et", "gr", "þgf"]), ("EFET2", ["ef", "et"]), ("GM-FH-NT-3P-FT", ["3p", "fh", "ft", "gm", "nt"]), ("gmetp3", ["3p", "et", "gm"]), ("OP-ÞGF-GM", ["gm", "op", "þgf"]), ("EXPL", ["það"]), ("FST", None), ("xx", None)])
def test_atoms(spark, mark, want):
    assert asked(spark, mark).select(marks.atoms(F.col("w")).alias("a")).first().a == want
    if want is not None:
        assert marks.requested((mark,)) == want
    else:
        with pytest.raises(ValueError, match="unknown feature"):
            marks.requested((mark,))


def test_lookup_stages(spark, lex):
    got = lookups.lookup(asked(spark, "hestur", "HESTS", "fyndilegur", "fyndilega", "ógóður", "þýzk", "leyndur", "nýr", "maki", "", " ", "字", "872364"), lex)
    assert {(r.w, r.key, r.stage, r.bmynd, r.bin_id) for r in got.collect()} == {
        ("hestur", "hestur", 1, "hestur", 1),
        ("HESTS", "hests", 3, "hests", 1),
        ("fyndilegur", "fyndilegur", 4, "fyndilegur", 0),
        ("fyndilega", "fyndilega", 4, "fyndilega", 0),
        ("ógóður", "ógóður", 6, "ógóður", 3),
        ("þýzk", "þýsk", 7, "þýsk", 9),
    }
    assert few(got.where("w = 'fyndilega'"), "ofl", "mark") == [("ao", "OBEYGJANLEGT"), ("lo", "FSB-KK-ÞFFT"), ("lo", "FVB-KK-ÞFET")]


def test_sentence_start_and_upper(spark, lex):
    wanted = [("Hestur", True, False), ("hestur", False, True), ("á", False, True), ("b", False, True), ("c", False, True), ("heztur", False, True), ("óþekkt", False, True)]
    table = spark.createDataFrame(wanted, "w string, at_sentence_start boolean, auto_uppercase boolean")
    found = lookups.lookup(table, lex)
    got = found.orderBy("w", "rank").collect()
    of = lambda w: [(r.bmynd, r.key) for r in got if r.w == w]
    assert of("Hestur") == [("hestur", "Hestur"), ("Hestur", "Hestur")]
    assert of("hestur") == [("Hestur", "Hestur"), ("hestur", "Hestur")]
    assert of("b") == [("b.", "b.")] and of("á") == [("Á", "Á"), ("á", "Á")] and of("c") == []
    assert of("heztur") == of("hestur") and {r.stage for r in got if r.w == "heztur"} == {7}
    assert few(lookups.keys_of(asked(spark, "á", "b", "c", "óþekkt"), found, True), "w", "key") == [("b", "b."), ("c", "C."), ("á", "Á"), ("óþekkt", "Óþekkt")]
    start = lookups.lookup(asked(spark, "Hestur"), lex, at_sentence_start=True, add_compounds=False)
    assert [(r.bmynd, r.key) for r in start.orderBy("rank").collect()] == of("Hestur")


def test_order_and_classes(spark, lex):
    got = lookups.lookup(asked(spark, "hesta"), lex)
    assert [(r.ofl, r.mark) for r in got.orderBy("rank").collect()] == [("kk", "ÞFFT"), ("kk", "EFFT"), ("so", "GM-NH")]
    assert few(lookups.classes_of(got), "ofl") == [("kk",), ("so",)]
    assert few(lookups.lemma_entries(got), "ord", "ofl") == [("hesta", "so")]
    assert few(lookups.lemma_entries(lookups.lookup(asked(spark, "lesast"), lex)), "mark") == [("MM-NH",)]
    assert lookups.contains(asked(spark, "maki", "nýr", "x"), lex).where("found").count() == 2
    ids = spark.createDataFrame([(7,), (-100,), (900,), (1000000,)], "bin_id int")
    assert few(lookups.lookup_id(ids, lex), "bmynd", "rank") == [("maka", 2), ("maka", 3), ("maki", 1)]


def test_splits(spark, lex):
    got = few(compounds.splits(asked(spark, "bókarhestur", "hestur", "bókarmaki", "bókx"), lex.parts), "w", "parts")
    assert few(compounds.count_splits(asked(spark, "bókarhestur", "bókx", ""), lex.parts), "w", "ways") == [("bókarhestur", 2)]
    assert got == [("bókarhestur", ["bók", "arhestur"]), ("bókarhestur", ["bókar", "hestur"]), ("bókarmaki", ["bókar", "maki"]), ("hestur", ["hestur"])]
    assert few(compounds.best_split(asked(spark, "bókarhestur"), lex.parts), "parts") == [(["bókar", "hestur"],)]
    long = asked(spark, "hest" * 12 + "maki", "hest" * 12 + "x", "y" * 3000)
    want = [("hest" * 12 + "maki", ["hest"] * 12 + ["maki"])]
    assert few(compounds.splits(long, lex.parts), "w", "parts") == want == few(compounds.best_split(long, lex.parts), "w", "parts")


def brute_split(word, parts):
    """The best split, by listing all of them."""
    every, prefixes, suffixes = {p for p, _, _ in parts}, {p for p, x, _ in parts if x}, {p for p, _, x in parts if x}

    def ways(rest):
        if rest in every:
            return [[rest]]
        return [[rest[:k], *more] for k in range(1, len(rest)) if rest[:k] in every for more in ways(rest[k:])]

    for found in sorted(ways(word), key=lambda x: (-len(x[-1]), len(x))):
        if found[-1] in suffixes and all(p in prefixes for p in found[:-1]):
            return found
    return None


def test_lattice_counts_ways_that_no_row_could_hold(spark):
    parts = spark.createDataFrame([("a", True, False), ("aa", True, False), ("b", False, True)], "part string, is_prefix boolean, is_suffix boolean")
    fibonacci = [1, 1]
    while len(fibonacci) < 151:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    ways = {r.w: int(r.ways) for r in compounds.count_splits(asked(spark, "a" * 30 + "b", "a" * 150 + "b"), parts).collect()}
    assert ways == {"a" * n + "b": fibonacci[n] for n in (30, 150)}
    some = compounds.splits(asked(spark, "a" * 30 + "b"), parts, first=fibonacci[30] - 3, n=5).orderBy("number").collect()
    assert [len(r.parts) for r in some] == [17, 17, 16] and all("".join(r.parts) == "a" * 30 + "b" for r in some)
    best = compounds.best_splits(asked(spark, "aaab"), parts, 2).orderBy("place").collect()
    assert [r.parts for r in best] == [["a", "aa", "b"], ["aa", "a", "b"]]


def test_best_split_against_brute_force(spark):
    rnd = random.Random(4)
    for _ in range(3):
        parts = sorted({("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))), rnd.random() < 0.7, rnd.random() < 0.5) for _ in range(9)})
        parts = list({p[0]: p for p in parts}.values())
        ws = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 11))) for _ in range(120)})
        got = {r.w: r.parts for r in compounds.best_split(asked(spark, *ws), spark.createDataFrame(parts, "part string, is_prefix boolean, is_suffix boolean")).collect()}
        assert got == {w: s for w in ws if (s := brute_split(w, parts))}


def test_compounds(spark, lex):
    got = lookups.lookup(asked(spark, "bókarhestur", "BÓKARMAKI", "Stór-hestur", "minn hestur", "maki", "minn Stór-hestur", "stór-Hestur", "Bókargóður", "minn x"), lex)
    assert few(got, "w", "key", "stage", "ord", "bmynd", "bin_id") == sorted(
        [
            ("bókarhestur", "bókarhestur", 5, "bókar-hestur", "bókar-hestur", 0),
            ("BÓKARMAKI", "bókarmaki", 5, "bókar-maki", "bókar-maki", 0),
            ("Stór-hestur", "Stór-hestur", 5, "Stór-hestur", "Stór-hestur", 0),
            ("minn hestur", "minn hestur", 5, "minn hestur", "minn hestur", 0),
            ("minn Stór-hestur", "minn Stór-hestur", 5, "minn Stór-hestur", "minn Stór-hestur", 0),
            ("stór-Hestur", "stór-Hestur", 5, "stór-Hestur", "stór-Hestur", 0),
        ]
    )
    assert few(lookups.lookup(asked(spark, "Bókargóður"), lex, at_sentence_start=True), "key", "ofl") == [("bókargóður", "lo")]


def test_variants(spark, lex):
    got = variants.lookup_variants(asked(spark, "hestsins"), lex, "kk", ("NF", "FT", "nogr"))
    assert few(got, "bmynd", "mark") == [("hestar", "NFFT")]
    first = variants.lookup_variants(asked(spark, "hestinum"), lex, "no", ("EF",)).orderBy("rank").first()
    assert first.bmynd == "hestsins"
    assert few(variants.lookup_variants(asked(spark, "fyndilegur"), lex, "lo", ("MST",)), "bmynd", "mark") == [("fyndilegur", "FSB-KK-NFET")]
    assert variants.lookup_variants(asked(spark, "saman"), lex, "ao", ("MST",)).count() == 0
    near = variants.lookup_variants(asked(spark, "bókarhestsins"), lex, "kk", ("ÞGF", "gr"), bin_id=1)
    assert few(near, "bmynd", "rank", "distance", "stage") == []
    parts = lex.parts.unionByName(spark.createDataFrame([("hestsins", False, True)], "part string, is_prefix boolean, is_suffix boolean"))
    near = variants.lookup_variants(asked(spark, "bókarhestsins"), dataclasses.replace(lex, parts=parts), "kk", ("ÞGF", "gr"), bin_id=77)
    assert few(near, "bmynd", "rank", "distance", "stage") == [("bókar-hestinu", 3, 2, 5), ("bókar-hestinum", 1, 2, 5), ("bókar-hestunum", 2, 4, 5)]
    even = marks.by_tag(lex.rows, lambda m: m.endswith("gr"))
    assert few(variants.variants_raw(asked(spark, "hestur"), lex, "kk", ("ÞF",), keep=even), "bmynd") == []


def test_cases(spark, lex):
    assert few(cases.lookup_case(asked(spark, "hestur"), lex, "ÞGF"), "bmynd") == [("hesti",)]
    assert few(cases.lookup_case(asked(spark, "hestarnir"), lex, "ÞGF", singular=True, indefinite=True), "bmynd") == [("hesti",)]
    assert few(cases.lookup_forms(asked(spark, "hestur"), lex, "kk", "þf"), "bmynd") == [("hest",), ("hesta",), ("hestana",), ("hestinn",)]
    assert cases.lookup_forms(asked(spark, "hestur"), lex, "kk", "zz").count() == 0
    assert few(cases.raw_nominative(asked(spark, "hestum"), lex), "bmynd") == [("hestar",), ("hestarnir",), ("hestur",), ("hesturinn",)]
    preferences = spark.createDataFrame([("bók", "kvk", 2)], "form string, gender string, score int")
    got = cases.cast(asked(spark, "hesturinn", "Bækur", "góður", "HESTUR", "xyz", "bókarhestur", "gul", "Bókarhestur"), lex, "ÞGF", preferences)
    assert few(got, "w", "result") == sorted([("hesturinn", "hestinum"), ("Bækur", "Bókum"), ("góður", "góðum"), ("HESTUR", "HESTUR"), ("xyz", "xyz"), ("bókarhestur", "bókarhesti"), ("gul", "gulri"), ("Bókarhestur", "Bókarhesti")])
    assert few(cases.cast(asked(spark, "bókarhestur"), lex, "ÞGF", preferences, add_compounds=False), "result") == [("bókarhestur",)]
    second = cases.cast(asked(spark, "hesturinn"), lex, "ÞGF", preferences, order=[F.desc("bmynd")])
    assert few(second, "result") == [("hestinum",)] and few(cases.cast(asked(spark, "hesturinn"), lex, "ÞGF", preferences, order=[F.asc("bmynd")]), "result") == [("hestinu",)]


def test_compatible_view(spark, lex):
    view = compat.compatible_view(lex, spark.createDataFrame([("bók", "kvk", "alm")], "ord string, ofl string, hluti string"), spark.createDataFrame([("hestur", "kk", "dýr")], "ord string, ofl string, hluti string"))
    assert few(lookups.lookup(asked(spark, "leyndur", "bók", "nýr", "maki"), view), "w") == [("leyndur",), ("nýr",)]
    assert few(lookups.lookup(asked(spark, "hesti"), view), "hluti") == [("dýr",)]
    worse = spark.createDataFrame([("hesta", ["hesta"]), ("hestum", ["hestur"])], "form string, worse array<string>")
    none = spark.createDataFrame([], "ord string, ofl string, hluti string")
    view = compat.compatible_view(lex, none, none, worse)
    # The looked-up form decides, and a form without entries is a miss for its stage.
    assert few(lookups.lookup(asked(spark, "HESTA", "hestum"), view), "w", "ofl", "bmynd") == [("HESTA", "kk", "hesta"), ("HESTA", "kk", "hesta")]
    # Priority counts within a lookup: the capitalised entry comes first.
    upper = lookups.lookup(asked(spark, "hestur"), dataclasses.replace(view, preferences=None), auto_uppercase=True)
    assert [r.bmynd for r in upper.orderBy("rank").collect()] == ["Hestur", "hestur"]


def test_compatible_view_filters_raw_classes(spark, lex):
    rows = [entry("fyrstur", 21, "rt", "fyrsti", "KK-NFET"), entry("fyrstur", 21, "rt", "fyrsta", "KK-ÞGFET"), entry("tólf", 22, "to", "tólf", "OBEYGJANLEGT"), entry("sig", 23, "afn", "sér", "ÞGF")]
    none = spark.createDataFrame([], "ord string, ofl string, hluti string")
    view = compat.compatible_view(dataclasses.replace(lex, rows=lex.rows.unionByName(spark.createDataFrame(rows, lex.rows.schema))), none, none)
    assert few(lookups.lookup(asked(spark, "fyrsti", "tólf", "sér"), view), "w", "ofl", "mark") == [("fyrsti", "lo", "KK-NFET"), ("sér", "abfn", "ÞGF"), ("tólf", "töl", "-")]
    assert few(lookups.lookup(asked(spark, "ófyrsti"), view), "stage", "ord", "ofl") == [(6, "ófyrstur", "lo")]
    assert few(cases.lookup_case(asked(spark, "fyrsti"), view, "ÞGF", cat="rt"), "bmynd", "ofl") == [("fyrsta", "lo")]
    assert cases.lookup_case(asked(spark, "fyrsti"), view, "ÞGF", cat="lo").count() == 0
    preferences = spark.createDataFrame([], "form string, gender string, score int")
    assert few(cases.cast(asked(spark, "fyrsti"), view, "ÞGF", preferences), "result") == [("fyrsti",)]
    assert few(variants.lookup_variants(asked(spark, "tólf"), view, "to", ("obeygjanlegt",)), "ofl", "mark") == [("töl", "-")]
    assert variants.variants_raw(asked(spark, "fyrsti"), view, "lo", ("ÞGF",)).count() == 0


def test_requests_in_columns(spark, lex):
    ws = [("Hestur", True, False), ("Hestur", False, False), ("hestur", False, True), ("hestur", None, None), ("hestur", False, True)]
    table = spark.createDataFrame([(k, *w) for k, w in enumerate(ws)], "place int, w string, at_sentence_start boolean, auto_uppercase boolean")
    got = lookups.lookup_tokens(table, lex).orderBy("place", "rank").collect()
    assert [(r.place, r.bmynd) for r in got] == [(0, "hestur"), (0, "Hestur"), (1, "Hestur"), (2, "Hestur"), (2, "hestur"), (3, "hestur"), (4, "Hestur"), (4, "hestur")]
    wanted = [("hestsins", "kk", ["NF", "FT", "nogr"], None, None), ("hestsins", "kk", ["ÞGF", "ET"], None, 1), ("hestsins", "kk", ["ÞGF", "ET"], None, 2), ("hestsins", "no", ["NF_ET"], "bók", None), ("bókarhestur", "kk", ["ef"], None, 99), ("lesa", "so", ["p1", "ET"], None, None)]
    table = spark.createDataFrame(wanted, "w string, class string, features array<string>, lemma string, id int")
    got = variants.lookup_variants(table, lex)
    for w, c, f, lemma, i in wanted[1::2]:
        alone = few(variants.lookup_variants(asked(spark, w), lex, c, tuple(f), lemma, i), "bmynd", "mark", "rank", "stage")
        mine = got.where((F.col("w") == w) & (F.col("features") == F.array(*map(F.lit, f))) & F.col("lemma").eqNullSafe(F.lit(lemma)) & F.col("id").eqNullSafe(F.lit(i)))
        assert few(mine, "bmynd", "mark", "rank", "stage") == alone
    assert got.count() > 8
    with pytest.raises(Exception, match="unknown feature"):
        variants.lookup_variants(table.withColumn("features", F.array(F.lit("zz"))), lex).collect()
    table = spark.createDataFrame([("hestarnir", "ÞGF", True, True), ("hestarnir", "EF", False, False), ("bók", "ÞF", False, None)], "w string, case string, singular boolean, indefinite boolean")
    got = cases.lookup_case(table.fillna(False), lex)
    assert few(got, "w", "case", "bmynd") == [("bók", "ÞF", "bók"), ("hestarnir", "EF", "hestanna"), ("hestarnir", "ÞGF", "hesti")]
    preferences = spark.createDataFrame([], "form string, gender string, score int")
    got = cases.cast(asked(spark, "hestur", "xyz").withColumn("case", F.explode(F.array(F.lit("ÞF"), F.lit("EF")))), lex, None, preferences)
    assert few(got, "w", "case", "result") == [("hestur", "EF", "hests"), ("hestur", "ÞF", "hest"), ("xyz", "EF", "xyz"), ("xyz", "ÞF", "xyz")]


def test_bucketed_lexicon(spark, lex):
    name = lexicon_table.write_lexicon(lex.rows, lex.mark_order, 900, lex.template, buckets=4)
    again = lexicon_table.read_lexicon(spark, name, lex.parts)
    assert again.first_local_id == 900 and few(again.mark_order, "ofl", "mark", "pos") == few(lex.mark_order, "ofl", "mark", "pos") and few(again.template, "ending", "mark", "seq") == few(lex.template, "ending", "mark", "seq")
    assert few(lookups.lookup(asked(spark, "hesta", "fyndileg", "bókarhestur"), again), "w", "bmynd", "rank") == few(lookups.lookup(asked(spark, "hesta", "fyndileg", "bókarhestur"), lex), "w", "bmynd", "rank")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookups.base_plan(again)(asked(spark, "hesta").withColumn("key", F.col("w")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold") if before is None else spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_words(spark, lex):
    found = lookups.lookup(asked(spark, "bók", "xyz"), lex)
    firsts = words.first_entry(asked(spark, "bók", "xyz"), found)
    assert few(firsts, "w", "ofl", "mark", "bin_id") == [("bók", "kvk", "NFET", 2), ("xyz", "hk", "", 0)]
    assert few(words.format_words(firsts, lex, "þf-gr"), "w", "result") == [("bók", "bókina"), ("xyz", "xyz")]
    several = words.first_entry(asked(spark, "Bók", "HESTUR", "bókarhestur"), lookups.lookup(asked(spark, "Bók", "HESTUR", "bókarhestur"), lex))
    assert few(words.format_words(several, lex, "ef"), "w", "result") == [("Bók", "Bókar"), ("HESTUR", "HESTS"), ("bókarhestur", "bókarhests")]
    assert few(words.format_words(firsts.withColumn("spec", F.lit("")), lex), "w", "spec", "result") == [("bók", "", "bók"), ("xyz", "", "xyz")]
    assert few(words.wrap(lex.rows.where("bmynd = 'bókina'")), "w", "key", "ord", "bin_id") == [("bókina", "bókina", "bók", 2)]
    with pytest.raises(ValueError, match="unknown feature"):
        words.format_words(firsts, lex, "zz")


def test_reading_and_cleaning(spark, tmp_path, lex):
    (tmp_path / "a.csv").write_text("# note\n\nhestur;1;kk;alm;1;;,,X,,Y,;;K;hestur;NFET;1;;;\nhestur;1;kk;dýr;1;;;;K;hests;EFET2;1;;;\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("ný;0;kvk;alm;ný;NFET\nný;0;lo;alm;ný;NFET\nmaki;-1;kk;alm;maki;NFET\nhestur;1;kk;alm;hesti;ÞGFET\n", encoding="utf-8")
    rows = lexicon_text.read_lexicon(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert few(rows, "bmynd", "bin_id", "birting", "ofl") == sorted([("hestur", 1, "K", "kk"), ("hests", 1, "K", "kk"), ("ný", 2000, "", "kvk"), ("ný", 2000, "", "lo"), ("maki", 2001, "S", "kk"), ("hesti", 1, "G", "kk")])
    assert rows.where("bmynd = 'hestur'").first().malfraedi == "X,Y"
    assert few(lexicon_text.suffix_rows(lexicon_text.parse(lexicon_text.read_lines(spark, str(tmp_path / "b.csv")))), "bmynd") == [("maki",)]
    (tmp_path / "marks.csv").write_text("# note\nkk;NFET\nkk;ÞFET\nso;GM-NH\n", encoding="utf-8")
    assert few(marks_text.read_marks(spark, str(tmp_path / "marks.csv")), "ofl", "mark", "pos") == [("kk", "NFET", 0), ("kk", "ÞFET", 1), ("so", "GM-NH", 0)]
    odd = [("Norður-Landeyjar", 488593, "Norð-vesturlandeyjum"), ("árekstrarvörn", 540745, "x"), ("árekstrarvörn", 540745, "árekstrarvörnttt"), ("sem að", 495372, "sem að"), ("illinnheimtanlegur", 509831, "innheimtanlegur"), ("hestur", 1, "num")]
    odd = spark.createDataFrame(odd, "ord string, bin_id int, bmynd string")
    fixed = clean.repair(clean.required(odd, clean.STOP_FORMS), clean.known_repairs(spark))
    assert few(fixed, "ord", "bmynd", "exempt") == [("Norður-Landeyjar", "Norðurlandeyjum", False), ("illinnheimtanlegur", "illinnheimtanlegur", False), ("sem", "sem", False), ("árekstrarvörn", "árekstrarvörnttt", True)]
    repairs = spark.createDataFrame([("maki", 2001, "prefix", "hjú", None)], "ord string, bin_id int, kind string, a string, b string")
    done = clean.clean(rows.where("ofl <> 'lo'"), lex.mark_order, repairs)
    assert few(done, "bmynd", "hluti") == sorted([("hestur", "alm"), ("hests", "alm"), ("hesti", "alm"), ("hjúmaki", "alm"), ("ný", "alm")])
    bad = spark.createDataFrame([(0, 1, "a;b;c")], "file_no int, line_no long, line string")
    with pytest.raises(Exception, match="15 or 6"):
        lexicon_text.parse(bad).collect()
    with pytest.raises(Exception, match="unknown class"):
        clean.legal_marks(rows.withColumn("ofl", F.lit("zz")), lex.mark_order).collect()
    lines = spark.createDataFrame([(" a ",), ("",), ("x" * 70,), ("b_c",), ("d",)], "line string")
    assert few(words_text.legal_words(words_text.remove_words(words_text.read_words(lines), spark.createDataFrame([("d",)], "word string"))), "word") == [("a",)]


def test_statistics(spark, lex):
    assert few(stats.paradigm_forms(lex.rows.where("bin_id = 7")), "forms") == [("maka",)]
    assert stats.summary(lex.rows).first().n_lemmas == 17
    assert few(stats.lemmas_by_class(lex.rows.where("bin_id < 5")), "ofl", "n") == [("kk", 1), ("kvk", 1), ("lo", 1), ("so", 1)]


def test_settings(spark, tmp_path):
    (tmp_path / "more.conf").write_text("[noun_preferences]\ná hk < kvk\ná kk < hk\n[stem_preferences]\nára ár árr < \\\n ára\n", encoding="utf-8")
    (tmp_path / "main.conf").write_text("# note\n[adjective_template]\nlegur FSB-KK-NFET # trailing\n$include more.conf\n", encoding="utf-8")
    got = settings_text.read_settings(spark, tmp_path / "main.conf")
    assert few(got["adjective_template"], "ending", "mark", "seq") == [("legur", "FSB-KK-NFET", 0)]
    assert few(got["noun_preferences"], "form", "gender", "score") == [("á", "hk", -2), ("á", "kk", -6), ("á", "kvk", 2)]
    assert few(got["stem_preferences"], "form", "worse", "better") == [("ára", ["ár", "árr"], ["ára"])]
    (tmp_path / "bad.conf").write_text("[bin_errata]\none two\n", encoding="utf-8")
    with pytest.raises(settings_text.SettingsError, match="line 2"):
        settings_text.read_settings(spark, tmp_path / "bad.conf")
