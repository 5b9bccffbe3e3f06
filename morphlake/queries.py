"""Registered queries over the derived lexicon (plans/derived.py), each with the SQL that must give the same rows."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.functions import marks, text
from morphlake.operators import cases, clean, compat, compounds, lookups, stats, variants, words
from morphlake.plans import derived
from morphlake.schema import AUGMENTED, BASIC
from morphlake.sources import lexicon_text, settings_table, words_text
from morphlake.storage import numbered, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ALL = ", ".join(AUGMENTED)
FEW = ", ".join(BASIC)
PENALTY = "(einkunn <> 1)::INT + (beinkunn <> 1)::INT"
ORDER = f"{PENALTY}, bin_id, coalesce(pos, 9999), f.ofl, bmynd, f.mark, ord, hluti, einkunn, malsnid, malfraedi, millivisun, birting, beinkunn"
ORDER_ALL = ORDER.removeprefix(f"{PENALTY}, ")
POS = "LEFT JOIN mark_order m ON m.ofl = f.ofl AND m.mark = f.mark"
MADE = "made(einkunn, malsnid, malfraedi, millivisun, birting, beinkunn, bmalsnid, bgildi, aukafletta, distance) AS (VALUES (1, '', '', 0, 'G', 1, '', '', '', NULL::INT))"
#: What a spelling k is found as: rows of the lexicon, for the parts of compounds (suffix rows too) and elsewhere.
PLAIN = f"rows_of AS MATERIALIZED (SELECT bmynd AS k, 0 AS r, {ALL}, NULL::INT AS distance FROM shown)"


def _parts_sql(p: str, source: str) -> str:
    """Tables p_cut (w, k, s, words, before, hyphen, core) and p_5 (w, key, fields) of the compounds of source (w, k, s).

    w names the request, k is its word, s: at the start of a sentence, u: auto-uppercase, r: which rows it may find, id: the
    only id that it may find but for compounds, lemma: the only lemma, if any.
    """
    rest = "CASE WHEN contains(k, ' ') THEN string_split(k, ' ')[-1] ELSE k END"
    ofl = "CASE WHEN core <> lower(core) AND NOT (s AND words = '' AND NOT hyphen) THEN ofl IN ('kk', 'kvk', 'hk') ELSE ofl IN ('so', 'kk', 'hk', 'kvk', 'lo') END"
    inner = lambda c: f"CASE WHEN prefix = '' THEN {c} ELSE prefix || '-' || {c} END"
    title = "CASE WHEN core[1] <> lower(core[1]) AND core[2:] = lower(core[2:]) AND core[2:] <> upper(core[2:]) THEN upper(x[1]) || lower(x[2:]) ELSE x END"
    behind = lambda c: f"words || CASE WHEN before = '' THEN {c} ELSE before || '-' || {title.replace('x', c) if c in ('o', 'b') else c} END"
    return f"""{p}_rest AS (SELECT w, k, s, r, lemma, CASE WHEN contains(k, ' ') THEN left(k, length(k) - length({rest})) ELSE '' END AS words, {rest} AS rest FROM {source}),
{p}_cut AS MATERIALIZED (SELECT *, CASE WHEN hyphen THEN left(rest, length(rest) - length(string_split(rest, '-')[-1]) - 1) ELSE '' END AS before, CASE WHEN hyphen THEN string_split(rest, '-')[-1] ELSE rest END AS core FROM (SELECT *, contains(rest, '-') AND NOT ends_with(rest, '-') AS hyphen FROM {p}_rest)),
{p}_cores AS (SELECT DISTINCT c FROM (SELECT core AS c FROM {p}_cut UNION SELECT lower(core) FROM {p}_cut) WHERE c <> ''),
{p}_t(c, ps, rest) AS (SELECT c, []::VARCHAR[], c FROM {p}_cores UNION ALL SELECT c, list_append(ps, part), substr(rest, length(part) + 1) FROM (SELECT c, ps, rest, unnest(range(1, length(rest))) AS n FROM {p}_t ANTI JOIN parts whole ON whole.part = rest) x JOIN parts ON part = left(rest, n) AND is_prefix),
{p}_cuts AS MATERIALIZED (SELECT c, list_append(ps, rest) AS ps FROM {p}_t JOIN parts ON part = rest),
{p}_best AS MATERIALIZED (SELECT * FROM (SELECT c, ps, row_number() OVER (PARTITION BY c ORDER BY length(ps[-1]) DESC, len(ps), list_transform(ps, lambda q: length(q))) AS n FROM {p}_cuts JOIN parts ON part = ps[-1] AND is_suffix) WHERE n = 1),
{p}_split AS (SELECT x.*, CASE WHEN len(a.ps) > 1 OR core = lower(core) THEN a.ps ELSE b.ps END AS ps, NOT coalesce(len(a.ps) > 1 OR core = lower(core), false) AND len(b.ps) > 1 AS lowered FROM {p}_cut x LEFT JOIN {p}_best a ON a.c = core LEFT JOIN {p}_best b ON b.c = lower(core)),
{p}_in AS (SELECT w, s, words, before, hyphen, rest, core, CASE WHEN lowered THEN lower(core) ELSE core END AS own, array_to_string(ps[:-2], '-') AS prefix, f.* FROM {p}_split JOIN rows_of f ON f.k = ps[-1] AND f.r = {p}_split.r AND ({p}_split.lemma IS NULL OR f.ord = {p}_split.lemma) WHERE ps IS NOT NULL AND (len(ps) > 1 OR birting <> 'S') AND {ofl}),
{p}_mid AS (SELECT *, {inner("ord")} AS o, {inner("bmynd")} AS b FROM {p}_in),
{p}_5 AS MATERIALIZED (SELECT w, words || CASE WHEN hyphen THEN rest ELSE own END AS key, {", ".join({"ord": behind("o") + " AS ord", "bmynd": behind("b") + " AS bmynd", "bin_id": "CASE WHEN prefix = '' AND before = '' AND words = '' THEN bin_id ELSE 0 END AS bin_id"}.get(x, x) for x in AUGMENTED)}, distance FROM {p}_mid)"""


def _pass_sql(p: str, source: str) -> str:
    """Tables p_1 to p_6 (w, key, fields, distance): the stages of source (w, k, s, u, r, id, lemma), each for what missed before."""
    legur = f"SELECT w, k AS key, left(lower(k), length(k) - length(ending)) || 'legur' AS ord, 0 AS bin_id, 'lo' AS ofl, 'alm' AS hluti, lower(k) AS bmynd, mark FROM {p}_m3 JOIN template ON ends_with(lower(k), ending) AND length(k) > length(ending) WHERE contains(lower(k), 'leg') UNION ALL SELECT w, k, lower(k), 0, 'ao', 'alm', lower(k), 'OBEYGJANLEGT' FROM {p}_m3 WHERE ends_with(lower(k), 'lega') AND length(k) > 4"
    miss = lambda a, b: f"{p}_m{b} AS MATERIALIZED (SELECT w, k, s, u, r, id, lemma FROM {a} ANTI JOIN {p}_{b} USING (w))"
    also = "r.r = x.r AND (x.id IS NULL OR r.bin_id = x.id) AND (x.lemma IS NULL OR r.ord = x.lemma)"
    return f"""{p}_own AS MATERIALIZED (SELECT w, x.k AS key, {ALL}, distance FROM {source} x JOIN live r ON r.k = x.k AND {also}),
{p}_cased AS MATERIALIZED (SELECT *, u AND k = lower(k) AND k <> upper(k) AS small, w IN (SELECT w FROM {p}_own) AS there FROM {source}),
{p}_2 AS MATERIALIZED (SELECT w, upper(x.k[1]) || lower(x.k[2:]) AS key, {ALL}, distance FROM {p}_cased x JOIN live r ON r.k = upper(x.k[1]) || lower(x.k[2:]) AND {also} WHERE small AND (length(x.k) > 1 OR there)),
{p}_1 AS MATERIALIZED (SELECT o.* REPLACE (coalesce(t.key, o.key) AS key) FROM {p}_own o LEFT JOIN (SELECT DISTINCT w, key FROM {p}_2) t USING (w)),
{miss(source, 1)},
{miss(p + "_m1", 2)},
{p}_low AS (SELECT w, k, r, id, lemma, CASE WHEN u AND k = lower(k) AND k <> upper(k) AND length(k) = 1 THEN k || '.' ELSE lower(k) END AS low FROM {p}_m2),
{p}_3 AS MATERIALIZED (SELECT w, low AS key, {ALL}, distance FROM {p}_low x JOIN live r ON r.k = low AND {also} WHERE low <> x.k),
{p}_0 AS MATERIALIZED (SELECT w, x.k AS key, {ALL}, distance FROM {p}_cased x JOIN live r ON r.k = lower(x.k) AND {also} WHERE s AND there AND lower(x.k) <> x.k),
{miss(p + "_m2", 3)},
{p}_4 AS MATERIALIZED (SELECT w, key, {ALL}, distance FROM ({legur}), made),
{miss(p + "_m3", 4)},
{_parts_sql(p, p + "_m4")},
{miss(p + "_m4", 5)},
{p}_6 AS MATERIALIZED (SELECT w, x.k AS key, {ALL.replace("ord", "'ó' || ord AS ord").replace("bmynd", "'ó' || bmynd AS bmynd")}, distance FROM {p}_m5 x JOIN live r ON r.k = substr(lower(x.k), 2) AND {also} WHERE lower(x.k) LIKE 'ó_%' AND ofl = 'lo'),
{miss(p + "_m5", 6)}"""


#: Requests (w, k, s, u, r, id, lemma) of all words without options.
ASKED = "SELECT w, w AS k, false AS s, false AS u, 0 AS r, NULL::INT AS id, NULL::VARCHAR AS lemma FROM words"


def _cascade_sql(base: str = PLAIN, first: str = "", asked: str = ASKED, order: str = ORDER) -> str:
    """The cascade over requests: found has (w, key, stage, source, rank, fields, distance); first: what orders entries of a source first."""
    stages = {0: (3, -1), 1: (1, 0), 2: (2, -1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    rows = lambda p, stage: " UNION ALL ".join(f"SELECT w, key, {stage or n} AS stage, {source} AS source, {ALL}, distance FROM {p}_{t}" for t, (n, source) in stages.items())
    return f"""{base}, live AS (SELECT * FROM rows_of WHERE birting <> 'S'), {MADE},
asked AS MATERIALIZED ({asked}),
{_pass_sql("s", "asked")},
again AS MATERIALIZED (SELECT w, replace(replace(k, 'tzt', 'st'), 'z', 's') AS k, s, u, r, id, lemma FROM s_m6 WHERE contains(k, 'z') AND NOT (length(k) = 1 AND u)),
{_pass_sql("z", "again")},
every AS ({rows("s", 0)} UNION ALL {rows("z", 7)}),
found AS MATERIALIZED (SELECT f.*, row_number() OVER (PARTITION BY w ORDER BY source, {first}{order}) AS rank FROM every f {POS})"""


CASCADE = _cascade_sql()


def register(name: str, sql: str | None = None, cascade: bool | str = False):
    """Register a query; sql comes after the derived tables, and the cascade's (of plain words, or its own SQL) where asked."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {derived.SQL}{', ' + (CASCADE if cascade is True else cascade) if cascade else ''}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"
        return f

    return put


def _words_and_lexicon(spark: SparkSession, sf_dir: str):
    lex = derived.lexicon(spark, sf_dir)
    return derived.query_words(spark, sf_dir), lex


def _found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    asked, lex = _words_and_lexicon(spark, sf_dir)
    return lookups.lookup(asked, lex, **options)


def _ids(lex: lookups.Lexicon) -> DataFrame:
    return lex.rows.select("bin_id").distinct()


def _lines(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return numbered(rows, ["bin_id", "bmynd", "mark"], "line_no").select(F.lit(0).alias("file_no"), "line_no", F.concat_ws(";", *[F.col(c).cast("string") for c in fields]).alias("line"))


# Sources.
@register("load_augmented", f"SELECT {ALL} FROM lexicon")
def load_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_text.parse(_lines(derived.lexicon_rows(spark, sf_dir), AUGMENTED)).select(*AUGMENTED)


@register("load_basic", "SELECT ord, bin_id, ofl, hluti, 0 AS einkunn, '' AS malsnid, '' AS malfraedi, 0 AS millivisun, '' AS birting, bmynd, mark, 0 AS beinkunn, '' AS bmalsnid, '' AS bgildi, '' AS aukafletta FROM lexicon")
def load_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_text.parse(_lines(derived.lexicon_rows(spark, sf_dir), BASIC)).select(*AUGMENTED)


def _two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon, then its odd ids again as unnumbered basic rows (-1 for every third)."""
    rows = derived.lexicon_rows(spark, sf_dir)
    again = _lines(rows.where("bin_id % 2 = 1"), BASIC).withColumn("file_no", F.lit(1))
    unnumbered = F.transform(F.split("line", ";"), lambda x, i: F.when(i == 1, F.when(x.cast("int") % 3 == 0, "-1").otherwise("0")).otherwise(x))
    again = again.withColumn("line", F.array_join(unnumbered, ";"))
    return lexicon_text.parse(_lines(rows, AUGMENTED).unionByName(again))


TWO_FILES = """u AS (SELECT *, row_number() OVER (ORDER BY bin_id, bmynd, mark) AS line_no FROM lexicon WHERE bin_id % 2 = 1),
v AS (SELECT *, sum(CASE WHEN ord <> before THEN 1 ELSE 0 END) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS step FROM (SELECT *, lag(ord) OVER (ORDER BY line_no) AS before FROM u)),
both_files AS (SELECT 0 AS file_no, ord, bin_id, birting, bmynd, mark FROM lexicon UNION ALL SELECT 1, ord, CAST((SELECT (max(bin_id) + 1999) // 1000 * 1000 FROM lexicon) + step AS INTEGER), CASE WHEN bin_id % 3 = 0 THEN 'S' ELSE '' END, bmynd, mark FROM v)"""


@register("load_union", TWO_FILES + " SELECT file_no, ord, bin_id, birting, bmynd, mark FROM both_files")
def load_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_text.allocate_ids(_two_files(spark, sf_dir)).select("file_no", "ord", "bin_id", "birting", "bmynd", "mark")


@register("alloc_ids", TWO_FILES + " SELECT file_no, ord, bin_id, bmynd, mark FROM both_files")
def alloc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_text.allocate_ids(_two_files(spark, sf_dir)).select("file_no", "ord", "bin_id", "bmynd", "mark")


@register("tag_birting", TWO_FILES + " SELECT file_no, birting, count(*) AS n FROM both_files GROUP BY ALL")
def tag_birting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_text.allocate_ids(_two_files(spark, sf_dir)).groupBy("file_no", "birting").agg(F.count(F.lit(1)).alias("n"))


@register("norm_malfraedi", "SELECT w, trim(regexp_replace(',,' || replace(w, 'e', ',') || ',', ',,+', ',', 'g'), ',') AS malfraedi FROM doc_words")
def norm_malfraedi(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = derived.document_words(spark, sf_dir)
    return w.select("w", lexicon_text.commas(F.concat(F.lit(",,"), F.replace("w", F.lit("e"), F.lit(",")), F.lit(","))).alias("malfraedi"))


@register("load_parts", "SELECT part AS word FROM parts WHERE length(part) < 64")
def load_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.lexicon(spark, sf_dir).parts
    return words_text.read_words(p.select(F.concat(F.lit("  "), "part", F.lit(" ")).alias("line")))


@register("parts_union", "SELECT part AS word FROM parts UNION SELECT w FROM doc_words")
def parts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.lexicon(spark, sf_dir).parts
    return words_text.merge_words(p.select(F.col("part").alias("word")), derived.document_words(spark, sf_dir).withColumnRenamed("w", "word"))


@register("parts_removals", "SELECT part AS word FROM parts EXCEPT SELECT w FROM doc_words")
def parts_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.lexicon(spark, sf_dir).parts
    return words_text.remove_words(p.select(F.col("part").alias("word")), derived.document_words(spark, sf_dir).withColumnRenamed("w", "word"))


@register("parts_filter", r"SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM documents) WHERE w <> '' AND NOT regexp_matches(w, '[_\\|:/.23]')")
def parts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = derived.read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("word")).where("word <> ''").distinct()
    return words_text.legal_words(w)


# Settings of the stems, by their number: endings, errata and stem preferences in one file, preferences of genders in another.
SETTINGS_LINES = {
    "main.conf": [
        (0, None, ["# settings", "[adjective_template]"]), (1, 0, ["{}legur NFET # an ending"]), (2, None, ["$include more/nouns.conf", "", "[bin_errata]"]), (3, 1, ["{} kk alm"]),
        (4, 11, ["{} KK alm"]), (5, 1, ["{} kk ism"]), (6, None, ["[stem_preferences]"]), (7, 2, ["{0} a{0} \\", "   b{0} < c{0} # why"]), (8, 12, ["{0} a{0} < b{0}"]), (9, None, ["$include none.conf", "[odd]"]),
    ],
    "more/nouns.conf": [(0, None, ["[Noun_Preferences]"]), (1, 3, ["{} kk < kvk"]), (2, 13, ["{} kvk < hk"]), (3, 8, ["{} hk < kk"]), (4, 18, ["{} hk < kvk", "{} hk kvk"]), (5, 13, ["{} hk < kvk"])],
}
#: Every how many stems a line is for, by the remainder that it asks for.
_EVERY = lambda r: 5 if r < 5 else 20


def _settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = derived.stems(derived.read(spark, sf_dir, "benchmark")).where(f"id % {derived.CAPITAL} <> 0")
    parts = []
    for file, blocks in SETTINGS_LINES.items():
        for block, remainder, texts in blocks:
            rows = spark.range(1).select(F.lit(0).alias("id"), F.lit("").alias("stem")) if remainder is None else stems.where(f"id % {_EVERY(remainder)} = {remainder % _EVERY(remainder)}")
            for k, t in enumerate(texts):
                parts.append(rows.select(F.lit(file).alias("file"), F.lit(block).alias("block"), "id", F.lit(k).alias("k"), F.replace(F.replace(F.lit(t), F.lit("{0}"), F.col("stem")), F.lit("{}"), F.col("stem")).alias("line")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n = numbered(every, ["file", "block", "id", "k"], "n")
    first = n.groupBy("file").agg(F.min("n").alias("first"))
    return n.join(F.broadcast(first), "file").select("file", (F.col("n") - F.col("first") + 1).alias("line_no"), "line")


def _settings_sql() -> str:
    lines = " UNION ALL ".join(
        f"SELECT '{file}' AS file, {block} AS block, {'0' if r is None else 'id'} AS id, {k} AS k, {r if r is not None else -1} AS r, {'' if r is None else 'stem'}{chr(39) * 2 if r is None else ''} AS stem" + (f" FROM plain WHERE id % {_EVERY(r)} = {r % _EVERY(r)}" if r is not None else "")
        for file, blocks in SETTINGS_LINES.items() for block, r, texts in blocks for k in range(len(texts))
    )
    has = lambda r: f"id % {_EVERY(r)} = {r % _EVERY(r)}"
    # A form's pairs in their order: all have kk < kvk, some then kvk < hk, hk < kk or hk < kvk.
    return f"""plain AS (SELECT id, stem FROM stems WHERE id % {derived.CAPITAL} <> 0),
settings_lines AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY block, id, k) AS line_no FROM ({lines})),
f AS (SELECT id, stem, {has(3)} AS one, {has(13)} AS two, {has(8)} AS three, {has(18)} AS four FROM plain),
fold AS (SELECT *, -2 AS kk, 2 AS kvk, CASE WHEN two THEN 6 WHEN three THEN -6 WHEN four THEN -2 END AS hk FROM f WHERE one)
SELECT 'ending' AS what, stem || 'legur' AS a, 'NFET' AS b, (row_number() OVER (ORDER BY id) - 1)::VARCHAR AS c FROM plain WHERE id % 5 = 0
UNION ALL SELECT 'errata', stem, 'kk', 'ism' FROM plain WHERE id % 5 = 1
UNION ALL SELECT 'stems', stem, 'a' || stem || ',b' || stem, 'c' || stem FROM plain WHERE id % 5 = 2
UNION ALL SELECT 'nouns', stem, g, s::VARCHAR FROM (SELECT stem, unnest(['kk', 'kvk', 'hk']) AS g, unnest([kk, kvk, hk]) AS s FROM fold) WHERE s IS NOT NULL
UNION ALL SELECT 'error', file, line_no::VARCHAR, 'class and domain are in lower case' FROM settings_lines WHERE file = 'main.conf' AND block = 4
UNION ALL SELECT 'error', file, line_no::VARCHAR, 'a second preference for ' || stem FROM settings_lines WHERE file = 'main.conf' AND block = 8
UNION ALL SELECT 'error', file, line_no::VARCHAR, CASE k WHEN 0 THEN 'missing file none.conf' ELSE 'unknown section odd' END FROM settings_lines WHERE file = 'main.conf' AND block = 9
UNION ALL SELECT 'error', file, line_no::VARCHAR, CASE block WHEN 4 THEN 'a form, a gender, < and a gender are expected' ELSE 'both genders have a score: ' || stem END FROM settings_lines WHERE file = 'more/nouns.conf' AND (block = 5 OR block = 4 AND k = 1)"""


@register("settings_tables", _settings_sql())
def settings_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the settings say, and what is wrong with them."""
    t = settings_table.settings_tables(_settings_lines(spark, sf_dir), "main.conf")
    row = lambda what, df, a, b, c: df.select(F.lit(what).alias("what"), *[x.cast("string").alias(k) for k, x in zip("abc", (a, b, c), strict=True)])
    out = row("ending", t["adjective_template"], F.col("ending"), F.col("mark"), F.col("seq"))
    for part in (
        row("errata", t["bin_errata"], F.col("ord"), F.col("ofl"), F.col("hluti")),
        row("stems", t["stem_preferences"], F.col("form"), F.array_join("worse", ","), F.array_join("better", ",")),
        row("nouns", t["noun_preferences"], F.col("form"), F.col("gender"), F.col("score")),
        row("error", t["errors"], F.col("file"), F.col("line_no"), F.col("message")),
    ):
        out = out.unionByName(part)
    return out


# Cleaning.  The dirty rows are the lexicon with every seventh id's forms spoilt in one of seven ways.
def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.lexicon_rows(spark, sf_dir)
    form = F.col("bmynd")
    spoilt = F.when(F.pmod("bin_id", F.lit(7)) == 0, "").when(F.pmod("bin_id", F.lit(7)) == 1, F.concat(F.upper(F.left(form, F.lit(1))), F.substr(form, F.lit(2)))).when(F.pmod("bin_id", F.lit(7)) == 2, F.left(form, F.lit(1)))
    spoilt = spoilt.when(F.pmod("bin_id", F.lit(7)) == 3, F.concat(form, F.lit("ttt"))).when(F.pmod("bin_id", F.lit(7)) == 4, F.concat(form, F.lit("œ"))).when(F.pmod("bin_id", F.lit(7)) == 5, F.concat(form, F.lit("å"))).otherwise(form)
    return numbered(rows, ["bin_id", "bmynd", "mark"], "line_no").withColumns({"file_no": F.lit(0), "bmynd": spoilt})


DIRTY = """dirty AS (SELECT * REPLACE (CASE bin_id % 7 WHEN 0 THEN '' WHEN 1 THEN upper(bmynd[1]) || bmynd[2:] WHEN 2 THEN bmynd[1] WHEN 3 THEN bmynd || 'ttt' WHEN 4 THEN bmynd || 'œ' WHEN 5 THEN bmynd || 'å' ELSE bmynd END AS bmynd) FROM lexicon)"""
FORM = "SELECT bin_id, bmynd, mark FROM dirty WHERE "


def _form(df: DataFrame) -> DataFrame:
    return df.select("bin_id", "bmynd", "mark")


register("clean_required", f"{DIRTY} {FORM} ord <> '' AND bmynd <> ''")(lambda s, d: _form(clean.required(_dirty(s, d))))
register("clean_caps", f"{DIRTY} {FORM} (ord[1] <> lower(ord[1])) = (bmynd[1] <> lower(bmynd[1]))")(lambda s, d: _form(clean.same_capitals(_dirty(s, d))))
register("clean_single", f"{DIRTY} {FORM} NOT (length(bmynd) = 1 AND length(ord) > 1 AND ord NOT IN ('ýr', 'ær', 'eiga'))")(lambda s, d: _form(clean.no_single_letters(_dirty(s, d))))
register("clean_ttt", f"{DIRTY} {FORM} NOT ends_with(bmynd, 'ttt')")(lambda s, d: _form(clean.no_triple_t(_dirty(s, d))))
register("clean_latin1", f"{DIRTY} {FORM} NOT contains(bmynd, 'œ')")(lambda s, d: _form(clean.latin1_only(_dirty(s, d))))
register("clean_letters", f"{DIRTY} {FORM} NOT regexp_matches(bmynd, '[+@_åø\\\\]')")(lambda s, d: _form(clean.no_suspicious_letters(_dirty(s, d))))


@register("clean_repairs", f"{DIRTY} SELECT bin_id, CASE WHEN bin_id % 2 = 0 THEN (CASE WHEN starts_with(bmynd, 'full') THEN bmynd ELSE 'full' || bmynd END) ELSE replace(bmynd, 'a', 'á') END AS bmynd, mark FROM dirty")
def clean_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dirty(spark, sf_dir)
    even = F.col("bin_id") % 2 == 0
    repairs = rows.select("ord", "bin_id", F.when(even, "prefix").otherwise("replace").alias("kind"), F.when(even, "full").otherwise("a").alias("a"), F.lit("á").alias("b")).distinct()
    return _form(clean.repair(rows, repairs))


#: Rows with the keys of the known repairs: the lexicon's ids are dealt to them in turn, and their forms meet each kind of repair.
_KEYS = list(dict.fromkeys((o, i) for o, i, *_ in clean.REPAIRS))
_ODD = "CASE was % 3 WHEN 0 THEN x WHEN 1 THEN x || bmynd ELSE bmynd || 'ttt' END"
KNOWN = f"""keyed AS (SELECT l.* REPLACE (o AS ord, i AS bin_id), bin_id AS was, CASE o WHEN 'árekstrarvörn' THEN 'árekstrar' WHEN 'dínamítsprenging' THEN 'dýnamít' WHEN 'illinnheimtanlegur' THEN 'ill' WHEN 'Norður-Landeyjar' THEN CASE WHEN bin_id % 2 = 0 THEN 'Norð-Vestur' ELSE 'Norð-vestur' END ELSE 'full' END AS x
  FROM lexicon l JOIN (VALUES {derived._values([(k, o, i) for k, (o, i) in enumerate(_KEYS)])}) t(k, o, i) ON l.bin_id % {len(_KEYS)} = k),
odd AS (SELECT * REPLACE ({_ODD} AS bmynd) FROM keyed WHERE mark IN ('NFET', 'EFET', 'GM-NH', 'FSB-KK-NFET')),
mended AS (SELECT *, CASE WHEN ord IN ('sem að', 'hvort að') THEN left(ord, length(ord) - 3) ELSE ord END AS o2, CASE WHEN ord IN ('sem að', 'hvort að') THEN left(ord, length(ord) - 3)
  WHEN ord LIKE 'full%' THEN CASE WHEN starts_with(bmynd, 'full') THEN bmynd ELSE 'full' || bmynd END WHEN ord = 'illinnheimtanlegur' THEN CASE WHEN starts_with(bmynd, 'ill') THEN bmynd ELSE 'ill' || bmynd END
  WHEN ord = 'dínamítsprenging' THEN replace(bmynd, 'dýnamít', 'dínamít') WHEN ord = 'Norður-Landeyjar' THEN replace(replace(bmynd, 'Norð-Vestur', 'Norður'), 'Norð-vestur', 'Norður') ELSE bmynd END AS b2, ord = 'árekstrarvörn' AND starts_with(bmynd, 'árekstrar') AS exempt FROM odd)
SELECT was, o2 AS ord, bin_id, b2 AS bmynd, mark FROM mended WHERE (ord <> 'árekstrarvörn' OR exempt) AND (exempt OR ((o2[1] <> lower(o2[1])) = (b2[1] <> lower(b2[1])) AND NOT (length(b2) = 1 AND length(o2) > 1) AND NOT ends_with(b2, 'ttt')))"""


@register("clean_known", KNOWN)
def clean_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known repairs on rows of their keys, and the checks after them, which exempt rows pass by."""
    keys = spark.createDataFrame([(k, o, i) for k, (o, i) in enumerate(_KEYS)], "k int, o string, i int")
    rows = derived.lexicon_rows(spark, sf_dir).where(F.col("mark").isin("NFET", "EFET", "GM-NH", "FSB-KK-NFET")).join(F.broadcast(keys), F.pmod("bin_id", F.lit(len(_KEYS))) == F.col("k"))
    lemma, was = F.col("o"), F.col("bin_id")
    north = F.when(was % 2 == 0, "Norð-Vestur").otherwise("Norð-vestur")
    x = F.when(lemma == "árekstrarvörn", "árekstrar").when(lemma == "dínamítsprenging", "dýnamít").when(lemma == "illinnheimtanlegur", "ill").when(lemma == "Norður-Landeyjar", north).otherwise("full")
    form = F.when(was % 3 == 0, x).when(was % 3 == 1, F.concat(x, "bmynd")).otherwise(F.concat("bmynd", F.lit("ttt")))
    fixed = clean.repair(rows.withColumns({"was": was, "bmynd": form, "ord": lemma, "bin_id": F.col("i")}), clean.known_repairs(spark))
    for check in (clean.same_capitals, clean.no_single_letters, clean.no_triple_t):
        fixed = check(fixed)
    return fixed.select("was", "ord", "bin_id", "bmynd", "mark")


@register("clean_valid_mark", f"{DIRTY} {FORM} regexp_replace(mark, '[23]+$', '') IN (SELECT mark FROM mark_order WHERE ofl = dirty.ofl AND pos % 2 = 0)")
def clean_valid_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form(clean.legal_marks(_dirty(spark, sf_dir), derived.lexicon(spark, sf_dir).mark_order.where("pos % 2 = 0")))


@register("clean_one_lemma", "r AS (SELECT bin_id // 3 AS bin_id, ord, bmynd, mark, bin_id AS line_no FROM lexicon) SELECT bin_id, bmynd, mark FROM (SELECT *, first_value(ord) OVER (PARTITION BY bin_id ORDER BY line_no) AS f FROM r) WHERE ord = f")
def clean_one_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.lexicon_rows(spark, sf_dir).withColumns({"file_no": F.lit(0), "line_no": F.col("bin_id")})
    return _form(clean.one_lemma(rows.withColumn("bin_id", F.expr("bin_id div 3").cast("int"))))


@register("clean_hluti", "r AS (SELECT bin_id // 3 AS bin_id, hluti, bmynd, mark, bin_id AS line_no FROM lexicon) SELECT bin_id, bmynd, mark, first_value(hluti) OVER (PARTITION BY bin_id ORDER BY line_no) AS hluti FROM r")
def clean_hluti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.lexicon_rows(spark, sf_dir).withColumns({"file_no": F.lit(0), "line_no": F.col("bin_id")})
    return clean.one_domain(rows.withColumn("bin_id", F.expr("bin_id div 3").cast("int"))).select("bin_id", "bmynd", "mark", "hluti")


@register("clean_dedup", f"SELECT {ALL} FROM lexicon")
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.lexicon_rows(spark, sf_dir)
    return clean.distinct_rows(rows.unionByName(rows))


@register(
    "clean_all",
    f"""{DIRTY}, x AS (SELECT bin_id // 3 AS bin_id, ord, bin_id AS line_no, CASE WHEN bin_id % 4 = 3 THEN bmynd || 'um' ELSE bmynd END AS bmynd, {', '.join(c for c in AUGMENTED if c not in ('bin_id', 'ord', 'bmynd'))} FROM dirty WHERE bmynd <> '' AND (bmynd <> 'a' OR bin_id % 4 = 3)),
ok AS (SELECT * FROM x WHERE (ord[1] <> lower(ord[1])) = (bmynd[1] <> lower(bmynd[1])) AND NOT (length(bmynd) = 1 AND length(ord) > 1 AND ord NOT IN ('ýr', 'ær', 'eiga')) AND NOT ends_with(bmynd, 'ttt') AND regexp_replace(mark, '[23]+$', '') IN (SELECT m.mark FROM mark_order m WHERE m.ofl = x.ofl) AND NOT contains(bmynd, 'œ') AND NOT regexp_matches(bmynd, '[+@_åø\\\\]')),
one AS (SELECT *, first_value(ord) OVER (PARTITION BY bin_id ORDER BY line_no) AS lemma FROM ok),
dom AS (SELECT * REPLACE (first_value(hluti) OVER (PARTITION BY bin_id ORDER BY line_no) AS hluti) FROM one WHERE ord = lemma) SELECT DISTINCT {ALL} FROM dom""",
)
def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ids share one, and every fourth entry has a repair of its own besides the known ones."""
    rows = stored(_dirty(spark, sf_dir).withColumn("line_no", F.col("bin_id")).withColumn("bmynd", F.when((F.col("bin_id") % 4 == 3) & (F.col("bmynd") != ""), F.concat("bmynd", F.lit("~"))).otherwise(F.col("bmynd"))))
    rows = rows.withColumn("bin_id", F.expr("bin_id div 3").cast("int"))
    own = rows.where("bmynd like '%~'").select("ord", "bin_id", F.lit("replace").alias("kind"), F.lit("~").alias("a"), F.lit("um").alias("b")).distinct()
    return clean.clean(rows, derived.lexicon(spark, sf_dir).mark_order, clean.known_repairs(spark).unionByName(own), clean.STOP_FORMS)


# Indexes and statistics.
@register("index_hluti", "SELECT value, row_number() OVER (ORDER BY f, value) - 1 AS ix FROM (SELECT hluti AS value, min(bin_id) AS f FROM lexicon GROUP BY hluti)")
def index_hluti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_index(derived.lexicon_rows(spark, sf_dir), "hluti", "bin_id")


#: Files of shuffled rows: places are those of a digest of the row, in three files.
SHUFFLED = "shuffled AS (SELECT *, bin_id % 3 AS file_no, row_number() OVER (PARTITION BY bin_id % 3 ORDER BY md5(bmynd || ';' || mark || ';' || bin_id)) AS line_no FROM lexicon)"


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.lexicon_rows(spark, sf_dir).withColumns({"file_no": F.pmod("bin_id", F.lit(3)), "_d": F.md5(F.concat_ws(";", "bmynd", "mark", F.col("bin_id").cast("string")).cast("binary"))})
    n = numbered(rows, ["file_no", "_d"], "n")
    return n.join(F.broadcast(n.groupBy("file_no").agg(F.min("n").alias("_first"))), "file_no").withColumn("line_no", F.col("n") - F.col("_first") + 1).drop("n", "_first", "_d")


register("index_meanings", f"{SHUFFLED} SELECT ofl || ';' || mark AS value, row_number() OVER (ORDER BY min(file_no * 1000000000 + line_no)) - 1 AS ix FROM shuffled GROUP BY ofl, mark")(lambda s, d: stats.value_index(_shuffled(s, d).withColumn("meaning", F.concat_ws(";", "ofl", "mark")), "meaning", "file_no", "line_no"))
register("mark_freq_rank", f"{SHUFFLED} SELECT ofl, mark, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(file_no * 1000000000 + line_no)) - 1 AS ix FROM shuffled GROUP BY ofl, mark")(lambda s, d: stats.meaning_ranks(_shuffled(s, d), "file_no", "line_no"))
register("lemma_cat_count", "SELECT ofl, count(DISTINCT bin_id) AS n FROM lexicon GROUP BY ofl")(lambda s, d: stats.lemmas_by_class(derived.lexicon_rows(s, d)))
register("lexicon_stats", "SELECT count(*) AS n_rows, count(DISTINCT bmynd) AS n_forms, count(DISTINCT bin_id) AS n_lemmas, count(DISTINCT hluti) AS n_domains, count(DISTINCT ofl || ';' || mark) AS n_meanings, count(DISTINCT einkunn || malsnid || birting || beinkunn) AS n_extras FROM lexicon")(lambda s, d: stats.summary(derived.lexicon_rows(s, d)))
register("alphabet", "SELECT DISTINCT unnest(string_split(bmynd, '')) AS letter FROM lexicon")(lambda s, d: stats.alphabet(derived.lexicon_rows(s, d)))
register("id_bounds", "SELECT min(bin_id) AS min_id, max(bin_id) AS max_id FROM lexicon")(lambda s, d: stats.id_bounds(derived.lexicon_rows(s, d)))
register("paradigm_forms", "SELECT bin_id, coalesce(string_agg(DISTINCT bmynd, ',' ORDER BY bmynd) FILTER (WHERE bmynd <> ord), '') AS forms FROM lexicon GROUP BY bin_id")(lambda s, d: stats.paradigm_forms(derived.lexicon_rows(s, d)))
register(
    "paradigm_templates",
    "f AS (SELECT DISTINCT bin_id, ord, bmynd FROM lexicon WHERE bmynd <> ord), g AS (SELECT *, coalesce(lag(bmynd) OVER (PARTITION BY bin_id ORDER BY bmynd), ord) AS before FROM f), h AS (SELECT *, list_max(list_filter(range(0, least(length(before), length(bmynd)) + 1), lambda k: left(before, k) = left(bmynd, k))) AS k FROM g), t AS (SELECT bin_id, string_agg((length(before) - k) || ':' || substr(bmynd, k + 1), '/' ORDER BY bmynd) AS signature FROM h GROUP BY bin_id) SELECT signature, count(*) AS n FROM t GROUP BY signature",
)(lambda s, d: stats.paradigm_templates(derived.lexicon_rows(s, d)))
register("entries_by_id", "SELECT bmynd, bin_id, count(*) AS n FROM lexicon GROUP BY ALL")(lambda s, d: stats.entries_by_id(derived.lexicon_rows(s, d)))


@register("forms_same_lemma", "SELECT DISTINCT w, b.bin_id, b.bmynd, b.mark FROM words JOIN lexicon a ON a.bmynd = w JOIN lexicon b ON b.bin_id = a.bin_id AND contains(b.mark, 'ÞGF')")
def forms_same_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, lex = _words_and_lexicon(spark, sf_dir)
    return stats.forms_of_same_lemma(asked, lex.rows, "ÞGF")


# Tags and text.
register("mark_order", "SELECT ofl, mark, pos FROM mark_order WHERE (ofl, mark) IN (SELECT ofl, mark FROM lexicon)")(lambda s, d: derived.lexicon(s, d).mark_order.join(derived.lexicon_rows(s, d).select("ofl", "mark").distinct(), ["ofl", "mark"], "left_semi"))


def _atoms_sql() -> str:
    rows = [(m, ",".join(marks.requested((m,)))) for m in sorted({t for _, t, _ in derived.TAGS})]
    return f"a(mark, atoms) AS (VALUES {derived._values(rows)}) SELECT bmynd, l.mark, atoms FROM lexicon l JOIN a USING (mark)"


register("mark_atoms", _atoms_sql())(lambda s, d: derived.lexicon_rows(s, d).select("bmynd", "mark", F.array_join(marks.atoms(F.col("mark")), ",").alias("atoms")))


@register("mark_index", "n AS (SELECT ofl, count(*) AS n FROM mark_order GROUP BY ofl) SELECT bmynd, l.ofl, l.mark, m.pos + CASE WHEN l.mark LIKE '%2' THEN n ELSE 0 END AS ix FROM lexicon l JOIN mark_order m ON m.ofl = l.ofl AND m.mark = regexp_replace(l.mark, '[23]$', '') JOIN n ON n.ofl = l.ofl")
def mark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = derived.lexicon(spark, sf_dir)
    order = lex.mark_order.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ofl"))).select("ofl", F.col("mark").alias("_m"), "pos", "n")
    rows = lex.rows.withColumn("_m", marks.base_mark(F.col("mark"))).join(F.broadcast(order), ["ofl", "_m"])
    return rows.select("bmynd", "ofl", "mark", (F.col("pos") + F.when(F.col("mark").endswith("2"), F.col("n")).when(F.col("mark").endswith("3"), 2 * F.col("n")).otherwise(0)).alias("ix"))


register("simplify_mark", "SELECT DISTINCT mark, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(mark, 'NF', ''), 'ÞF', ''), 'ÞGF', ''), 'EF', ''), '2', ''), '3', ''), 'ET', ''), 'FT', ''), 'gr', ''), 'EVB', 'ESB'), 'FVB', 'FSB') AS plain FROM lexicon")(
    lambda s, d: derived.lexicon_rows(s, d).select("mark", marks.simplify(F.col("mark"), True, True).alias("plain")).distinct()
)
register("entry_repr", "SELECT '(ord=''' || ord || ''', ' || ofl || '/' || hluti || '/' || bin_id || ', bmynd=''' || bmynd || ''', ' || mark || ')' AS entry FROM lexicon")(lambda s, d: derived.lexicon_rows(s, d).select(text.entry_repr(*[F.col(c) for c in ("ord", "ofl", "hluti", "bin_id", "bmynd", "mark")]).alias("entry")))

# Point lookups.
register("contains", "SELECT w, w IN (SELECT bmynd FROM lexicon) AS found FROM words")(lambda s, d: lookups.contains(*_words_and_lexicon(s, d)))
register("lookup_raw", f"SELECT w, {FEW} FROM words JOIN lexicon ON bmynd = w WHERE ofl IN ('kk', 'kvk', 'hk')")(lambda s, d: lookups.lookup_raw(*_words_and_lexicon(s, d), cat="no").select("w", *BASIC))
register("lookup_raw_ksnid", f"SELECT w, {ALL} FROM words JOIN lexicon ON bmynd = w WHERE contains(mark, 'ET')")(lambda s, d: lookups.lookup_raw(*_words_and_lexicon(s, d), keep=lambda m: F.contains(m, F.lit("ET"))))


@register("lemma_by_id", "SELECT bin_id, min(ord) AS ord, min(hluti) AS hluti FROM lexicon GROUP BY bin_id")
def lemma_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = derived.lexicon(spark, sf_dir)
    return lookups.lemma_of_id(_ids(lex), lex)


@register("lemma_forms", "SELECT DISTINCT bin_id, unnest([bmynd, ord]) AS form FROM lexicon")
def lemma_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = derived.lexicon(spark, sf_dir)
    return lookups.lemma_forms(_ids(lex), lex)


@register("lookup_id", f"SELECT row_number() OVER (PARTITION BY bin_id ORDER BY (einkunn <> 1)::INT + (beinkunn <> 1)::INT, coalesce(pos, 9999), f.ofl, bmynd, f.mark) AS rank, {ALL.replace('ofl', 'f.ofl').replace('mark', 'f.mark')} FROM (SELECT DISTINCT {ALL} FROM shown) f LEFT JOIN mark_order m ON m.ofl = f.ofl AND m.mark = f.mark")
def lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = derived.lexicon(spark, sf_dir)
    return lookups.lookup_id(_ids(lex), lex)


register("visible", f"SELECT {FEW} FROM shown")(lambda s, d: lookups.visible(derived.lexicon(s, d)).select(*BASIC))
register("visible_basic", f"SELECT {FEW} FROM lexicon, bound WHERE bin_id < first_local")(lambda s, d: lookups.visible_basic(derived.lexicon(s, d)).select(*BASIC))
register("grade_rank", "SELECT bmynd, bin_id, mark, (einkunn <> 1)::INT + (beinkunn <> 1)::INT AS penalty FROM lexicon")(lambda s, d: derived.lexicon_rows(s, d).select("bmynd", "bin_id", "mark", lookups.penalty().alias("penalty")))

# The cascade.
SELECT_FEW = f"SELECT w, key, stage, rank, {FEW} FROM found"
register("lookup", SELECT_FEW, cascade=True)(lambda s, d: lookups.basic(_found(s, d)))
register("lookup_ksnid", f"SELECT w, key, stage, rank, {ALL} FROM found", cascade=True)(lambda s, d: _found(s, d))
register("lookup_exact", f"SELECT w, w AS key, 1 AS stage, row_number() OVER (PARTITION BY w ORDER BY {ORDER}) AS rank, {', '.join('f.' + c for c in BASIC)} FROM words JOIN shown f ON bmynd = w {POS} WHERE birting <> 'S'")(lambda s, d: lookups.basic(lookups.lookup_exact(*_words_and_lexicon(s, d))))
for _name, _stage in (("lookup_lowercase", 3), ("legur_template", 4), ("lookup_compound", 5), ("lookup_negation", 6), ("lookup_z", 7)):
    register(_name, f"{SELECT_FEW} WHERE stage = {_stage}", cascade=True)(lambda s, d, n=_stage: lookups.basic(_found(s, d, last_step=n)).where(F.col("stage") == n))
register("lookup_cats", "SELECT DISTINCT w, ofl FROM found", cascade=True)(lambda s, d: lookups.classes_of(_found(s, d)))
register("lookup_lemmas_and_cats", "SELECT DISTINCT w, ord, ofl FROM found", cascade=True)(lambda s, d: lookups.lemmas_and_classes(_found(s, d)))
register(
    "lookup_lemmas",
    SELECT_FEW + " WHERE (ofl = 'so' AND mark = 'MM-NH') OR (replace(ord, '-', '') = key AND CASE ofl WHEN 'so' THEN mark = 'GM-NH' WHEN 'lo' THEN mark IN ('FSB-KK-NFET', 'KK-NFET') WHEN 'ao' THEN true ELSE mark = 'NFET' END)",
    cascade=True,
)(lambda s, d: lookups.basic(lookups.lemma_entries(_found(s, d))))
register("open_cats", SELECT_FEW + " WHERE ofl IN ('so', 'kk', 'hk', 'kvk', 'lo')", cascade=True)(lambda s, d: lookups.basic(lookups.open_classes(_found(s, d))))
register("nouns", SELECT_FEW + " WHERE ofl IN ('kk', 'hk', 'kvk')", cascade=True)(lambda s, d: lookups.basic(lookups.nouns(_found(s, d))))


@register("lookup_key", "SELECT w, coalesce(key, w) AS key FROM words LEFT JOIN (SELECT w, min(key) AS key FROM found GROUP BY w) USING (w)", cascade=True)
def lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, lex = _words_and_lexicon(spark, sf_dir)
    return lookups.keys_of(asked, lookups.lookup(asked, lex))


def _options_sql(given: str) -> str:
    """The cascade of requests (word, s, u); a request's name is its word and its options."""
    return _cascade_sql(asked=f"SELECT word || s::INT || u::INT AS w, word AS k, s, u, 0 AS r, NULL::INT AS id, NULL::VARCHAR AS lemma FROM ({given})")


OF_REQUEST = "left(w, length(w) - 2) AS w"
register("lookup_sentence_start", f"SELECT w, key, stage, rank, {FEW} FROM (SELECT * REPLACE ({OF_REQUEST}) FROM found)", cascade=_options_sql("SELECT w AS word, true AS s, false AS u FROM words"))(lambda s, d: lookups.basic(_found(s, d, at_sentence_start=True)))
register("lookup_auto_upper", f"SELECT w, key, stage, rank, {FEW} FROM (SELECT * REPLACE ({OF_REQUEST}) FROM found)", cascade=_options_sql("SELECT w AS word, false AS s, true AS u FROM words"))(lambda s, d: lookups.basic(_found(s, d, auto_uppercase=True)))

#: Tokens of the documents: sentences end with one of .!? or a new line, and their first words are flagged.
TOKENS = f"""sentences AS (SELECT doc_id, unnest(x) AS sentence, unnest(range(0, len(x)))::INT AS sentence_no FROM (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS x FROM documents)),
tokens AS MATERIALIZED (SELECT doc_id, sentence_no, unnest(x) AS w, unnest(range(0, len(x)))::INT AS place, unnest(range(0, len(x))) = 0 AS at_sentence_start, sentence_no % 3 = 1 AS auto_uppercase FROM (SELECT doc_id, sentence_no, list_filter(string_split_regex(sentence, '[^{derived.LETTERS}A-ZÞÆÖÐÁÉÍÓÚÝ]+'), lambda t: t <> '') AS x FROM sentences))"""


@register("lookup_tokens", f"SELECT doc_id, sentence_no, place, t.w, at_sentence_start, auto_uppercase, key, stage, rank, {FEW} FROM tokens t JOIN found ON found.w = t.w || at_sentence_start::INT || auto_uppercase::INT", cascade=TOKENS + ", " + _options_sql("SELECT DISTINCT w AS word, at_sentence_start AS s, auto_uppercase AS u FROM tokens"))
def lookup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents in their places; every third sentence's are looked up with auto-uppercase."""
    letters = f"[^{derived.LETTERS}A-ZÞÆÖÐÁÉÍÓÚÝ]+"
    sentences = derived.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.!?\n]+")).alias("sentence_no", "sentence"))
    tokens = sentences.select("doc_id", "sentence_no", F.posexplode(F.filter(F.split("sentence", letters), lambda t: t != "")).alias("place", "w"))
    tokens = tokens.withColumns({"at_sentence_start": F.col("place") == 0, "auto_uppercase": F.col("sentence_no") % 3 == 1})
    found = lookups.lookup_tokens(tokens, derived.lexicon(spark, sf_dir))
    return found.select("doc_id", "sentence_no", "place", "w", "at_sentence_start", "auto_uppercase", "key", "stage", "rank", *BASIC)


# Compounds.
COMPOUNDS = f"""{PLAIN}, asked AS ({ASKED}), {_parts_sql("s", "asked")}"""


register("compound_splits", COMPOUNDS + " SELECT c AS w, array_to_string(ps, '|') AS parts FROM s_cuts JOIN words ON c = w")(lambda s, d: compounds.splits(derived.query_words(s, d), derived.lexicon(s, d).parts).select("w", F.array_join("parts", "|").alias("parts")))
register("compound_ways", COMPOUNDS + " SELECT c AS w, count(*) AS ways FROM s_cuts JOIN words ON c = w GROUP BY c")(lambda s, d: compounds.count_splits(derived.query_words(s, d), derived.lexicon(s, d).parts).select("w", F.col("ways").cast("long").alias("ways")))
register("compound_best", COMPOUNDS + " SELECT c AS w, array_to_string(ps, '|') AS parts FROM s_best JOIN words ON c = w")(lambda s, d: compounds.best_split(derived.query_words(s, d), derived.lexicon(s, d).parts).select("w", F.array_join("parts", "|").alias("parts")))


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, lex = _words_and_lexicon(spark, sf_dir)
    return compounds.get_compound(asked, lex)


for _name, _which, _where in (
    ("get_compound", "true", "true"),
    ("compound_hyphen", "contains(w, '-')", "contains(w, '-')"),
    ("compound_space", "contains(w, ' ')", "contains(w, ' ')"),
    ("compound_case", "w <> lower(w) AND NOT contains(w, '-') AND NOT contains(w, ' ')", "w <> lower(w) and not contains(w, '-') and not contains(w, ' ')"),
):
    register(_name, f"{COMPOUNDS} SELECT w, key, {FEW} FROM s_5 WHERE {_which}")(lambda s, d, x=_where: _compounds(s, d).where(x).select("w", "key", *BASIC))
register("compound_entries", f"{COMPOUNDS} SELECT w, key, {ALL} FROM s_5 WHERE bin_id = 0")(lambda s, d: _compounds(s, d).where("bin_id = 0").select("w", "key", *AUGMENTED))


# Variants.
@register("variants_raw", f"SELECT DISTINCT w, {', '.join('b.' + c for c in BASIC)} FROM words JOIN lexicon a ON a.bmynd = w AND a.ofl IN ('kk', 'kvk', 'hk') JOIN lexicon b ON b.bin_id = a.bin_id AND b.mark IN ('ÞGFFT', 'ÞGFFTgr')")
def variants_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants_raw(*_words_and_lexicon(spark, sf_dir), "no", ("ÞGF", "FT")).select("w", *BASIC).distinct()


@register("variants_nogr", f"SELECT DISTINCT w, {', '.join('b.' + c for c in BASIC)} FROM words JOIN lexicon a ON a.bmynd = w AND a.ofl = 'hk' JOIN lexicon b ON b.bin_id = a.bin_id AND b.mark = 'NFFT'")
def variants_nogr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants_raw(*_words_and_lexicon(spark, sf_dir), "hk", ("NF", "FT", "nogr")).select("w", *BASIC).distinct()


def _variant_rows(r: int, classes: str, wanted: tuple[str, ...], by_lemma: bool = False) -> str:
    """rows_of for one request: visible rows of the ids of a spelling with all wanted features, and their distance from its own."""
    asked = ", ".join(f"'{x}'" for x in marks.requested(wanted) if x != "nogr")
    bare = " AND NOT list_contains(b.atoms, 'gr')" if "nogr" in wanted else ""
    by = "bmynd, ord" if by_lemma else "bmynd"
    return f"""SELECT DISTINCT a.bmynd AS k, {r} AS r, {', '.join('b.' + c for c in AUGMENTED)}, (len(list_filter(b.atoms, lambda x: NOT list_contains(every, x))) + len(list_filter(every, lambda x: NOT list_contains(b.atoms, x))))::INT AS distance
FROM (SELECT bmynd, unnest(list_distinct(list(bin_id))) AS bin_id, list_distinct(flatten(list(atoms))) AS every FROM wide WHERE ofl IN ({classes}) GROUP BY {by}) a JOIN near b ON b.bin_id = a.bin_id AND list_has_all(b.atoms, [{asked}]::VARCHAR[]){bare}"""


def _variants_sql(*requests: tuple, rows: str = "lexicon", shown: str = "shown", mark: str = "mark") -> str:
    """rows_of for several requests (classes, features, do they ask for lemmas?), numbered from 0."""
    every = [(m, ",".join(marks.requested((m,)))) for m in sorted({t for _, t, _ in derived.TAGS} | {"OBEYGJANLEGT"})]
    return f"""tag_list(tag, atoms) AS (SELECT tag, string_split(x, ',') FROM (VALUES {derived._values(every)}) t(tag, x)),
wide AS MATERIALIZED (SELECT x.*{" REPLACE (raw_ofl AS ofl)" if mark != "mark" else ""}, atoms FROM {rows} x JOIN tag_list ON tag = {mark}), near AS MATERIALIZED (SELECT x.*, atoms FROM {shown} x JOIN tag_list ON tag = {mark}),
rows_of AS MATERIALIZED ({" UNION ALL ".join(_variant_rows(r, *x) for r, x in enumerate(requests))})"""


def _variants_cascade(classes: str, wanted: tuple[str, ...]) -> str:
    return _cascade_sql(_variants_sql((classes, wanted)), f"{PENALTY}, coalesce(distance, 999), ")


register("lookup_variants", f"SELECT w, key, stage, rank, distance, {FEW} FROM found", cascade=_variants_cascade("'so'", ("FH", "NT", "p3", "FT")))(lambda s, d: variants.lookup_variants(*_words_and_lexicon(s, d), "so", ("FH", "NT", "p3", "FT")).select("w", "key", "stage", "rank", "distance", *BASIC))
register("variants_rank", "SELECT w, rank, distance, bmynd, mark FROM found", cascade=_variants_cascade("'kk', 'kvk', 'hk'", ("ÞGF",)))(lambda s, d: variants.lookup_variants(*_words_and_lexicon(s, d), "no", ("ÞGF",)).select("w", "rank", "distance", "bmynd", "mark"))

#: Requests of ten kinds: class, features, is the word to be the lemma?  The last kind asks for the id 7 too.
WISHES = (
    ("no", ("NF", "FT", "nogr"), False), ("so", ("FH", "NT", "p3", "FT"), False), ("lo", ("KK", "EF"), False), ("kk", ("ÞGF",), False), ("kvk", ("EF", "gr"), False),
    ("hk", ("NF", "ET"), False), ("so", ("GM-NH",), False), ("lo", ("MST",), False), ("no", ("ÞF_ET",), True), ("no", ("ÞGF", "gr"), False),
)
KIND, KIND_ID = "length(w) % 10", 7
_classes_sql = lambda c: "'kk', 'kvk', 'hk'" if c == "no" else f"'{c}'"


@register(
    "variants_table",
    f"SELECT left(w, length(w) - 1) AS w, right(w, 1)::INT AS kind, key, stage, rank, distance, {FEW} FROM found",
    cascade=_cascade_sql(
        _variants_sql(*((_classes_sql(c), f, x) for c, f, x in WISHES)),
        f"{PENALTY}, coalesce(distance, 999), ",
        f"SELECT w || r AS w, w AS k, false AS s, false AS u, r, CASE WHEN r = 9 THEN {KIND_ID} END::INT AS id, CASE WHEN r = 8 THEN w END AS lemma FROM (SELECT w, {KIND} AS r FROM words)",
    ),
)
def variants_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every word, of one of ten kinds, in one plan."""
    asked, lex = _words_and_lexicon(spark, sf_dir)
    kinds = spark.createDataFrame([(k, c, list(f), x) for k, (c, f, x) in enumerate(WISHES)], "kind int, class string, features array<string>, is_lemma boolean")
    table = asked.withColumn("kind", F.length("w") % len(WISHES)).join(F.broadcast(kinds), "kind")
    table = table.withColumns({"lemma": F.when(F.col("is_lemma"), F.col("w")), "id": F.when(F.col("kind") == len(WISHES) - 1, F.lit(KIND_ID))})
    found = variants.lookup_variants(table.select("w", "class", "features", "lemma", "id"), lex)
    return found.withColumn("kind", F.length("w") % len(WISHES)).select("w", "kind", "key", "stage", "rank", "distance", *BASIC)


# Cases.
def _case_sql(case: str, more: str = "") -> str:
    plain = "replace(replace(replace(replace(replace(replace({0}.mark, 'NF', ''), 'ÞF', ''), 'ÞGF', ''), 'EF', ''), '2', ''), '3', '')"
    return f"SELECT DISTINCT w, {', '.join('b.' + c for c in BASIC)} FROM words JOIN lexicon a ON a.bmynd = w JOIN lexicon b ON b.bin_id = a.bin_id AND b.ord = a.ord AND b.ofl = a.ofl AND contains(b.mark, '{case}') AND {plain.format('a')} = {plain.format('b')}, bound WHERE b.bin_id < first_local{more}"


def _simple(tag: str) -> str:
    """The tag without case, and without number and definiteness where the columns number and bare_too say so."""
    less = lambda x, parts: f"replace({less(x, parts[:-1])}, '{parts[-1]}', '')" if parts else x
    plain = less(tag, ["NF", "ÞF", "ÞGF", "EF", "2", "3"])
    counted = f"CASE WHEN number THEN {less(plain, ['ET', 'FT'])} ELSE {plain} END"
    bare = f"replace(replace(replace({counted}, 'gr', ''), 'EVB', 'ESB'), 'FVB', 'FSB')"
    return f"CASE WHEN bare_too THEN {bare} ELSE {counted} END"


for _case, _of in cases.CASES.items():
    register(f"lookup_{_of}", _case_sql(_case))(lambda s, d, c=_case: cases.lookup_case(*_words_and_lexicon(s, d), c))
_BARE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}.mark, 'NF', ''), 'ÞF', ''), 'ÞGF', ''), 'EF', ''), '2', ''), '3', ''), 'ET', ''), 'FT', ''), 'gr', ''), 'EVB', 'ESB'), 'FVB', 'FSB')"
register("lookup_case", f"SELECT DISTINCT w, {', '.join('b.' + c for c in BASIC)} FROM words JOIN lexicon a ON a.bmynd = w JOIN lexicon b ON b.bin_id = a.bin_id AND contains(b.mark, 'ÞGF') AND contains(b.mark, 'ET') AND NOT regexp_matches(b.mark, 'gr|FVB|EVB') AND {_BARE.format('a')} = {_BARE.format('b')}, bound WHERE b.bin_id < first_local")(
    lambda s, d: cases.lookup_case(*_words_and_lexicon(s, d), "ÞGF", singular=True, indefinite=True)
)
CASE_TABLE = f"""asked_cases AS (SELECT w, unnest(['NF', 'ÞF', 'ÞGF', 'EF']) AS c, length(w) % 2 = 0 AS single, length(w) % 3 = 0 AS bare, length(w) % 5 = 0 AS every FROM words),
both_tags AS (SELECT a.mark AS ma, b.mark AS mb, number, bare_too FROM (SELECT DISTINCT mark FROM lexicon) a, (SELECT DISTINCT mark FROM lexicon) b, (VALUES (true), (false)) n(number), (VALUES (true), (false)) d(bare_too) WHERE {_simple("a.mark")} = {_simple("b.mark")})
SELECT DISTINCT w, c AS "case", {', '.join('b.' + c for c in BASIC)} FROM asked_cases JOIN lexicon a ON a.bmynd = w JOIN lexicon b ON b.bin_id = a.bin_id AND b.ord = a.ord AND b.ofl = a.ofl AND contains(b.mark, c) AND (every OR ((NOT single OR contains(b.mark, 'ET')) AND (NOT bare OR NOT regexp_matches(b.mark, 'gr|FVB|EVB'))))
JOIN both_tags ON ma = a.mark AND mb = b.mark AND number = (single OR every) AND bare_too = (bare OR every), bound WHERE b.bin_id < first_local"""


@register("case_table", CASE_TABLE)
def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in all four cases, with options of its own, in one plan."""
    asked, lex = _words_and_lexicon(spark, sf_dir)
    n = F.length("w")
    table = asked.select("w", F.explode(F.array(*[F.lit(c) for c in cases.CASES])).alias("case"), (n % 2 == 0).alias("singular"), (n % 3 == 0).alias("indefinite"), (n % 5 == 0).alias("all_forms"))
    return cases.lookup_case(table, lex).select("w", "case", *BASIC).distinct()


register("lookup_forms", f"SELECT DISTINCT w, {', '.join('b.' + c for c in BASIC)} FROM words JOIN lexicon a ON a.bmynd = w AND a.ofl = 'kk' AND a.ord = w JOIN lexicon b ON b.bin_id = a.bin_id AND contains(b.mark, 'ÞF') AND {_BARE.format('a')} = {_BARE.format('b')}, bound WHERE b.bin_id < first_local")(lambda s, d: cases.lookup_forms(*_words_and_lexicon(s, d), "kk", "þf"))
register("raw_nominative", f"p AS (SELECT DISTINCT w, unnest([b.bmynd, b.ord]) AS form FROM words JOIN lexicon a ON a.bmynd = w JOIN lexicon b ON b.bin_id = a.bin_id) SELECT DISTINCT w, {FEW} FROM p JOIN lexicon ON bmynd = form, bound WHERE contains(mark, 'NF') AND bin_id < first_local")(lambda s, d: cases.raw_nominative(*_words_and_lexicon(s, d)))


def _preferences(rows: DataFrame) -> DataFrame:
    return rows.where("bin_id % 4 = 1").select(F.col("bmynd").alias("form"), F.col("ofl").alias("gender"), F.lit(2).alias("score")).distinct()


@register("noun_pref_score", "SELECT bmynd, bin_id, mark, CASE WHEN (bmynd, ofl) IN (SELECT bmynd, ofl FROM lexicon WHERE bin_id % 4 = 1) THEN 2 ELSE 0 END AS score FROM lexicon")
def noun_pref_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.lexicon_rows(spark, sf_dir)
    return cases.preference_score(rows, _preferences(rows)).select("bmynd", "bin_id", "mark", "score")


def _cast_sql(case: str, rows: str = "lexicon", raw: str = "", bound: str = ", bound WHERE b.bin_id < first_local") -> str:
    """Each word in the case: the reading, the key of its forms and a second one in lower case, and the first fitting form."""
    plain = f"replace(replace(replace(replace(replace(replace({{0}}.{raw}mark, 'NF', ''), 'ÞF', ''), 'ÞGF', ''), 'EF', ''), '2', ''), '3', '')"
    part = lambda c: f"string_split({c}, '-')[-1]"
    return f"""scored AS (SELECT f.*, CASE WHEN ({part("bmynd")}, ofl) IN (SELECT bmynd, ofl FROM lexicon WHERE bin_id % 4 = 1) THEN 2 ELSE 0 END AS score FROM found f WHERE contains(mark, 'NF') AND ofl IN ('lo', 'kk', 'kvk', 'hk', 'fn', 'pfn', 'to', 'gr')),
chosen AS MATERIALIZED (SELECT w AS word, bmynd, ord, ofl, mark FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY ofl <> 'lo', CASE WHEN ofl = 'lo' THEN 0 ELSE -score END, rank) AS n FROM scored) WHERE n = 1),
cut_at AS (SELECT *, ofl <> 'lo' AND contains(bmynd, '-') AND NOT contains(word, '-') AS split FROM chosen),
tries AS MATERIALIZED (SELECT word, ofl AS class, mark AS tag, CASE WHEN split THEN replace(left(bmynd, length(bmynd) - length({part("bmynd")}) - 1), '-', '') ELSE '' END AS front, CASE WHEN split THEN {part("ord")} ELSE ord END AS lemma, unnest([{{'t': 0, 'k': CASE WHEN ofl = 'lo' THEN bmynd WHEN split THEN {part("bmynd")} ELSE word END}}, {{'t': 1, 'k': CASE WHEN ofl <> 'lo' AND NOT split AND word[1] <> lower(word[1]) AND NOT (word = upper(word) AND word <> lower(word)) THEN lower(word) END}}]) AS x FROM cut_at),
fits AS (SELECT DISTINCT word, class, tag, front, x.t AS t, {', '.join('b.' + c for c in BASIC)} FROM tries JOIN {rows} a ON a.bmynd = x.k AND a.ord = lemma AND a.{raw}ofl = class JOIN {rows} b ON b.bin_id = a.bin_id AND b.ord = a.ord AND b.{raw}ofl = a.{raw}ofl AND contains(b.{raw}mark, '{case}') AND {plain.format('a')} = {plain.format('b')}{bound}),
one AS (SELECT * FROM (SELECT *, min(t) OVER (PARTITION BY word) AS least FROM fits) WHERE t = least AND CASE WHEN contains(tag, 'ET') THEN contains(mark, 'ET') WHEN contains(tag, 'FT') THEN contains(mark, 'FT') ELSE true END AND CASE WHEN class <> 'lo' THEN true WHEN contains(tag, 'VB') THEN contains(mark, 'VB') WHEN contains(tag, 'SB') THEN contains(mark, 'SB') ELSE true END),
done AS (SELECT word, front || bmynd AS r FROM (SELECT f.*, row_number() OVER (PARTITION BY word ORDER BY bin_id, coalesce(pos, 9999), f.ofl, bmynd, f.mark, ord, hluti) AS n FROM one f {POS}) WHERE n = 1)
SELECT w, coalesce(CASE WHEN w = upper(w) AND w <> lower(w) THEN upper(r) WHEN w[1] <> lower(w[1]) THEN upper(r[1]) || r[2:] ELSE r END, w) AS result FROM words LEFT JOIN done ON word = w"""


for _case, _of in (("ÞF", "accusative"), ("ÞGF", "dative"), ("EF", "genitive")):

    @register(f"cast_to_{_of}", _cast_sql(_case), cascade=True)
    def cast_to(spark: SparkSession, sf_dir: str, case: str = _case) -> DataFrame:
        asked, lex = _words_and_lexicon(spark, sf_dir)
        return cases.cast(asked, lex, case, _preferences(lex.rows))


@register("cast_table", " UNION ALL ".join(f"SELECT w, '{c}' AS \"case\", result FROM ({{{c}}})" for c in ("ÞF", "ÞGF", "EF")).format(**{c: f"WITH {_cast_sql(c)}" for c in ("ÞF", "ÞGF", "EF")}), cascade=True)
def cast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in three cases, in one plan that looks each word up once."""
    asked, lex = _words_and_lexicon(spark, sf_dir)
    return cases.cast(asked.withColumn("case", F.explode(F.array(F.lit("ÞF"), F.lit("ÞGF"), F.lit("EF")))), lex, None, _preferences(lex.rows))


@register("cast_compound", _cast_sql("ÞGF") + " JOIN (SELECT DISTINCT w FROM s_5) USING (w)", cascade=True)
def cast_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that are compounds, in the dative."""
    asked, lex = _words_and_lexicon(spark, sf_dir)
    mine = stored(lookups.lookup(asked, lex).where("stage = 5").select("w").distinct())
    return cases.cast(mine, lex, "ÞGF", _preferences(lex.rows))


# The compatibility view.
def _deletions(rows: DataFrame) -> DataFrame:
    return rows.where("bin_id % 13 = 0").select("ord", "ofl", "hluti").distinct()


def _errata(rows: DataFrame) -> DataFrame:
    return rows.where("bin_id % 5 = 2").select("ord", "ofl", F.lit("ætt").alias("hluti")).distinct()


register("g_deletions", f"SELECT {FEW} FROM lexicon WHERE (ord, ofl, hluti) NOT IN (SELECT ord, ofl, hluti FROM lexicon WHERE bin_id % 13 = 0)")(lambda s, d: compat.without_deletions(r := derived.lexicon_rows(s, d), _deletions(r)).select(*BASIC))
register("g_errata", "SELECT ord, bin_id, ofl, CASE WHEN (ord, ofl) IN (SELECT ord, ofl FROM lexicon WHERE bin_id % 5 = 2) THEN 'ætt' ELSE hluti END AS hluti, bmynd, mark FROM lexicon")(lambda s, d: compat.corrected(r := derived.lexicon_rows(s, d), _errata(r)).select(*BASIC))


@register("g_recode", "SELECT bmynd, bin_id, CASE WHEN bin_id % 3 = 0 AND bin_id % 2 = 0 THEN 'töl' WHEN bin_id % 3 = 1 THEN 'abfn' WHEN bin_id % 3 = 2 THEN 'lo' ELSE 'to' END AS ofl, CASE WHEN bin_id % 2 = 0 THEN '-' ELSE mark END AS mark FROM lexicon")
def g_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("to"), F.lit("afn"), F.lit("rt")), F.pmod("bin_id", F.lit(3)) + 1)
    rows = derived.lexicon_rows(spark, sf_dir).withColumns({"ofl": raw, "mark": F.when(F.col("bin_id") % 2 == 0, "OBEYGJANLEGT").otherwise(F.col("mark"))})
    return compat.recode(rows).select("bmynd", "bin_id", "ofl", "mark")


#: The view's lexicon: some adjectives are ordinals, some neuter nouns reflexive pronouns or uninflected numerals.
G_ROWS = f"""mixed AS (SELECT * REPLACE (CASE WHEN ofl = 'lo' AND bin_id % 2 = 0 THEN 'rt' WHEN ofl = 'hk' AND bin_id % 3 = 0 THEN 'to' WHEN ofl = 'hk' AND bin_id % 3 = 1 THEN 'afn' ELSE ofl END AS ofl,
  CASE WHEN ofl = 'hk' AND bin_id % 3 = 0 AND mark = 'NFET' THEN 'OBEYGJANLEGT' ELSE mark END AS mark) FROM lexicon),
gone AS (SELECT DISTINCT ord, ofl, hluti FROM mixed WHERE bin_id % 13 = 0),
errata AS (SELECT DISTINCT ord, ofl FROM mixed WHERE bin_id % 5 = 2),
g AS MATERIALIZED (SELECT {ALL.replace('hluti', "CASE WHEN (ord, ofl) IN (SELECT ord, ofl FROM errata) THEN 'ætt' ELSE hluti END AS hluti")}, raw_ofl, raw_mark
  FROM (SELECT * REPLACE (CASE WHEN ofl = 'to' AND mark = 'OBEYGJANLEGT' THEN 'töl' WHEN ofl = 'afn' THEN 'abfn' WHEN ofl = 'rt' THEN 'lo' ELSE ofl END AS ofl, CASE WHEN mark = 'OBEYGJANLEGT' THEN '-' ELSE mark END AS mark), ofl AS raw_ofl, mark AS raw_mark FROM mixed ANTI JOIN gone USING (ord, ofl, hluti))),
g_prio AS MATERIALIZED (SELECT *, (bin_id = 0)::INT + (einkunn <> 1)::INT + (malsnid IN ('URE', 'SJALD', 'VILLA', 'GAM'))::INT + CASE WHEN ofl = 'so' THEN 4 * contains(mark, 'VH')::INT + 2 * contains(mark, 'ÞT')::INT + contains(mark, 'FT')::INT + contains(mark, '2P')::INT ELSE 0 END AS prio FROM g),
g_found AS MATERIALIZED (SELECT * FROM g_prio WHERE (bmynd, ord) NOT IN (SELECT bmynd, ord FROM lexicon WHERE bin_id % 4 = 1 AND bin_id % 3 = 0))"""
G_PLAIN = f"{G_ROWS}, rows_of AS MATERIALIZED (SELECT bmynd AS k, 0 AS r, {ALL}, prio AS distance FROM g_found)"
G_FIRST = "distance, "


def _g_cascade(s: bool = False, u: bool = False) -> str:
    return _cascade_sql(G_PLAIN, G_FIRST, f"SELECT w, w AS k, {s} AS s, {u} AS u, 0 AS r, NULL::INT AS id, NULL::VARCHAR AS lemma FROM words", ORDER_ALL)


def _g_lexicon(spark: SparkSession, sf_dir: str) -> lookups.Lexicon:
    lex = derived.lexicon(spark, sf_dir)
    hk, by_id = F.col("ofl") == "hk", lambda n: F.pmod("bin_id", F.lit(n))
    ofl = F.when((F.col("ofl") == "lo") & (by_id(2) == 0), "rt").when(hk & (by_id(3) == 0), "to").when(hk & (by_id(3) == 1), "afn").otherwise(F.col("ofl"))
    mixed = stored(lex.rows.withColumns({"ofl": ofl, "mark": F.when(hk & (by_id(3) == 0) & (F.col("mark") == "NFET"), "OBEYGJANLEGT").otherwise(F.col("mark"))}))
    worse = lex.rows.where("bin_id % 4 = 1 and bin_id % 3 = 0").groupBy(F.col("bmynd").alias("form")).agg(F.collect_set("ord").alias("worse"))
    return compat.compatible_view(dataclasses.replace(lex, rows=mixed), _deletions(mixed), _errata(mixed), worse)


def _g(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lookups.Lexicon]:
    return derived.query_words(spark, sf_dir), _g_lexicon(spark, sf_dir)


register("g_visible", f"{G_ROWS} SELECT w, {FEW} FROM words JOIN g ON bmynd = w WHERE birting <> 'S'")(lambda s, d: lookups.lookup_raw(*_g(s, d)).where("birting <> 'S'").select("w", *BASIC))
register("g_lookup", f"SELECT w, key, stage, rank, {ALL} FROM found", cascade=_g_cascade(u=True))(lambda s, d: lookups.lookup(*_g(s, d), auto_uppercase=True))
register("g_sentence_start", SELECT_FEW, cascade=_g_cascade(s=True))(lambda s, d: lookups.basic(lookups.lookup(*_g(s, d), at_sentence_start=True)))
register("g_stem_prefs", "SELECT DISTINCT w, ord, stage FROM found", cascade=_g_cascade())(lambda s, d: lookups.lookup(*_g(s, d)).select("w", "ord", "stage").distinct())
_G_CLASS = "[NULL, 'rt', 'lo', 'no'][length(w) % 4 + 1]"
register(
    "g_case",
    f"""{G_ROWS}, a_case AS (SELECT w, {_G_CLASS} AS class FROM words), plain_tag AS (SELECT raw_mark AS tag, replace(replace(replace(replace(replace(replace(raw_mark, 'NF', ''), 'ÞF', ''), 'ÞGF', ''), 'EF', ''), '2', ''), '3', '') AS plain FROM (SELECT DISTINCT raw_mark FROM g))
SELECT DISTINCT w, class, {', '.join('b.' + c for c in BASIC)} FROM a_case JOIN g a ON a.bmynd = w AND (class IS NULL OR a.raw_ofl = class OR (class = 'no' AND a.raw_ofl IN ('kk', 'kvk', 'hk'))) JOIN g b ON b.bin_id = a.bin_id AND b.ord = a.ord AND b.raw_ofl = a.raw_ofl AND contains(b.raw_mark, 'ÞGF') JOIN plain_tag x ON x.tag = a.raw_mark JOIN plain_tag y ON y.tag = b.raw_mark AND x.plain = y.plain""",
)(lambda s, d: cases.lookup_case((g := _g(s, d))[0].withColumn("class", F.get(F.array(F.lit(None), F.lit("rt"), F.lit("lo"), F.lit("no")), F.length("w") % 4)), g[1], "ÞGF"))
register("g_cast", _cast_sql("ÞGF", "g", "raw_", ""), cascade=_g_cascade())(lambda s, d: cases.cast((g := _g(s, d))[0], g[1], "ÞGF", _preferences(derived.lexicon_rows(s, d))))


register("g_priority", "SELECT bmynd, bin_id, mark, (bin_id = 0)::INT + (einkunn <> 1)::INT + (malsnid IN ('URE', 'SJALD', 'VILLA', 'GAM'))::INT + CASE WHEN ofl = 'so' THEN 4 * contains(mark, 'VH')::INT + 2 * contains(mark, 'ÞT')::INT + contains(mark, 'FT')::INT + contains(mark, '2P')::INT ELSE 0 END AS priority FROM lexicon")(
    lambda s, d: derived.lexicon_rows(s, d).select("bmynd", "bin_id", "mark", lookups.priority().alias("priority"))
)

# Words and their rendering, through the compatibility view.
_FIRST_FIELDS = "w, key, ord, hluti, bmynd, mark, ofl, bin_id"
_UNKNOWN = "SELECT w, w, w, 'alm', w, '', 'hk', 0 FROM words"
register("word_first", f"SELECT {_FIRST_FIELDS} FROM found WHERE rank = 1 UNION ALL {_UNKNOWN} ANTI JOIN found USING (w)", cascade=_g_cascade())(lambda s, d: words.first_entry((g := _g(s, d))[0], lookups.lookup(*g)))
register("word_attrs", f"n AS (SELECT * FROM found WHERE ofl IN ('kk', 'kvk', 'hk')), r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY rank) AS k FROM n) WHERE k = 1) SELECT {_FIRST_FIELDS} FROM r UNION ALL {_UNKNOWN} ANTI JOIN r USING (w)", cascade=_g_cascade(s=True))(
    lambda s, d: words.first_entry((g := _g(s, d))[0], lookups.lookup(*g, at_sentence_start=True), ("no",))
)
register("word_wrap", "SELECT bmynd AS w, bmynd AS key, ord, hluti, bmynd, mark, ofl, bin_id FROM lexicon")(lambda s, d: words.wrap(derived.lexicon_rows(s, d)))

#: What each class is asked for; the number is that of the request.
SPECS = (("kk", "þgf_ft"), ("kvk", "ef-gr"), ("hk", "þgf_ft"), ("lo", "kvk-ef"), ("so", "3p_ft_nt"), ("abfn", "ef_et"))
_SPEC_NUMBER = f"CASE ofl {' '.join(f"WHEN '{c}' THEN {n}" for n, (c, _) in enumerate(SPECS))} END"


def _renamed(sql: str, prefix: str) -> str:
    """The tables that two cascades of one statement both have, under other names."""
    return re.sub(r"\b(rows_of|live|made|asked|again|every|found|[sz]_\w+)\b", lambda m: prefix + m[0], sql)


@register(
    "word_format",
    f"SELECT f.w, coalesce(CASE WHEN f.w = upper(f.w) AND f.w <> lower(f.w) THEN upper(form) WHEN f.w[1] <> lower(f.w[1]) THEN upper(form[1]) || form[2:] ELSE lower(form) END, f.w) AS result FROM firsts f LEFT JOIN (SELECT v.w, CASE WHEN i.bin_id = 0 THEN replace(v.bmynd, '-', '') ELSE v.bmynd END AS form FROM found v JOIN firsts i USING (w) WHERE rank = 1) USING (w)",
    cascade=_renamed(_g_cascade(), "first_") + f", firsts AS MATERIALIZED (SELECT {_FIRST_FIELDS} FROM first_found WHERE rank = 1 UNION ALL {_UNKNOWN} ANTI JOIN first_found USING (w)), "
    + _cascade_sql(
        _variants_sql(*((f"'{c}'", (f,), False) for c, f in SPECS), rows="g", shown="g", mark="raw_mark"),
        "coalesce(distance, 999), ",
        f"SELECT w, w AS k, false AS s, false AS u, {_SPEC_NUMBER} AS r, bin_id AS id, NULL::VARCHAR AS lemma FROM firsts WHERE {_SPEC_NUMBER} IS NOT NULL AND mark <> ''",
        ORDER_ALL,
    ),
)
def word_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in a form that its class is asked for."""
    asked, lex = _g(spark, sf_dir)
    firsts = stored(words.first_entry(asked, lookups.lookup(asked, lex)))
    specs = spark.createDataFrame(list(SPECS), "ofl string, spec string")
    return words.format_words(firsts.join(F.broadcast(specs), "ofl", "left"), lex).select("w", "result")
