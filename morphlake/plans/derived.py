"""A lexicon and query words derived from the tables ``benchmark`` and ``documents``.

The stems are the benchmark's words; a small inflection pattern for each class gives their forms.  Query words are all
distinct words of the documents, and the lexicon's forms with their spelling changed so that every stage is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.text import upper_first
from morphlake.operators.lookups import Lexicon
from morphlake.schema import AUGMENTED
from morphlake.sources.lexicon_table import read_lexicon, write_lexicon
from morphlake.storage import numbered, stored

LETTERS = "a-zþæöðáéíóúý"
SHORTEST, LONGEST = 4, 12
CAPITAL = 29

_lexicons: dict[tuple[str, str], Lexicon] = {}
_words: dict[tuple[str, str], DataFrame] = {}

# Inflection patterns, by class: lemma ending, then endings in the order of the tags.
NOUN_TAGS = [f"{case}{number}{gr}" for number in ("ET", "FT") for gr in ("", "gr") for case in ("NF", "ÞF", "ÞGF", "EF")]
PATTERNS = {
    "kk": ("ur", dict(zip(NOUN_TAGS, ("ur", "", "i", "s", "urinn", "inn", "inum", "sins", "ar", "a", "um", "a", "arnir", "ana", "unum", "anna"), strict=True)) | {"ÞGFET2": ""}),
    "kvk": ("", dict(zip(NOUN_TAGS, ("", "", "", "ar", "in", "ina", "inni", "arinnar", "ir", "ir", "um", "a", "irnar", "irnar", "unum", "anna"), strict=True))),
    "hk": ("", dict(zip(NOUN_TAGS, ("", "", "i", "s", "ið", "ið", "inu", "sins", "", "", "um", "a", "in", "in", "unum", "anna"), strict=True))),
    "lo": (
        "ur",
        {
            "FSB-KK-NFET": "ur", "FSB-KK-ÞFET": "an", "FSB-KK-ÞGFET": "um", "FSB-KK-EFET": "s", "FSB-KK-NFFT": "ir", "FSB-KVK-NFET": "", "FSB-KVK-ÞFET": "a", "FSB-KVK-ÞGFET": "ri",
            "FSB-HK-NFET": "t", "FSB-HK-ÞFET": "t", "FVB-KK-NFET": "i", "FVB-KK-ÞFET": "a", "FVB-KK-ÞGFET": "a", "FVB-KVK-NFET": "a", "MST-KK-NFET": "ari", "ESB-KK-NFET": "astur", "EVB-KK-NFET": "asti", "EVB-KK-ÞFET": "asta",
        },
    ),
    "so": (
        "a",
        {
            "GM-NH": "a", "GM-FH-NT-1P-ET": "a", "GM-FH-NT-2P-ET": "ar", "GM-FH-NT-3P-ET": "ar", "GM-FH-NT-1P-FT": "um", "GM-FH-NT-2P-FT": "ið", "GM-FH-NT-3P-FT": "a", "GM-FH-ÞT-1P-ET": "aði",
            "GM-FH-ÞT-3P-FT": "uðu", "GM-VH-NT-3P-ET": "i", "MM-NH": "ast", "MM-FH-NT-3P-ET": "ast", "LHNT": "andi", "GM-SAGNB": "að",
        },
    ),
}
CLASSES = tuple(PATTERNS)
TAGS = [(ofl, tag, pos) for ofl, (_, tags) in PATTERNS.items() for pos, tag in enumerate(tags)]
FORMS = [(ofl, base, ending, tag, 2 if tag.endswith("2") else 1) for ofl, (base, tags) in PATTERNS.items() for tag, ending in tags.items()]
# Adjective endings of the template.
TEMPLATE = [("legur", "FSB-KK-NFET"), ("legan", "FSB-KK-ÞFET"), ("legum", "FSB-KK-ÞGFET"), ("legs", "FSB-KK-EFET"), ("leg", "FSB-KVK-NFET"), ("lega", "FSB-KVK-ÞFET"), ("legt", "FSB-HK-NFET"), ("legi", "FVB-KK-NFET"), ("lega", "FVB-KK-ÞFET")]
DOMAINS = ("alm", "ism", "örn", "föð")
REGISTERS = ("", "URE", "", "GAM", "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stems(benchmark: DataFrame) -> DataFrame:
    """(stem, id): the distinct words of the benchmark with 4 to 12 letters, numbered in order.

    Every 29th is instead the stem before it with a capital, so that some words have entries in both spellings.
    """
    words = benchmark.select(F.explode(F.split(F.lower("text"), f"[^{LETTERS}]+")).alias("stem")).where(F.length("stem").between(SHORTEST, LONGEST)).distinct()
    placed = numbered(words, ["stem"], "id").withColumn("id", F.col("id").cast("int"))
    before = placed.where(F.pmod(F.col("id") + 1, F.lit(CAPITAL)) == 0).select((F.col("id") + 1).alias("id"), upper_first(F.col("stem")).alias("_name"))
    return placed.join(before, "id", "left").select(F.coalesce("_name", "stem").alias("stem"), "id")


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir).rows


def _made_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = spark.createDataFrame(FORMS, "ofl string, base string, ending string, mark string, beinkunn int")
    s = stems(read(spark, sf_dir, "benchmark")).withColumn("ofl", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.pmod("id", F.lit(len(CLASSES))) + 1))
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("id"), F.lit(n)) + 1)
    origin = F.when(F.pmod("id", F.lit(17)) == 0, "V").when(F.pmod("id", F.lit(19)) == 0, "G").when(F.pmod("id", F.lit(23)) == 0, "S").otherwise("K")
    out = s.join(F.broadcast(forms), "ofl").select(
        F.concat("stem", "base").alias("ord"),
        F.col("id").alias("bin_id"),
        "ofl",
        pick(DOMAINS, len(DOMAINS)).alias("hluti"),
        F.when(F.pmod("id", F.lit(11)) == 0, 2).otherwise(1).alias("einkunn"),
        pick(REGISTERS, len(REGISTERS)).alias("malsnid"),
        F.lit("").alias("malfraedi"),
        F.lit(0).alias("millivisun"),
        origin.alias("birting"),
        F.concat("stem", "ending").alias("bmynd"),
        "mark",
        "beinkunn",
        F.lit("").alias("bmalsnid"),
        F.lit("").alias("bgildi"),
        F.lit("").alias("aukafletta"),
    )
    return out.select(*AUGMENTED)


def parts(rows: DataFrame) -> DataFrame:
    """(part, is_prefix, is_suffix): genitives of even ids and their stems begin compounds, forms of nouns end them."""
    begins = rows.where((F.col("bin_id") % 2 == 0) & F.col("mark").isin("EFET", "ÞFET")).select(F.col("bmynd").alias("part"), F.lit(True).alias("p"), F.lit(False).alias("s"))
    ends = rows.where((F.col("bin_id") % 3 == 0) & F.col("ofl").isin("kk", "hk", "kvk")).select(F.col("bmynd").alias("part"), F.lit(False).alias("p"), F.lit(True).alias("s"))
    return begins.unionByName(ends).groupBy("part").agg(F.bool_or("p").alias("is_prefix"), F.bool_or("s").alias("is_suffix"))


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The derived lexicon; it is made and stored once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lexicons:
        _lexicons[key] = _make(spark, sf_dir)
    return _lexicons[key]


def _make(spark: SparkSession, sf_dir: str) -> Lexicon:
    made = stored(_made_rows(spark, sf_dir))
    last = made.agg(F.max("bin_id")).first()[0] or 0
    order = spark.createDataFrame(TAGS, "ofl string, mark string, pos int")
    template = spark.createDataFrame([(e, m, i) for i, (e, m) in enumerate(TEMPLATE)], "ending string, mark string, seq int")
    return read_lexicon(spark, write_lexicon(made, order, last * 9 // 10 + 1, template), stored(parts(made)))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w): the distinct words of all documents, as written."""
    letters = LETTERS + "A-ZÞÆÖÐÁÉÍÓÚÝ"
    return read(spark, sf_dir, "documents").select(F.explode(F.split("text", f"[^{letters}]+")).alias("w")).where("w <> ''").distinct()


def changed_words(rows: DataFrame) -> DataFrame:
    """(w): forms in other spellings."""
    form = F.col("bmynd")
    spellings = F.array(
        F.concat(F.upper(F.left(form, F.lit(1))), F.substr(form, F.lit(2))),
        F.concat(F.lit("ó"), form),
        F.replace(form, F.lit("s"), F.lit("z")),
        F.concat(form, F.lit("legur")),
        F.concat(F.lit("gamal-"), form),
        F.concat(F.lit("hin "), form),
    )
    return rows.select(F.explode(spellings).alias("w")).distinct()


def glued_words(rows: DataFrame) -> DataFrame:
    """(w): the genitive of each id before the forms of the next one."""
    first = rows.where("mark = 'EFET'").select((F.col("bin_id") + 1).alias("bin_id"), F.col("bmynd").alias("a"))
    return first.join(rows.where(F.col("ofl").isin("kk", "hk", "kvk")), "bin_id").select(F.concat("a", "bmynd").alias("w")).distinct()


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w): document words, forms, changed and glued forms; stored once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _words:
        _words[key] = stored(_made_words(spark, sf_dir, lexicon_rows(spark, sf_dir)))
    return _words[key]


def _made_words(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return document_words(spark, sf_dir).unionByName(rows.select(F.col("bmynd").alias("w"))).unionByName(changed_words(rows)).unionByName(glued_words(rows)).distinct()


def _values(rows: list[tuple]) -> str:
    lit = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def _pick(values: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[id % {len(values)} + 1]"


#: The same tables in DuckDB's SQL: stems, lexicon, bound, shown, mark_order, template, parts, doc_words, words.
SQL = f"""
small_stems AS (SELECT stem, CAST(row_number() OVER (ORDER BY stem) AS INTEGER) AS id FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^{LETTERS}]+')) AS stem FROM benchmark) WHERE length(stem) BETWEEN {SHORTEST} AND {LONGEST}),
stems AS (SELECT CASE WHEN a.id % {CAPITAL} = 0 AND b.stem IS NOT NULL THEN upper(b.stem[1]) || b.stem[2:] ELSE a.stem END AS stem, a.id FROM small_stems a LEFT JOIN small_stems b ON b.id = a.id - 1),
forms(ofl, base, ending, mark, beinkunn) AS (VALUES {_values(FORMS)}),
mark_order(ofl, mark, pos) AS (VALUES {_values(TAGS)}),
template(ending, mark) AS (VALUES {_values(TEMPLATE)}),
lexicon AS MATERIALIZED (SELECT stem || base AS ord, id AS bin_id, ofl, {_pick(DOMAINS)} AS hluti, CASE WHEN id % 11 = 0 THEN 2 ELSE 1 END AS einkunn, {_pick(REGISTERS)} AS malsnid, '' AS malfraedi, 0 AS millivisun,
  CASE WHEN id % 17 = 0 THEN 'V' WHEN id % 19 = 0 THEN 'G' WHEN id % 23 = 0 THEN 'S' ELSE 'K' END AS birting, stem || ending AS bmynd, mark, beinkunn, '' AS bmalsnid, '' AS bgildi, '' AS aukafletta
  FROM (SELECT *, {_pick(CLASSES)} AS ofl FROM stems) JOIN forms USING (ofl)),
bound AS (SELECT max(bin_id) * 9 // 10 + 1 AS first_local FROM lexicon),
shown AS MATERIALIZED (SELECT * FROM lexicon, bound WHERE (bin_id < first_local AND birting <> 'G') OR birting = 'S'),
parts AS MATERIALIZED (SELECT part, bool_or(p) AS is_prefix, bool_or(s) AS is_suffix FROM (SELECT bmynd AS part, true AS p, false AS s FROM lexicon WHERE bin_id % 2 = 0 AND mark IN ('EFET', 'ÞFET') UNION ALL SELECT bmynd, false, true FROM lexicon WHERE bin_id % 3 = 0 AND ofl IN ('kk', 'hk', 'kvk')) GROUP BY part),
doc_words AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(text, '[^{LETTERS}A-ZÞÆÖÐÁÉÍÓÚÝ]+')) AS w FROM documents) WHERE w <> ''),
changed AS (SELECT DISTINCT unnest([upper(bmynd[1]) || bmynd[2:], 'ó' || bmynd, replace(bmynd, 's', 'z'), bmynd || 'legur', 'gamal-' || bmynd, 'hin ' || bmynd]) AS w FROM lexicon),
glued AS (SELECT DISTINCT a.bmynd || b.bmynd AS w FROM lexicon a JOIN lexicon b ON b.bin_id = a.bin_id + 1 WHERE a.mark = 'EFET' AND b.ofl IN ('kk', 'hk', 'kvk')),
words AS MATERIALIZED (SELECT w FROM doc_words UNION SELECT bmynd FROM lexicon UNION SELECT w FROM changed UNION SELECT w FROM glued)"""
