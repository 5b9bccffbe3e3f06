"""Cleaning of parsed lexicon rows.  ``clean`` applies all steps in order; each one is an operator of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.functions.marks import base_mark
from morphlake.functions.text import is_upper
from morphlake.schema import AUGMENTED

# Lemmas whose single-letter forms are right.
SINGLE_LETTER_LEMMAS = ("ýr", "ær", "eiga")
SUSPICIOUS = r"[+@\\_åø]"
# Forms that are no words, and repairs (lemma, id, what to do, with what, by what).
STOP_FORMS = ("a", "num", "i", "ir", "in", "ina", "irnar", "irnir")
REPAIRS = (
    ("sem að", 495372, "lemma", "sem", None),
    ("hvort að", 495365, "lemma", "hvort", None),
    ("árekstrarvörn", 540745, "only_prefix", "árekstrar", None),
    ("dínamítsprenging", 508550, "replace", "dýnamít", "dínamít"),
    ("fullleiksviðslegur", 509413, "prefix", "full", None),
    ("fullmenntaskólalegur", 509414, "prefix", "full", None),
    ("fulltæfulegur", 509415, "prefix", "full", None),
    ("fullviðkvæmnislegur", 509416, "prefix", "full", None),
    ("illinnheimtanlegur", 509831, "prefix", "ill", None),
    ("Norður-Landeyjar", 488593, "replace", "Norð-Vestur", "Norður"),
    ("Norður-Landeyjar", 488593, "replace", "Norð-vestur", "Norður"),
)

#: Repairs by (ord, bin_id): what to do with which values; a stop list of forms is a parameter of ``required``.
REPAIR_KINDS = ("lemma", "prefix", "replace", "only_prefix")


def required(rows: DataFrame, stop_forms: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a lemma and a form that isn't on the stop list."""
    out = rows.where((F.col("ord") != "") & (F.col("bmynd") != ""))
    return out.where(~F.col("bmynd").isin(*stop_forms)) if stop_forms else out


def known_repairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPAIRS, "ord string, bin_id int, kind string, a string, b string")


def repair(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Apply repairs (ord, bin_id, kind, a, b), of which an entry may have several; adds ``exempt`` for rows that the next three checks leave alone.

    lemma: lemma and form become a.  prefix: the form gets the prefix a where it lacks it.  replace: a becomes b within the
    form.  only_prefix: rows whose form doesn't begin with a go, the others are exempt.
    """
    r = repairs.groupBy(F.col("ord").alias("_ord"), F.col("bin_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("kind", "a", "b"))).alias("_r"))
    out = rows.join(r, (F.col("ord") == F.col("_ord")) & (F.col("bin_id") == F.col("_id")), "left").withColumn("_r", F.coalesce("_r", F.array().cast(r.schema["_r"].dataType)))
    form = F.col("bmynd")

    def fixed(x: Column, rule: Column) -> Column:
        kind, a = rule["kind"], rule["a"]
        return F.when(kind == "lemma", a).when((kind == "prefix") & ~x.startswith(a), F.concat(a, x)).when(kind == "replace", F.replace(x, a, rule["b"])).otherwise(x)

    of_kind = lambda kind: F.filter("_r", lambda rule: rule["kind"] == kind)
    only, lemma = F.size(of_kind("only_prefix")) > 0, F.get(of_kind("lemma"), 0)["a"]
    kept = out.where(F.forall(of_kind("only_prefix"), lambda rule: form.startswith(rule["a"])))
    return kept.withColumns({"bmynd": F.aggregate("_r", form, fixed), "ord": F.coalesce(lemma, F.col("ord")), "exempt": only}).drop("_ord", "_id", "_r")


def same_capitals(rows: DataFrame) -> DataFrame:
    return rows.where(is_upper(F.left("ord", F.lit(1))) == is_upper(F.left("bmynd", F.lit(1))))


def no_single_letters(rows: DataFrame) -> DataFrame:
    return rows.where(~((F.length("bmynd") == 1) & (F.length("ord") > 1) & ~F.col("ord").isin(*SINGLE_LETTER_LEMMAS)))


def no_triple_t(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("bmynd").endswith("ttt"))


def legal_marks(rows: DataFrame, mark_order: DataFrame) -> DataFrame:
    """Rows whose tag is listed for their class; an unknown class is an error."""
    classes = mark_order.select(F.col("ofl").alias("_class")).distinct()
    known = rows.join(F.broadcast(classes), F.col("ofl") == F.col("_class"), "left")
    error = F.raise_error(F.concat(F.lit("unknown class: "), F.col("ofl")))
    checked = known.withColumn("ofl", F.when(F.col("_class").isNull(), error.cast("string")).otherwise(F.col("ofl"))).drop("_class")
    # The legal tags are a fixed small table.
    marks = mark_order.select(F.col("ofl").alias("_o"), F.col("mark").alias("_m")).distinct()
    return checked.join(F.broadcast(marks), (F.col("ofl") == F.col("_o")) & (base_mark(F.col("mark")) == F.col("_m")), "left_semi")


def latin1_only(rows: DataFrame) -> DataFrame:
    out = rows
    for c in ("ord", "ofl", "hluti", "bmynd", "mark", "malsnid"):
        out = out.where(F.col(c).rlike(r"^[\x00-\xFF]*$"))
    return out


def no_suspicious_letters(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("bmynd").rlike(SUSPICIOUS))


def one_lemma(rows: DataFrame) -> DataFrame:
    """Rows whose lemma is the first one of their id, by file and line."""
    first = F.first("ord").over(Window.partitionBy("bin_id").orderBy("file_no", "line_no"))
    return rows.withColumn("_first", first).where(F.col("ord") == F.col("_first")).drop("_first")


def one_domain(rows: DataFrame) -> DataFrame:
    """Every row gets the first domain of its id."""
    return rows.withColumn("hluti", F.first("hluti").over(Window.partitionBy("bin_id").orderBy("file_no", "line_no")))


def distinct_rows(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(list(AUGMENTED))


def clean(rows: DataFrame, mark_order: DataFrame, repairs: DataFrame, stop_forms: tuple[str, ...] = ()) -> DataFrame:
    """All steps; rows are (file_no, line_no, the fifteen fields)."""
    fixed = repair(required(rows, stop_forms), repairs)
    exempt, others = fixed.where("exempt"), fixed.where("not exempt")
    checked = exempt.unionByName(no_triple_t(no_single_letters(same_capitals(others)))).drop("exempt")
    kept = no_suspicious_letters(latin1_only(legal_marks(checked, mark_order)))
    return distinct_rows(one_domain(one_lemma(kept))).select(*AUGMENTED)
