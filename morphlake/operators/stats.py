"""Indexes and statistics of a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.schema import EXTRA
from morphlake.storage import numbered


def value_index(rows: DataFrame, col: str, *place: str) -> DataFrame:
    """(value, ix): dense numbers of the distinct values from 0, by where they are first seen: the least ``place`` of their rows, such as file and line."""
    first = rows.groupBy(F.col(col).alias("value")).agg(F.min(F.struct(*place)).alias("_first"))
    return numbered(first, ["_first", "value"], "_n").select("value", (F.col("_n") - 1).cast("int").alias("ix"))


def meaning_ranks(rows: DataFrame, *place: str) -> DataFrame:
    """(ofl, mark, n, ix): the (class, tag) pairs by falling frequency, equally frequent ones by where they are first seen."""
    n = rows.groupBy("ofl", "mark").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("_first"))
    return numbered(n.withColumn("_less", -F.col("n")), ["_less", "_first"], "_n").select("ofl", "mark", "n", (F.col("_n") - 1).cast("int").alias("ix"))


def lemmas_by_class(rows: DataFrame, order: tuple[str, ...] = ("bmynd", "mark")) -> DataFrame:
    """(ofl, n): how many ids have their first row in each class."""
    first = rows.groupBy("bin_id").agg(F.min_by("ofl", F.struct(*order)).alias("ofl"))
    return first.groupBy("ofl").agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    extra = F.concat_ws(";", *[F.when(F.col(c) == 0, "").otherwise(F.col(c).cast("string")) if c == "millivisun" else F.col(c).cast("string") for c in EXTRA])
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("bmynd").alias("n_forms"),
        F.countDistinct("bin_id").alias("n_lemmas"),
        F.countDistinct("hluti").alias("n_domains"),
        F.countDistinct("ofl", "mark").alias("n_meanings"),
        F.countDistinct(extra).alias("n_extras"),
    )


def alphabet(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("bmynd", "")).alias("letter")).where("letter <> ''").distinct()


def id_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("bin_id").alias("min_id"), F.max("bin_id").alias("max_id"))


def paradigm_forms(rows: DataFrame) -> DataFrame:
    """(bin_id, forms): the sorted forms of an id that differ from its lemma, joined by commas."""
    forms = F.array_sort(F.collect_set(F.when(F.col("bmynd") != F.col("ord"), F.col("bmynd"))))
    return rows.groupBy("bin_id").agg(F.array_join(forms, ",").alias("forms"))


def common_prefix(a, b):
    """Length of the longest common prefix of two strings, as a Column."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(a, k) == F.left(b, k))
    return F.array_max(same)


def paradigm_templates(rows: DataFrame) -> DataFrame:
    """(signature, n): inflection patterns and how many ids have them.

    A pattern is, for each form in order, how much of the form before it (first: of the lemma) is cut off and what is added.
    """
    p = rows.groupBy("bin_id").agg(F.first("ord").alias("ord"), F.array_sort(F.collect_set(F.when(F.col("bmynd") != F.col("ord"), F.col("bmynd")))).alias("forms"))
    before = lambda i: F.when(i == 0, F.col("ord")).otherwise(F.get("forms", i - 1))
    step = lambda w, i: F.concat((F.length(before(i)) - common_prefix(before(i), w)).cast("string"), F.lit(":"), F.substr(w, common_prefix(before(i), w) + 1))
    return p.select(F.array_join(F.transform("forms", step), "/").alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def entries_by_id(rows: DataFrame) -> DataFrame:
    """(bmynd, bin_id, n): the entries of each form by id."""
    return rows.groupBy("bmynd", "bin_id").agg(F.count(F.lit(1)).alias("n"))


def forms_of_same_lemma(keys: DataFrame, rows: DataFrame, case: str) -> DataFrame:
    """(w, bin_id, bmynd, mark): all forms with ``case`` in their tag of the ids that a key is a form of."""
    ids = keys.select("w").join(rows.select(F.col("bmynd").alias("w"), "bin_id"), "w").distinct()
    return ids.join(rows.where(F.contains("mark", F.lit(case))).select("bin_id", "bmynd", "mark"), "bin_id").distinct()
