"""A word with its first entry, and its rendering in a requested form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.functions.marks import requested
from morphlake.functions.text import is_upper, like_case
from morphlake.operators.lookups import Lexicon
from morphlake.operators.variants import lookup_variants
from morphlake.schema import GENDERS


def first_entry(words: DataFrame, found: DataFrame, classes: tuple[str, ...] | None = None) -> DataFrame:
    """(w, key, ord, hluti, bmynd, mark, ofl, bin_id): the first entry of the classes, or defaults for an unknown word."""
    if classes is not None:
        wanted = tuple(g for c in classes for g in (GENDERS if c == "no" else (c,)))
        found = found.where(F.col("ofl").isin(*wanted))
    best = found.groupBy("w").agg(F.min_by(F.struct("key", "ord", "hluti", "bmynd", "mark", "ofl", "bin_id"), "rank").alias("e"))
    out = words.select("w").distinct().join(best, "w", "left")
    key = F.coalesce("e.key", "w")
    return out.select(
        "w",
        key.alias("key"),
        F.coalesce("e.ord", key).alias("ord"),
        F.coalesce("e.hluti", F.lit("alm")).alias("hluti"),
        F.coalesce("e.bmynd", "w").alias("bmynd"),
        F.coalesce("e.mark", F.lit("")).alias("mark"),
        F.coalesce("e.ofl", F.lit("hk")).alias("ofl"),
        F.coalesce("e.bin_id", F.lit(0)).alias("bin_id"),
    )


def wrap(entries: DataFrame) -> DataFrame:
    """(w, key, ord, hluti, bmynd, mark, ofl, bin_id): each lexicon row as a word of its own."""
    return entries.select(F.col("bmynd").alias("w"), F.col("bmynd").alias("key"), "ord", "hluti", "bmynd", "mark", "ofl", "bin_id")


def format_words(firsts: DataFrame, lexicon: Lexicon, spec: str | None = None) -> DataFrame:
    """(w, result): words in the form that spec asks for, from their first entries (w, bin_id, ofl, mark, ...).

    Features are separated by hyphens or underscores.  firsts may have a column spec instead, which the result has too; an
    empty or null one changes nothing, and an unknown feature is an error.  The variants are of the entry's class and id; an
    entry that was constructed has no id, so only compounds of the word can give it.  A word without entry (its mark is
    empty) or without such a form stays as it is; the result takes the word's letter case, and constructed forms lose their hyphens.
    """
    if spec is not None:
        requested((spec,))
    more = ["spec"] if spec is None else []
    asked = firsts.select("w", "bin_id", "ofl", "mark", (F.lit(spec) if spec is not None else F.coalesce("spec", F.lit(""))).alias("spec"))
    features = F.transform(F.split("spec", "[-_]"), F.trim)
    wishes = asked.where("mark <> '' and spec <> ''").select("w", "spec", F.col("ofl").alias("class"), F.col("bin_id").alias("id"), features.alias("features"), F.lit(None).cast("string").alias("lemma"))
    found = lookup_variants(wishes.drop("spec"), lexicon).where("rank = 1").select("w", "class", "id", "features", "bmynd")
    best = wishes.drop("lemma").join(found, ["w", "class", "id", "features"]).select("w", "spec", F.when(F.col("id") == 0, F.replace("bmynd", F.lit("-"), F.lit(""))).otherwise(F.col("bmynd")).alias("form"))
    model = F.col("w")
    form = F.when(is_upper(F.left(model, F.lit(1))), like_case(F.col("form"), model)).otherwise(F.lower("form"))
    return asked.join(best, ["w", "spec"], "left").select("w", *more, F.coalesce(form, model).alias("result"))
