"""Grammatical variants: other forms of a word's lemmas with the requested features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.marks import atoms, bits, distance, mask, request_mask, requested, satisfies
from morphlake.operators.compounds import compound_plan
from morphlake.operators.lookups import Lexicon, cascade, opened, penalty, ranked, requests, visible
from morphlake.schema import AUGMENTED, GENDERS

#: What a row of a table of requests may say besides the word; null lemma and id are no conditions.
WISHES = ("class", "features", "lemma", "id")


def with_masks(lexicon: Lexicon, rows: DataFrame) -> DataFrame:
    """rows with the features of their tags as ``mask``, from the few distinct tags; a tag that can't be read has null and meets no request."""
    tags = rows.select(lexicon.raw("mark").alias("_mark")).distinct().withColumn("mask", mask(atoms(F.col("_mark"))))
    return rows.join(F.broadcast(tags), lexicon.raw("mark") == F.col("_mark")).drop("_mark")


def wishes(words: DataFrame, cat: str | None = None, features: tuple[str, ...] | None = None, lemma: str | None = None, bin_id: int | None = None) -> DataFrame:
    """words with the columns class, features, want (their set), lemma and id: as given in words, or else by the arguments.

    A table's features are read once for each different array.
    """
    out = words
    for name, value in (("class", cat), ("lemma", lemma)):
        out = out if name in words.columns else out.withColumn(name, F.lit(value).cast("string"))
    out = out if "id" in words.columns else out.withColumn("id", F.lit(bin_id).cast("int"))
    if "features" not in words.columns:
        return out.withColumns({"features": F.array(*[F.lit(x) for x in features or ()]).cast("array<string>"), "want": F.lit(bits(requested(features or ()))).cast("long")})
    sets = words.select("features").distinct().withColumn("want", request_mask(F.col("features")))
    return out.join(F.broadcast(sets), "features")


def variants_plan(lexicon: Lexicon, keep: Callable[[Column], Column] | None = None, any_id: bool = False, hidden_too: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The plan that turns keys (q, key, ...), whose requests q have wishes, into the variants' rows with ``distance``.

    A source row is a row of the key's form in the class (``no``: any gender), with the lemma and id where these are asked
    for (any_id: of any id).  Its variants are the visible rows of the same id that have all requested features; they keep
    the source's class.  distance compares a variant's features with those of all source rows of the key together.
    """
    fits = (lambda rows: rows.where(keep(lexicon.raw("mark")))) if keep is not None else (lambda rows: rows)
    source = fits(with_masks(lexicon, lexicon.rows)).select(F.col("bmynd").alias("_form"), F.col("bin_id").alias("_id"), lexicon.raw("ofl").alias("_ofl"), F.col("ord").alias("_lemma"), F.col("mask").alias("_mask"))
    target = fits(with_masks(lexicon, lexicon.rows if hidden_too else visible(lexicon))).dropDuplicates(list(AUGMENTED)).select(*AUGMENTED, "mask")
    wanted = F.lower("q.class")
    in_class = F.when(wanted == "no", F.col("_ofl").isin(*GENDERS)).otherwise(F.col("_ofl") == wanted)

    def plan(keys: DataFrame) -> DataFrame:
        same = (F.col("q.lemma").isNull() | (F.col("_lemma") == F.col("q.lemma"))) & (F.lit(any_id) | F.col("q.id").isNull() | (F.col("_id") == F.col("q.id")))
        found = keys.join(source, F.col("key") == F.col("_form")).where(in_class & same)
        by_key = found.groupBy(*keys.columns).agg(F.bit_or("_mask").alias("_all"), F.collect_set(F.struct(F.col("_id").alias("bin_id"), "_ofl")).alias("_ids"))
        ids = by_key.select(*keys.columns, "_all", F.explode("_ids").alias("_i")).select(*keys.columns, "_all", "_i.*")
        out = ids.join(target, "bin_id").where(satisfies(F.col("mask"), F.col("q.want")))
        shown = F.col("ofl") if lexicon.compatible else F.col("_ofl")
        return out.withColumns({"ofl": shown, "distance": distance(F.col("mask"), F.col("_all"))}).select(*keys.columns, *AUGMENTED, "distance")

    return plan


def _asked(words: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """found with those wishes in columns that words has."""
    return opened(found, words, *[f"q.{x}" for x in WISHES if x in words.columns], *columns)


def variants_raw(words: DataFrame, lexicon: Lexicon, cat: str | None = None, features: tuple[str, ...] | None = None, lemma: str | None = None, bin_id: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(w, distance, fields), without fallbacks; see lookup_variants for tables of requests."""
    asked = requests(wishes(words, cat, features, lemma, bin_id), more=(*WISHES, "want")).withColumn("key", F.col("w")).select("q", "key")
    return _asked(words, variants_plan(lexicon, keep, hidden_too=True)(asked), "distance", *AUGMENTED)


def lookup_variants(words: DataFrame, lexicon: Lexicon, cat: str | None = None, features: tuple[str, ...] | None = None, lemma: str | None = None, bin_id: int | None = None, keep: Callable[[Column], Column] | None = None, add_compounds: bool = True, **options) -> DataFrame:
    """(w, key, stage, rank, distance, fields): the variants through the whole cascade.

    words may be a table of requests, with the columns class, features (an array), lemma and id in place of the arguments;
    the result then has those too, and all requests are answered by one plan.  An unknown feature is an error.
    An unfulfilled request falls through to the later stages like a missing word; constructed entries have no distance and
    come last.  Within compounds the id is no condition, because the compound has none.  Order: correct forms, then
    distance (the compatibility view: distance alone).
    """
    plan = variants_plan(lexicon, keep)
    base = lambda keys: plan(keys).where("birting <> 'S'")
    extra = ("distance",)
    compounds = compound_plan(lexicon, variants_plan(lexicon, keep, any_id=True), extra) if add_compounds and lexicon.parts is not None else None
    found = cascade(wishes(words, cat, features, lemma, bin_id), lexicon, base, compounds, extra=extra, more=(*WISHES, "want"), **options)
    far = F.coalesce("distance", F.lit(999))
    first = [far] if lexicon.compatible else [penalty(), far]
    return _asked(words, ranked(found, lexicon, ["q"], first), "key", "stage", "rank", "distance", *AUGMENTED)
