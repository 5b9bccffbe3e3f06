"""Case operators: the forms of a word in another case, and casting a word to a case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.marks import simplify
from morphlake.functions.text import after_last, before_last, is_upper, like_case
from morphlake.operators.lookups import Lexicon, basic, lookup, ranked, visible_basic
from morphlake.schema import AUGMENTED, BASIC, GENDERS

CASES = {"NF": "nominative", "ÞF": "accusative", "ÞGF": "dative", "EF": "genitive"}
#: What a row of a table of case requests may say besides the word; null class, lemma and id are no conditions.
CASE_OPTIONS = {"case": "string", "singular": "boolean", "indefinite": "boolean", "all_forms": "boolean", "class": "string", "lemma": "string", "id": "int"}


def plain_tags(lexicon: Lexicon) -> DataFrame:
    """(_mark, _number, _definite, _plain): what remains of each distinct tag under each of the four options."""
    either = F.array(F.lit(False), F.lit(True))
    tags = lexicon.rows.select(lexicon.raw("mark").alias("_mark")).distinct()
    each = tags.withColumn("_number", F.explode(either)).withColumn("_definite", F.explode(either))
    return each.withColumn("_plain", simplify(F.col("_mark"), F.col("_number"), F.col("_definite")))


def case_rows(asked: DataFrame, lexicon: Lexicon, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """asked with the rows in the case that belong to each of its requests: the columns CASE_OPTIONS and w, and any others.

    The result has asked's columns, ``raw_class``, and the six basic fields; a request's rows may be repeated.
    """
    tags = F.broadcast(plain_tags(lexicon))
    number, definite = F.col("singular") | F.col("all_forms"), F.col("indefinite") | F.col("all_forms")
    one = lexicon.rows.select(F.col("bmynd").alias("_form"), F.col("bin_id").alias("_id"), F.col("ord").alias("_ord"), lexicon.raw("ofl").alias("_ofl"), lexicon.raw("mark").alias("_mark")).distinct()
    in_class = F.col("class").isNull() | F.when(F.col("class") == "no", F.col("_ofl").isin(*GENDERS)).otherwise(F.col("_ofl") == F.col("class"))
    same = (F.col("lemma").isNull() | (F.col("_ord") == F.col("lemma"))) & (F.col("id").isNull() | (F.col("_id") == F.col("id")))
    source = asked.join(one, F.col("w") == F.col("_form")).where(in_class & same).withColumns({"_number": number, "_definite": definite})
    source = source.join(tags, ["_mark", "_number", "_definite"]).drop("_form", "_mark").withColumnRenamed("_plain", "_like")
    rows = lexicon.rows.select(*BASIC, lexicon.raw("ofl").alias("raw_class"), lexicon.raw("mark").alias("_mark")).distinct()
    rows = rows if lexicon.compatible else rows.where(F.col("bin_id") < lexicon.first_local_id)
    rows = rows if keep is None else rows.where(keep(F.col("_mark")))
    mark = F.col("_mark")
    has = lambda part: F.contains(mark, F.lit(part))
    both = source.join(rows, (F.col("_id") == F.col("bin_id")) & (F.col("_ord") == F.col("ord")) & (F.col("_ofl") == F.col("raw_class"))).where(F.contains(mark, F.col("case")))
    both = both.where(F.col("all_forms") | ((~F.col("singular") | has("ET")) & (~F.col("indefinite") | ~(has("gr") | has("FVB") | has("EVB")))))
    alike = both.join(tags, ["_mark", "_number", "_definite"]).where("_plain = _like")
    return alike.select(*asked.columns, "raw_class", *BASIC)


def case_requests(words: DataFrame, **given) -> DataFrame:
    """words with all of CASE_OPTIONS: as columns of words, or else by the arguments."""
    return words.withColumns({name: F.lit(given.get(name, False if kind == "boolean" else None)).cast(kind) for name, kind in CASE_OPTIONS.items() if name not in words.columns})


def lookup_case(words: DataFrame, lexicon: Lexicon, case: str | None = None, singular: bool = False, indefinite: bool = False, all_forms: bool = False, cat: str | None = None, lemma: str | None = None, bin_id: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(w, the six basic fields): rows of the same id, lemma and class in the case whose tag is otherwise the source's.

    singular and indefinite restrict the result and leave number or definiteness out of the comparison; all_forms leaves
    both out and restricts nothing.  words may be a table of requests with any of the columns case (NF, ÞF, ÞGF or EF),
    singular, indefinite, all_forms, class, lemma and id, in place of the arguments; the result then has them too.
    """
    wanted = [x for x in CASE_OPTIONS if x in words.columns]
    asked = case_requests(words.select("w", *wanted).distinct(), case=case, singular=singular, indefinite=indefinite, all_forms=all_forms, lemma=lemma, id=bin_id, **{"class": cat})
    return case_rows(asked, lexicon, keep).select("w", *wanted, *BASIC).distinct()


def lookup_forms(words: DataFrame, lexicon: Lexicon, cat: str, case: str) -> DataFrame:
    """(w, basic fields): all forms in a case of the lemma w of the class; an unknown case has none."""
    case = case.upper().replace("GR", "gr")
    if case not in CASES:
        return words.select("w").join(lexicon.rows.select(*BASIC), F.lit(False)).select("w", *BASIC)
    asked = words.select("w").distinct().withColumn("lemma", F.col("w"))
    return lookup_case(asked, lexicon, case, all_forms=True, cat=cat).select("w", *BASIC)


def raw_nominative(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(w, basic fields): every nominative row of every form of every lemma of w, whichever lemma the row is of."""
    ids = words.select("w").distinct().join(lexicon.rows.select(F.col("bmynd").alias("w"), "bin_id"), "w").select("w", "bin_id").distinct()
    forms = ids.join(lexicon.rows.select("bin_id", F.explode(F.array("bmynd", "ord")).alias("bmynd")).distinct(), "bin_id").select("w", "bmynd").distinct()
    rows = visible_basic(lexicon).where(F.contains("mark", F.lit("NF"))).select(*BASIC).distinct()
    return forms.join(rows, "bmynd").select("w", *BASIC).distinct()


def preference_score(rows: DataFrame, preferences: DataFrame) -> DataFrame:
    """Add ``score``: how much the gender is preferred for the last part of the form, 0 where nothing says so."""
    p = preferences.select(F.col("form").alias("_form"), F.col("gender").alias("_gender"), F.col("score").alias("_score"))
    out = rows.join(p, (after_last(F.col("bmynd"), "-") == F.col("_form")) & (F.col("ofl") == F.col("_gender")), "left")
    return out.withColumn("score", F.coalesce("_score", F.lit(0))).drop("_form", "_gender", "_score")


def cast(words: DataFrame, lexicon: Lexicon, case: str | None, preferences: DataFrame, keep: Callable[[Column], Column] | None = None, order: list[Column] | None = None, **options) -> DataFrame:
    """(w, result): each word in the case, or as it is where that can't be said.

    The word is read as an adjective if any of its nominative entries is one, else as the noun (or pronoun, numeral, article)
    with the best preference score.  The form has the reading's number and an adjective's definiteness, and the word's
    letter case.  A compound's last part is cast and its other parts stay; a capitalised noun without such a form is cast
    in lower case.  keep filters the forms by their tags, order comes before their usual order; options are those of lookup.
    With case None, words has a column case, which the result has too: each word is looked up once for all its cases.
    """
    asked = words.select("w", *(["case"] if case is None else [])).distinct()
    asked = asked if case is None else asked.withColumn("case", F.lit(case))
    found = basic(lookup(asked, lexicon, **options)).where(F.contains("mark", F.lit("NF")) & F.col("ofl").isin("lo", *GENDERS, "fn", "pfn", "to", "gr"))
    entry = F.struct("bmynd", "ord", "ofl", "mark")
    is_adjective = F.col("ofl") == "lo"
    chosen = preference_score(found, preferences).groupBy("w").agg(F.min_by(F.when(is_adjective, entry), F.when(is_adjective, F.col("rank"))).alias("_a"), F.min_by(F.when(~is_adjective, entry), F.when(~is_adjective, F.struct(-F.col("score"), F.col("rank")))).alias("_n"))
    chosen = chosen.select("w", F.coalesce("_a", "_n").alias("e")).select(F.col("w").alias("_w"), "e.*")
    w, adjective = F.col("_w"), F.col("ofl") == "lo"
    split = ~adjective & F.contains("bmynd", F.lit("-")) & ~F.contains("_w", F.lit("-"))
    own = F.when(adjective, F.col("bmynd")).when(split, after_last(F.col("bmynd"), "-")).otherwise(w)
    lower = F.when(~adjective & ~split & is_upper(F.left(w, F.lit(1))) & ~is_upper(w), F.lower(w))
    chosen = chosen.select(
        "_w",
        F.when(split, F.replace(before_last(F.col("bmynd"), "-"), F.lit("-"), F.lit(""))).otherwise("").alias("_prefix"),
        F.when(split, after_last(F.col("ord"), "-")).otherwise(F.col("ord")).alias("lemma"),
        F.col("ofl").alias("class"),
        F.col("mark").alias("_tag"),
        F.explode(F.filter(F.array(F.struct(F.lit(0).alias("retry"), own.alias("w")), F.struct(F.lit(1).alias("retry"), lower.alias("w"))), lambda k: k["w"].isNotNull())).alias("_k"),
    )
    cases = asked.select(F.col("w").alias("_w"), "case")
    fits = case_rows(case_requests(chosen.join(cases, "_w").select("*", "_k.*").drop("_k")), lexicon)
    fits = fits.withColumn("_try", F.min("retry").over(Window.partitionBy("_w", "case"))).where("retry = _try")
    has = lambda c, part: F.contains(c, F.lit(part))
    alike = lambda one, two: F.when(has("_tag", one), has("mark", one)).when(has("_tag", two), has("mark", two)).otherwise(True)
    fits = fits.where(alike("ET", "FT") & ((F.col("class") != "lo") | alike("VB", "SB")))
    if keep is not None:
        fits = fits.where(keep(F.col("mark")))
    full = fits.withColumns({c: F.lit(1 if c in ("einkunn", "beinkunn") else 0 if c == "millivisun" else "") for c in AUGMENTED if c not in BASIC})
    best = ranked(full, lexicon, ["_w", "case"], order).where("rank = 1").select(F.col("_w").alias("w"), "case", F.concat("_prefix", "bmynd").alias("_cast"))
    return asked.join(best, ["w", "case"], "left").select("w", *(["case"] if case is None else []), F.coalesce(like_case(F.col("_cast"), F.col("w")), F.col("w")).alias("result"))
