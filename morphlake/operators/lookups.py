"""Lookups of many words at once.

A query table has a column ``w``; results have ``w`` (the word asked for), ``key`` (the spelling that was found),
``stage``, ``rank`` (1 for the first entry) and the fifteen fields.  The cascade asks for all spellings of a word in one
join and keeps those of its first stage; only compounds, the costly stage, see just the words that missed (left_anti).
The order of tags and the adjectives' template are fixed small tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.text import capitalize, is_lower
from morphlake.schema import AUGMENTED, BASIC, EXTRA, GENDERS, OPEN_CLASSES
from morphlake.storage import stored

#: What the nine extra fields of a constructed row are.
CONSTRUCTED = {"einkunn": 1, "malsnid": "", "malfraedi": "", "millivisun": 0, "birting": "G", "beinkunn": 1, "bmalsnid": "", "bgildi": "", "aukafletta": ""}
CANONICAL = {"kk": "NFET", "kvk": "NFET", "hk": "NFET", "pfn": "NFET", "fn": "KK-NFET", "gr": "KK-NFET", "so": "GM-NH"}


@dataclass
class Lexicon:
    """A lexicon and what its view of it needs.  rows must be cached or stored where several operators use it."""

    rows: DataFrame
    first_local_id: int
    mark_order: DataFrame  # ofl, mark, pos
    template: DataFrame | None = None  # ending, mark, seq
    parts: DataFrame | None = None  # part, is_prefix, is_suffix
    compatible: bool = False  # the compatibility view: nothing is hidden by id or origin, and rows have raw_ofl and raw_mark too
    preferences: DataFrame | None = None  # form, worse: lemmas that lookups of a form leave out

    def raw(self, name: str) -> Column:
        """The class or tag that filters see; the compatibility view shows others."""
        return F.col(f"raw_{name}" if self.compatible else name)


def penalty() -> Column:
    return (F.col("einkunn") != 1).cast("int") + (F.col("beinkunn") != 1).cast("int")


def visible(lexicon: Lexicon) -> DataFrame:
    """Rows that form lookups may see: neither local nor added ones, but suffix rows."""
    if lexicon.compatible:
        return lexicon.rows
    return lexicon.rows.where(((F.col("bin_id") < lexicon.first_local_id) & (F.col("birting") != "G")) | (F.col("birting") == "S"))


def visible_basic(lexicon: Lexicon) -> DataFrame:
    """Rows that case lookups may see: only local ids are hidden."""
    return lexicon.rows if lexicon.compatible else lexicon.rows.where(F.col("bin_id") < lexicon.first_local_id)


def form_rows(lexicon: Lexicon) -> DataFrame:
    """The rows that lookups of a form may find, suffix rows too; in the compatibility view with their priority as ``prio``."""
    rows = visible(lexicon)
    if lexicon.preferences is not None:
        worse = lexicon.preferences.select(F.col("form").alias("bmynd"), F.explode("worse").alias("ord"))
        rows = rows.join(worse, ["bmynd", "ord"], "left_anti")
    return rows.withColumn("prio", priority()) if lexicon.compatible else rows


def extra_of(lexicon: Lexicon) -> tuple[str, ...]:
    """The columns that form lookups give besides the fields."""
    return ("prio",) if lexicon.compatible else ()


# Registers that lower an entry's rank in the compatibility view, and what verb tags add to it.
LOW_REGISTERS = ("URE", "SJALD", "VILLA", "GAM")
VERB_PENALTIES = (("VH", 4), ("ÞT", 2), ("FT", 1), ("2P", 1))


def priority() -> Column:
    """The smaller, the earlier: constructed, incorrect and low entries come late, and some verb forms."""
    low = F.col("malsnid").isin(*LOW_REGISTERS).cast("int") + F.col("bmalsnid").isin(*LOW_REGISTERS).cast("int")
    verb = sum((F.when(F.contains("mark", F.lit(part)), n).otherwise(0) for part, n in VERB_PENALTIES), F.lit(0))
    return (F.col("bin_id") == 0).cast("int") + (F.col("einkunn") != 1).cast("int") + low + F.when(F.col("ofl") == "so", verb).otherwise(0)


def without_suffix_rows(rows: DataFrame) -> DataFrame:
    return rows.where("birting <> 'S'")


def contains(keys: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(w, found): is w a form of any row?"""
    forms = lexicon.rows.select(F.col("bmynd").alias("w")).distinct().withColumn("_there", F.lit(True))
    return keys.select("w").distinct().join(forms, "w", "left").select("w", F.coalesce("_there", F.lit(False)).alias("found"))


def lookup_raw(keys: DataFrame, lexicon: Lexicon, cat: str | None = None, lemma: str | None = None, bin_id: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """All rows of each form, filtered by class (``no`` is any gender), lemma, id and a condition on the tag."""
    rows = lexicon.rows
    if cat is not None:
        rows = rows.where(F.col("ofl").isin(*(GENDERS if cat == "no" else (cat,))))
    if lemma is not None:
        rows = rows.where(F.col("ord") == lemma)
    if bin_id is not None:
        rows = rows.where(F.col("bin_id") == bin_id)
    if keep is not None:
        rows = rows.where(keep(F.col("mark")))
    return keys.select("w").distinct().join(rows, F.col("w") == F.col("bmynd")).select("w", *AUGMENTED)


def lemma_of_id(ids: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(bin_id, ord, hluti)."""
    lemmas = lexicon.rows.groupBy("bin_id").agg(F.min("ord").alias("ord"), F.min("hluti").alias("hluti"))
    return ids.select("bin_id").distinct().join(lemmas, "bin_id")


def lemma_forms(ids: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(bin_id, form): the forms of an id and its lemma."""
    both = lexicon.rows.select("bin_id", F.explode(F.array("bmynd", "ord")).alias("form")).distinct()
    return both.join(ids.select("bin_id").distinct(), "bin_id", "left_semi")


def ranked(rows: DataFrame, lexicon: Lexicon, by: list, first: list | None = None) -> DataFrame:
    """Add ``rank`` within ``by``: correct forms first (not in the compatibility view), then id, the tag's place in its class, and all other fields."""
    pos = lexicon.mark_order.select(F.col("ofl").alias("_ofl"), F.col("mark").alias("_mark"), F.col("pos").alias("_pos"))
    out = rows.join(F.broadcast(pos), (F.col("ofl") == F.col("_ofl")) & (F.col("mark") == F.col("_mark")), "left")
    grade = [] if lexicon.compatible else [penalty()]
    order = [*(first or []), *grade, "bin_id", F.coalesce("_pos", F.lit(9999)), "ofl", "bmynd", "mark", "ord", "hluti", *EXTRA]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("_ofl", "_mark", "_pos")


def lookup_id(ids: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The visible rows of each id, suffix rows too, with their rank."""
    rows = visible(lexicon).dropDuplicates(list(AUGMENTED)).join(ids.select("bin_id").distinct(), "bin_id", "left_semi")
    return ranked(rows, lexicon, ["bin_id"]).select("rank", *AUGMENTED)


def base_plan(lexicon: Lexicon) -> Callable[[DataFrame], DataFrame]:
    """The plan that looks up keys (key, ...): an equi-join with the rows that form lookups see."""
    rows = without_suffix_rows(form_rows(lexicon))
    return lambda keys: keys.join(rows, F.col("key") == F.col("bmynd")).select(*keys.columns, *AUGMENTED, *extra_of(lexicon))


#: The options that words may have in columns.
FLAGS = ("at_sentence_start", "auto_uppercase")


def requests(words: DataFrame, at_sentence_start: bool = False, auto_uppercase: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(q, w): the distinct requests.  q has the word, its options (a column of words, or else the given value) and the columns ``more``."""
    given = {"at_sentence_start": at_sentence_start, "auto_uppercase": auto_uppercase}
    flags = [(F.coalesce(F.col(x), F.lit(False)) if x in words.columns else F.lit(given[x])).alias(x) for x in FLAGS]
    return words.select(F.struct("w", *flags, *more).alias("q")).distinct().select("q", F.col("q.w").alias("w"))


def constructed(template: DataFrame, **fields) -> DataFrame:
    """Rows of constructed entries: (q, key, step) with the given fields and the defaults of the others."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return template.select("q", "written", "step", *[as_col((CONSTRUCTED | fields)[c]).alias(c) for c in AUGMENTED]).withColumnRenamed("written", "key")


def legur_rows(keys: DataFrame, template: DataFrame) -> DataFrame:
    """Entries of adjectives in -legur that no lexicon row has, for keys (q, written, key, step) with key in lower case.

    Every template row whose ending is a proper end of the word gives one: the word's ends are joined with the endings.
    """
    asked = keys.where(F.contains("key", F.lit("leg")))
    sizes = F.array_distinct(F.transform(F.array(*[F.lit(r[0]) for r in template.select("ending").distinct().collect()] or [F.lit("")]), F.length))
    ends = F.explode(F.transform(F.filter(sizes, lambda n: (n > 0) & (n < F.length("key"))), lambda n: F.right("key", n)))
    found = asked.withColumn("ending", ends).join(F.broadcast(template), "ending")
    stem = F.left("key", F.length("key") - F.length("ending"))
    adjectives = constructed(found, ord=F.concat(stem, F.lit("legur")), bin_id=0, ofl="lo", hluti="alm", bmynd=F.col("key"), mark=F.col("mark"))
    adverbs = constructed(asked.where(F.col("key").endswith("lega") & (F.length("key") > 4)), ord=F.col("key"), bin_id=0, ofl="ao", hluti="alm", bmynd=F.col("key"), mark="OBEYGJANLEGT")
    return adjectives.unionByName(adverbs)


#: The steps of the second run, for the other spelling, come this much later.
AGAIN = 70


def cascade(
    words: DataFrame,
    lexicon: Lexicon,
    base: Callable[[DataFrame], DataFrame],
    compounds: Callable[[DataFrame], DataFrame] | None = None,
    at_sentence_start: bool = False,
    auto_uppercase: bool = False,
    negation: bool = True,
    legur: bool = True,
    replace_z: bool = True,
    extra: tuple[str, ...] = (),
    more: tuple[str, ...] = (),
    last_step: int = 7,
) -> DataFrame:
    """(q, key, stage, source, fields): the entries of the first stage that has any.

    Stages: 1 as written, 2 capitalised, 3 lower case, 4 the -legur template, 5 compounds, 6 negation by ó-, 7 z for s: the
    stages once more for the other spelling.  At the start of a sentence a word's entries in lower case come before its
    own; with auto_uppercase those of a capitalised word do, and its spelling becomes the key.  There, a single letter that
    isn't found is read as an abbreviation.  Both options may be columns of words, one for each row.  q is a request (see
    ``requests``), with the columns ``more`` of words for base and compounds to read.  extra: more columns that these give;
    constructed rows have null.  last_step: later stages are left out.
    """
    w, start, upper = F.col("q.w"), F.col("q.at_sentence_start"), F.col("q.auto_uppercase")
    single = upper & is_lower(w) & (F.length(w) == 1)
    other = F.replace(F.replace(w, F.lit("tzt"), F.lit("st")), F.lit("z"), F.lit("s"))
    replace_z, negation = replace_z and last_step >= 7, negation and last_step >= 6
    asked = requests(words, at_sentence_start, auto_uppercase, more).select("q").withColumn("v", F.when(F.contains(w, F.lit("z")) & ~single, other) if replace_z else F.lit(None).cast("string"))
    asked = stored(asked)
    given = lambda step, spelling, when: F.when(when, F.struct(F.lit(step).alias("step"), spelling.alias("key")))

    def spellings(x: Column, first: int) -> list[Column]:
        low = F.lower(x)
        out = [given(first + 1, x, x.isNotNull()), given(first + 3, low, low != x), given(first + 2, capitalize(x), upper & is_lower(x))]
        if negation:
            out.append(given(first + 6, F.substr(low, F.lit(2)), low.startswith("ó") & (F.length(x) > 1)))
        return out

    wanted = [*spellings(w, 0), given(3, F.concat(w, F.lit(".")), single), *(spellings(F.col("v"), AGAIN) if replace_z else [])]
    keys = asked.select("q", "v", F.explode(F.filter(F.array(*wanted), lambda s: s.isNotNull())).alias("s")).select("q", "v", "s.step", "s.key")
    negated = F.col("step").isin(6, AGAIN + 6)
    put_o = lambda c: F.when(negated, F.concat(F.lit("ó"), c)).otherwise(F.col(c))
    found = base(keys).where(~negated | (F.col("ofl") == "lo")).withColumns({"ord": put_o("ord"), "bmynd": put_o("bmynd"), "key": F.when(F.col("step") == 6, w).when(negated, F.col("v")).otherwise(F.col("key"))})
    found = found.select("q", "key", "step", *AUGMENTED, *extra)
    if legur and lexicon.template is not None and last_step >= 4:
        written = F.array(F.struct(F.lit(4).alias("step"), w.alias("written")), *([F.struct(F.lit(AGAIN + 4).alias("step"), F.col("v").alias("written"))] if replace_z else []))
        tries = asked.select("q", F.explode(F.filter(written, lambda t: t["written"].isNotNull())).alias("t")).select("q", "t.step", "t.written", F.lower("t.written").alias("key"))
        found = found.unionByName(legur_rows(tries, lexicon.template), allowMissingColumns=True)
    if compounds is not None and last_step >= 5:
        found = stored(found)
        miss = asked.join(found.where("step < 5").select("q").distinct(), "q", "left_anti")
        forms = [F.struct(F.lit(5).alias("step"), w.alias("form"))] + ([F.when(F.col("v").isNotNull(), F.struct(F.lit(AGAIN + 5).alias("step"), F.col("v").alias("form")))] if replace_z else [])
        forms = miss.select("q", F.explode(F.filter(F.array(*forms), lambda f: f.isNotNull())).alias("f")).select("q", "f.step", F.col("f.form").alias("w"))
        found = found.unionByName(compounds(forms).select("q", "key", "step", *AUGMENTED, *extra))
    # What the first stage of a request is, and which other rows belong to it, is told by its rows together.
    by = Window.partitionBy("q")
    step = F.col("step")
    own = F.max(step == 1).over(by)  # a single letter: capitalised only beside entries of its own, as an abbreviation only without
    found = found.withColumn("_own", own).where(~single | ((step != 2) | F.col("_own")) & ((step != 3) | ~F.col("_own")))
    found = found.withColumn("_best", F.min("step").over(by))
    later = F.col("_best") >= AGAIN
    found = found.withColumns({"_here": F.when(later, step - AGAIN).otherwise(step), "_first": F.when(later, F.col("_best") - AGAIN).otherwise(F.col("_best"))})
    found = found.withColumn("_up", F.max(F.when(F.col("_here") == 2, F.col("key"))).over(by))
    kept = F.when(start & (F.col("_first") == 1), F.col("_here").isin(1, 3)).otherwise(F.col("_here") == F.col("_first"))
    kept = F.when(F.col("_up").isNotNull(), F.col("_here").isin(1, 2)).otherwise(kept)
    written = F.when(later, other).otherwise(w)
    key = F.when(F.col("_up").isNotNull(), F.col("_up")).when(F.col("_first") == 1, written).otherwise(F.col("key"))
    source = F.when((F.col("_here") == 2) | ((F.col("_here") == 3) & (F.col("_first") == 1)), -1).otherwise(0)
    return found.where(kept).withColumns({"key": key, "stage": F.when(later, 7).otherwise(step), "source": source}).select("q", "key", "stage", "source", *AUGMENTED, *extra)


def opened(found: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    """found with the word, and with those options that words has columns of, in place of the request."""
    return found.select("q.w", *[f"q.{x}" for x in FLAGS if x in words.columns], *columns)


def lookup(words: DataFrame, lexicon: Lexicon, add_compounds: bool = True, **options) -> DataFrame:
    """(w, key, stage, rank, the fifteen fields) of every word that is found; options are those of the cascade.

    at_sentence_start and auto_uppercase may be columns of words instead; the result then has them too.  In the compatibility
    view the entries of each lookup stand by priority, else by correctness.
    """
    from morphlake.operators.compounds import compound_plan  # it builds on this module

    extra = extra_of(lexicon)
    plan = compound_plan(lexicon) if add_compounds and lexicon.parts is not None else None
    found = cascade(words, lexicon, base_plan(lexicon), plan, extra=extra, **options)
    return opened(ranked(found, lexicon, ["q"], ["source", *extra]), words, "key", "stage", "rank", *AUGMENTED)


def lookup_tokens(tokens: DataFrame, lexicon: Lexicon, **options) -> DataFrame:
    """tokens (w, at_sentence_start, auto_uppercase, ...) with the entries of each: every different request is looked up once."""
    flags = [x for x in FLAGS if x in tokens.columns]
    found = lookup(tokens, lexicon, **options).withColumnsRenamed({x: f"_{x}" for x in ("w", *flags)})
    same = F.col("w") == F.col("_w")
    for x in flags:
        same &= F.coalesce(F.col(x), F.lit(False)) == F.col(f"_{x}")
    return tokens.join(found, same).select(*tokens.columns, "key", "stage", "rank", *AUGMENTED)


def lookup_exact(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The entries of words as they are written, without any other stage."""
    found = base_plan(lexicon)(words.select("w", F.col("w").alias("key")).distinct())
    return ranked(found.withColumn("stage", F.lit(1)), lexicon, ["w"], list(extra_of(lexicon))).select("w", "key", "stage", "rank", *AUGMENTED)


def basic(found: DataFrame) -> DataFrame:
    return found.select("w", "key", "stage", "rank", *BASIC)


def keys_of(words: DataFrame, found: DataFrame, auto_uppercase: bool = False) -> DataFrame:
    """(w, key) of every word: the spelling found, else the word, capitalised where that was asked for."""
    w = F.col("w")
    given = found.groupBy("w").agg(F.min("key").alias("key"))
    letter = F.concat(F.upper(w), F.lit("."))
    missing = F.when(is_lower(w), F.when(F.length(w) == 1, letter).otherwise(capitalize(w))).otherwise(w) if auto_uppercase else w
    return words.select("w").distinct().join(given, "w", "left").select("w", F.coalesce("key", missing).alias("key"))


def classes_of(found: DataFrame) -> DataFrame:
    return found.select("w", "ofl").distinct()


def lemmas_and_classes(found: DataFrame) -> DataFrame:
    return found.select("w", "ord", "ofl").distinct()


def is_lemma_row() -> Column:
    """Is the row its lemma's own entry?"""
    ofl, mark = F.col("ofl"), F.col("mark")
    canonical = F.lit(True)
    for k, m in CANONICAL.items():
        canonical = F.when(ofl == k, mark == m).otherwise(canonical)
    canonical = F.when(ofl == "lo", mark.isin("FSB-KK-NFET", "KK-NFET")).when(ofl == "to", mark.startswith("KK_NF") | (mark == "OBEYGJANLEGT")).otherwise(canonical)
    own = (F.replace("ord", F.lit("-"), F.lit("")) == F.col("key")) & canonical
    return ((ofl == "so") & (mark == "MM-NH")) | own


def lemma_entries(found: DataFrame) -> DataFrame:
    return found.where(is_lemma_row())


def open_classes(found: DataFrame) -> DataFrame:
    return found.where(F.col("ofl").isin(*OPEN_CLASSES))


def nouns(found: DataFrame) -> DataFrame:
    return found.where(F.col("ofl").isin(*GENDERS))
