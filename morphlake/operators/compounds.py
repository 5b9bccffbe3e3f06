"""Compounds: splitting words into known parts, and entries inherited from the last part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.text import after_last, before_last, capitalize, is_lower, is_upper
from morphlake.operators.lookups import Lexicon, extra_of, form_rows, requests
from morphlake.schema import AUGMENTED, GENDERS, OPEN_CLASSES
from morphlake.storage import small, stored


def part_places(words: DataFrame, parts: DataFrame, whole: bool = False) -> DataFrame:
    """(w, _l, _m): the lattice of each word that known parts may cover: its edges (_a: from, _n: length, is_prefix, is_suffix).

    A word is cut no longer than the longest part, so the places to look up grow with its length and not with its square.
    Only words that a part begins and another ends are cut; whole: the last part must be a suffix and the others prefixes.
    """
    longest = parts.agg(F.max(F.length("part"))).first()[0] or 0
    known = small(parts.select("part", "is_prefix", "is_suffix"))
    w = words.select("w").distinct().where("w <> ''").withColumn("_l", F.length("w"))
    if not longest:
        return w.where("false").withColumn("_m", F.array().cast("array<struct<_a:int,_n:int,is_prefix:boolean,is_suffix:boolean>>"))
    sizes = F.sequence(F.lit(1), F.least("_l", F.lit(longest)))
    ends = w.withColumn("part", F.explode(F.transform(sizes, lambda n: F.right("w", n)))).join(known.where("is_suffix") if whole else known, "part", "left_semi").select("w", "_l").distinct()
    begun = ends.withColumn("_n", F.explode(sizes)).withColumn("part", F.left("w", F.col("_n"))).join(known, "part").where(F.col("is_prefix") | (F.col("_n") == F.col("_l"))).select("w", "_l").distinct()
    starts = begun.select("w", "_l", F.explode(F.sequence(F.lit(0), F.col("_l") - 1)).alias("_a"))
    places = starts.select("w", "_l", "_a", F.explode(F.sequence(F.lit(1), F.least(F.col("_l") - F.col("_a"), F.lit(longest)))).alias("_n"))
    here = places.withColumn("part", F.substr("w", F.col("_a") + 1, F.col("_n"))).join(known, "part")
    return here.groupBy("w", "_l").agg(F.array_sort(F.collect_list(F.struct("_a", "_n", "is_prefix", "is_suffix"))).alias("_m"))


def _ending(at: Column) -> Column:
    """The part that is all of the word from a place on, if there is one."""
    return F.get(F.filter("_m", lambda x: (x["_a"] == at) & (x["_n"] == F.col("_l") - at)), 0)


def _nexts(at: Column) -> Column:
    """The prefixes from a place on, the shorter ones first."""
    return F.filter("_m", lambda x: (x["_a"] == at) & x["is_prefix"] & (x["_n"] < F.col("_l") - at))


def _cut(words: DataFrame, cuts: Column, *more: str) -> DataFrame:
    """(w, parts) by the places where parts begin."""
    ends = F.concat(F.slice("_p", F.lit(2), F.size("_p")), F.array("_l"))
    return words.withColumn("_p", cuts).select("w", *more, F.zip_with("_p", ends, lambda x, y: F.substr("w", x + 1, y - x)).alias("parts"))


#: Counts of ways have up to 38 digits.
WAYS = "decimal(38,0)"
AT_ONCE = 1024


def _with_ways(words: DataFrame, parts: DataFrame) -> DataFrame:
    """The lattices with ``_c``: in how many ways known parts cover a word from each place to its end.

    Where the rest of a word is a known part, only that unsplit reading of it counts; else every prefix there leads on.
    One number for each place is kept, however many ways there are.
    """

    def step(counts: Column, i: Column) -> Column:
        # counts has the places behind i, from i + 1 to the end.
        on = F.aggregate(_nexts(i), F.lit(0).cast(WAYS), lambda n, x: (n + F.element_at(counts, x["_n"])).cast(WAYS))
        return F.concat(F.array(F.when(_ending(i).isNotNull(), F.lit(1).cast(WAYS)).otherwise(on)), counts)

    places = F.sequence(F.col("_l") - 1, F.lit(0), F.lit(-1))
    return part_places(words, parts).withColumn("_c", F.aggregate(places, F.array(F.lit(0).cast(WAYS)), step))


def count_splits(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(w, ways): in how many ways each word can be written as known parts, by rule of ``splits``; words without a way are left out."""
    return _with_ways(words, parts).select("w", F.element_at("_c", 1).alias("ways")).where("ways > 0")


def splits(words: DataFrame, parts: DataFrame, first: int = 0, n: int | None = None) -> DataFrame:
    """(w, number, parts): the ways to write each word as known parts, all but the last of them prefixes.

    Where what is left of a word is itself a known part, only that unsplit reading of it counts.  A word's ways are numbered
    from 0, those with shorter first parts first; n of them from ``first`` on are made, or all.  A way is made from its number
    by the counts of the ways from each place, so no row holds more than one.
    """
    last = F.element_at("_c", 1) if n is None else F.least(F.element_at("_c", 1), F.lit(first + n).cast(WAYS))
    counted = _with_ways(words, parts).withColumn("_last", last.cast("long") - 1).where(F.col("_last") >= first)
    begun = counted.withColumn("_from", F.explode(F.sequence(F.lit(first).cast("long"), F.col("_last"), F.lit(AT_ONCE).cast("long"))))
    each = begun.withColumn("number", F.explode(F.sequence("_from", F.least("_last", F.col("_from") + AT_ONCE - 1))))
    kind = f"struct<at:int,left:{WAYS},path:array<int>>"

    def choose(state: Column, x: Column) -> Column:
        """Past a prefix: is the wanted way one of those that it begins?  at is then the prefix's end, else left counts down."""
        ways = F.element_at("_c", x["_a"] + x["_n"] + 1)
        hit = (state["at"] == x["_a"]) & (state["left"] < ways)
        return F.struct(F.when(hit, x["_a"] + x["_n"]).otherwise(state["at"]).alias("at"), F.when(hit | (state["at"] != x["_a"]), state["left"]).otherwise(state["left"] - ways).cast(WAYS).alias("left"), F.when(hit, F.concat(state["path"], F.array(x["_a"] + x["_n"]))).otherwise(state["path"]).alias("path")).cast(kind)

    # Edges stand by their place, and an edge leads to a later one, so one walk over them follows the way.
    open_edges = F.filter("_m", lambda x: x["is_prefix"] & (x["_n"] < F.col("_l") - x["_a"]) & _ending(x["_a"]).isNull())
    start = F.struct(F.lit(0).alias("at"), F.col("number").cast(WAYS).alias("left"), F.array(F.lit(0)).alias("path")).cast(kind)
    return _cut(each, F.aggregate(open_edges, start, choose)["path"], "number")


def best_splits(words: DataFrame, parts: DataFrame, n: int = 1) -> DataFrame:
    """(w, place, parts): the n best valid splits by the longest last part, then the fewest parts, then the shortest first parts.

    Of all ways to reach a place in the word only the n best are kept, so the work doesn't grow with their number.
    """
    kind = "array<struct<at:int,n:int,path:array<int>>>"
    best_at = lambda state, i: F.slice(F.array_sort(F.filter(state, lambda s: s["at"] == i)), F.lit(1), F.lit(n))

    def step(state: Column, i: Column) -> Column:
        lead = lambda here: F.transform(_nexts(i), lambda x: F.struct((i + x["_n"]).alias("at"), (here["n"] + 1).alias("n"), F.concat(here["path"], F.array(i + x["_n"])).alias("path")))
        return F.when(_ending(i).isNull(), F.concat(state, F.flatten(F.transform(best_at(state, i), lead)))).otherwise(state)

    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(1).alias("n"), F.array(F.lit(0)).alias("path"))).cast(kind)
    found = part_places(words, parts, True).withColumn("_s", F.aggregate(F.sequence(F.lit(0), F.col("_l") - 1), start, step))
    valid = F.filter("_s", lambda s: F.coalesce(_ending(s["at"])["is_suffix"], F.lit(False)))
    chosen = found.select("w", "_l", F.posexplode(F.slice(F.array_sort(valid), F.lit(1), F.lit(n))).alias("place", "_way"))
    return _cut(chosen.withColumn("place", F.col("place") + 1), F.col("_way.path"), "place")


def best_split(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(w, parts): the best valid split of each word that has one."""
    return best_splits(words, parts).select("w", "parts")


def prefixed(prefix: Column, hyphen: bool, uppercase: Column | bool = False) -> dict[str, Column]:
    """The lemma and form of an entry behind a prefix, and its id 0; an empty prefix changes nothing."""
    upper = uppercase if isinstance(uppercase, Column) else F.lit(uppercase)
    join = "-" if hyphen else ""
    put = lambda c: F.when(prefix == "", F.col(c)).otherwise(F.concat(prefix, F.lit(join), F.when(upper, capitalize(F.col(c))).otherwise(F.col(c))))
    return {"ord": put("ord"), "bmynd": put("bmynd"), "bin_id": F.when(prefix == "", F.col("bin_id")).otherwise(F.lit(0))}


def compound_plan(lexicon: Lexicon, base: Callable[[DataFrame], DataFrame] | None = None, extra: tuple[str, ...] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The plan that adds (key, fields) to rows (q, w, ...): what stands after the last blank and hyphen of w, by known parts.

    base looks up (q, key, ...) with suffix rows; the default is the rows that form lookups see.  A word with capitals is a
    noun, but for one at the start of a sentence.
    """
    extra = extra_of(lexicon) if extra is None else extra
    rows = form_rows(lexicon)
    look = base or (lambda keys: keys.join(rows, F.col("key") == F.col("bmynd")).select(*keys.columns, *AUGMENTED, *extra))

    def plan(words: DataFrame) -> DataFrame:
        w, rest, core = F.col("w"), F.col("_rest"), F.col("_core")
        blank = F.contains(w, F.lit(" "))
        asked = words.withColumns({"_words": F.when(blank, F.concat(before_last(w, " "), F.lit(" "))).otherwise(""), "_rest": F.when(blank, after_last(w, " ")).otherwise(w)})
        asked = asked.withColumn("_hyphen", F.contains(rest, F.lit("-")) & ~rest.endswith("-"))
        asked = asked.withColumns({"_before": F.when(F.col("_hyphen"), before_last(rest, "-")).otherwise(""), "_core": F.when(F.col("_hyphen"), after_last(rest, "-")).otherwise(rest)})
        asked = stored(asked.withColumn("_low", F.lower("_core")).where("_core <> ''"))
        cores = asked.select(F.explode(F.array_distinct(F.array("_core", "_low"))).alias("w")).distinct()
        both = stored(best_split(cores, lexicon.parts))
        split = asked.join(both.select(F.col("w").alias("_core"), F.col("parts").alias("_as")), "_core", "left").join(both.select(F.col("w").alias("_low"), F.col("parts").alias("_lowered")), "_low", "left")
        as_is = F.coalesce(F.size("_as") > 1, F.lit(False)) | (F.col("_low") == core)
        # Without a compound as written, the reading in lower case is all there is.
        chosen = split.withColumn("parts", F.when(as_is, F.col("_as")).otherwise(F.col("_lowered"))).where("parts is not null")
        several = F.size("parts") > 1
        spelling = F.when(as_is | ~several, core).otherwise(F.col("_low"))
        keys = chosen.select(*words.columns, "_words", "_before", "_core", F.when(F.col("_hyphen"), rest).otherwise(spelling).alias("_key"), F.element_at("parts", -1).alias("key"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "-").alias("_prefix"), several.alias("_several"), (F.col("q.at_sentence_start") & (rest == w) & ~F.col("_hyphen")).alias("_free"))
        found = look(keys).where(F.col("_several") | (F.col("birting") != "S"))
        strict = ~F.col("_free") & (F.lower("_core") != core)
        out = found.where(F.when(strict, F.col("ofl").isin(*GENDERS)).otherwise(F.col("ofl").isin(*OPEN_CLASSES)))
        title = is_upper(F.left("_core", F.lit(1))) & is_lower(F.substr("_core", F.lit(2)))
        out = out.withColumns(prefixed(F.col("_prefix"), True)).withColumns(prefixed(F.col("_before"), True, title)).withColumns(prefixed(F.col("_words"), False))
        return out.withColumn("key", F.concat("_words", "_key")).select(*words.columns, "key", *AUGMENTED, *extra)

    return plan


def get_compound(words: DataFrame, lexicon: Lexicon, at_sentence_start: bool = False) -> DataFrame:
    """(w, key, fields) of the words that are compounds, whether or not the lexicon has them as they are."""
    return compound_plan(lexicon)(requests(words, at_sentence_start)).select("w", "key", *AUGMENTED)
