"""Inflection tags: their features, their order, and what remains of them when case is left out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The features that a tag is made of.
CASES = ("nf", "þf", "þgf", "ef")
GENDERS = ("kk", "kvk", "hk")
NUMBERS = ("et", "ft")
PERSONS = ("1p", "2p", "3p")
DEGREES = ("esb", "evb", "fsb", "fvb", "mst", "vb", "sb")
TENSES = ("þt", "nt")
VOICES = ("gm", "mm")
MOODS = ("lhnt", "nh", "fh", "vh", "bh")
IGNORED = ("0", "1", "2", "3", "subj", "none")
OTHER = ("obeygjanlegt", "serst", "nogr", "gr", "það", "st", "lhþt", "op", "sp", "sagnb")
FEATURES = CASES + GENDERS + NUMBERS + PERSONS + DEGREES + TENSES + VOICES + MOODS + IGNORED + OTHER

_SHORTEST_FIRST = "|".join(re.escape(a) for a in sorted(FEATURES, key=len))
_PERSON = "[123]p"


def atoms(mark: Column) -> Column:
    """The sorted distinct features of a tag; null where something in it is no feature."""
    text = F.regexp_replace(F.replace(F.lower(mark), F.lit("expl"), F.lit("það")), "(?<!o)p([123])", "$1p")

    def of_piece(piece: Column) -> Column:
        rest = F.regexp_replace(piece, _PERSON, "")
        found = F.regexp_extract_all(rest, F.lit(_SHORTEST_FIRST), F.lit(0))
        split = F.when(F.array_join(found, "") == rest, F.concat(F.regexp_extract_all(piece, F.lit(_PERSON), F.lit(0)), found))
        return F.when(piece.isin(*FEATURES), F.array(piece)).otherwise(split)

    pieces = F.transform(F.filter(F.split(text, "-"), lambda p: p != ""), of_piece)
    whole = F.when(F.forall(pieces, lambda p: p.isNotNull()), F.flatten(pieces))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda a: ~a.isin(*IGNORED))))


def requested(features: list[str] | tuple[str, ...]) -> list[str]:
    """The features of a request, by the same rules; raises ValueError on an unknown one."""
    out: set[str] = set()
    for piece in "-".join(features).replace("_", "-").lower().replace("expl", "það").split("-"):
        piece = re.sub(r"(?<!o)p([123])", r"\1p", piece)
        if piece in FEATURES:
            out.add(piece)
            continue
        out |= set(re.findall(_PERSON, piece))
        rest = re.sub(_PERSON, "", piece)
        found = re.findall(_SHORTEST_FIRST, rest)
        if "".join(found) != rest:
            raise ValueError(f"unknown feature in '{piece}'")
        out |= set(found)
    return sorted(out - set(IGNORED))


#: The bit of each feature in a set of features as one number.
BITS = {feature: k for k, feature in enumerate(f for f in FEATURES if f not in IGNORED)}


def bits(features: list[str]) -> int:
    """The set of these features."""
    return sum(1 << BITS[f] for f in features)


def mask(of_tag: Column) -> Column:
    """The set of an array of features; null for null."""
    place = F.create_map(*[F.lit(x) for f, k in BITS.items() for x in (f, 1 << k)])
    return F.aggregate(of_tag, F.lit(0).cast("long"), lambda m, a: m.bitwiseOR(F.element_at(place, a)))


def request_mask(features: Column) -> Column:
    """The set that an array of features asks for; raises an error on an unknown one."""
    spec = F.replace(F.array_join(features, "-"), F.lit("_"), F.lit("-"))
    wanted = mask(atoms(spec))
    return F.when(wanted.isNotNull(), wanted).when(features.isNotNull(), F.raise_error(F.concat(F.lit("unknown feature in '"), spec, F.lit("'"))).cast("long"))


def satisfies(of_row: Column, request: Column) -> Column:
    """The row's set has all requested features; ``nogr`` asks for a row without ``gr``."""
    has = lambda m, f: m.bitwiseAND(F.lit(bits([f]))) != 0
    wanted = request.bitwiseAND(F.lit(~bits(["nogr"])))
    return (of_row.bitwiseAND(wanted) == wanted) & ~(has(request, "nogr") & has(of_row, "gr"))


def distance(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of two sets."""
    return F.bit_count(a.bitwiseXOR(b))


def by_tag(rows: DataFrame, predicate: Callable[[str], bool]) -> Callable[[Column], Column]:
    """A Python predicate on tags as a condition: it is asked once for each distinct tag, and these are a fixed small set."""
    kept = [r[0] for r in rows.select("mark").distinct().collect() if predicate(r[0])]
    return lambda mark: mark.isin(*kept) if kept else F.lit(False)


def base_mark(mark: Column) -> Column:
    """The tag without the 2 or 3 of an alternative form."""
    return F.regexp_replace(mark, "[23]+$", "")


def simplify(mark: Column, number: Column | bool, definite: Column | bool) -> Column:
    """The tag without case and alternatives; without number, and without definiteness, where asked."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = mark
    for part in ("NF", "ÞF", "ÞGF", "EF", "2", "3"):
        out = F.replace(out, F.lit(part), F.lit(""))
    out = F.when(lit(number), F.replace(F.replace(out, F.lit("ET"), F.lit("")), F.lit("FT"), F.lit(""))).otherwise(out)
    bare = F.replace(F.replace(F.replace(out, F.lit("gr"), F.lit("")), F.lit("EVB"), F.lit("ESB")), F.lit("FVB"), F.lit("FSB"))
    return F.when(lit(definite), bare).otherwise(out)
