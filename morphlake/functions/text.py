"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(w: Column) -> Column:
    """First character in upper case, all others in lower case (initcap would also change later words)."""
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))


def upper_first(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))


def is_lower(w: Column) -> Column:
    """There is a cased letter and none is in upper case."""
    return (w == F.lower(w)) & (w != F.upper(w))


def is_upper(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def is_title(w: Column) -> Column:
    return is_upper(F.left(w, F.lit(1))) & ~is_upper(w)


def like_case(w: Column, model: Column) -> Column:
    """w in the letter case of model: all upper, first upper, or as it is."""
    return F.when(is_upper(model), F.upper(w)).when(is_upper(F.left(model, F.lit(1))), upper_first(w)).otherwise(w)


def after_last(w: Column, sep: str) -> Column:
    return F.substring_index(w, sep, -1)


def before_last(w: Column, sep: str) -> Column:
    """What stands before the last sep; empty where there is none."""
    return F.left(w, F.greatest(F.length(w) - F.length(after_last(w, sep)) - len(sep), F.lit(0)))


def entry_repr(ord_: Column, ofl: Column, hluti: Column, bin_id: Column, bmynd: Column, mark: Column) -> Column:
    return F.format_string("(ord='%s', %s/%s/%d, bmynd='%s', %s)", ord_, ofl, hluti, bin_id, bmynd, mark)
