"""Word lists for compounds: reading, merging, removals and the character filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ILLEGAL = r"[_\\|:/.23]"
LONGEST = 64


def read_words(lines: DataFrame, col: str = "line") -> DataFrame:
    """One word a line, trimmed; blank and overlong ones are left out."""
    return lines.select(F.trim(col).alias("word")).where((F.col("word") != "") & (F.length("word") < LONGEST))


def merge_words(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("word")
    for x in lists[1:]:
        out = out.unionByName(x.select("word"))
    return out.distinct()


def remove_words(words: DataFrame, removals: DataFrame) -> DataFrame:
    return words.join(removals.select("word"), "word", "left_anti")


def legal_words(words: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    out = words.where(~F.col("word").rlike(ILLEGAL))
    return out.where(keep(F.col("word"))) if keep else out


def compound_parts(prefixes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(part, is_prefix, is_suffix)."""
    a = prefixes.select(F.col("word").alias("part"), F.lit(True).alias("p"), F.lit(False).alias("s"))
    b = suffixes.select(F.col("word").alias("part"), F.lit(False).alias("p"), F.lit(True).alias("s"))
    return a.unionByName(b).groupBy("part").agg(F.bool_or("p").alias("is_prefix"), F.bool_or("s").alias("is_suffix"))
