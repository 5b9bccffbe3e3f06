"""Column names and types of the tables that the operators work on."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of an augmented row, in file order, and those of a basic row.
AUGMENTED = ("ord", "bin_id", "ofl", "hluti", "einkunn", "malsnid", "malfraedi", "millivisun", "birting", "bmynd", "mark", "beinkunn", "bmalsnid", "bgildi", "aukafletta")
BASIC = ("ord", "bin_id", "ofl", "hluti", "bmynd", "mark")
EXTRA = tuple(c for c in AUGMENTED if c not in BASIC)
INTEGERS = ("bin_id", "einkunn", "millivisun", "beinkunn")

LEXICON = T.StructType([T.StructField(c, T.IntegerType() if c in INTEGERS else T.StringType(), False) for c in AUGMENTED])

GENDERS = ("kk", "kvk", "hk")
OPEN_CLASSES = ("so", "kk", "hk", "kvk", "lo")
