"""The compatibility view: recoded classes, corrected domains, deletions, and another order of entries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.operators.lookups import Lexicon
from morphlake.storage import stored

def without_deletions(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    return rows.join(deletions.select("ord", "ofl", "hluti"), ["ord", "ofl", "hluti"], "left_anti").select(*rows.columns)


def recode(rows: DataFrame) -> DataFrame:
    plain = F.col("mark") == "OBEYGJANLEGT"
    ofl = F.when((F.col("ofl") == "to") & plain, "töl").when(F.col("ofl") == "afn", "abfn").when(F.col("ofl") == "rt", "lo").otherwise(F.col("ofl"))
    return rows.withColumns({"ofl": ofl, "mark": F.when(plain, "-").otherwise(F.col("mark"))})


def corrected(rows: DataFrame, errata: DataFrame) -> DataFrame:
    """The domain by (lemma, recoded class), where the errata have one."""
    e = errata.select(F.col("ord").alias("_o"), F.col("ofl").alias("_c"), F.col("hluti").alias("_h"))
    out = rows.join(e, (F.col("ord") == F.col("_o")) & (F.col("ofl") == F.col("_c")), "left")
    return out.withColumn("hluti", F.coalesce("_h", "hluti")).drop("_o", "_c", "_h")


def compatible_view(lexicon: Lexicon, deletions: DataFrame, errata: DataFrame, preferences: DataFrame | None = None) -> Lexicon:
    """The view: lookups see recoded rows without the deleted ones, filters their raw class and tag, and lemmas that a form's preferences call worse are no entries of the form."""
    rows = without_deletions(lexicon.rows, deletions).withColumns({"raw_ofl": F.col("ofl"), "raw_mark": F.col("mark")})
    return replace(lexicon, rows=stored(corrected(recode(rows), errata)), compatible=True, preferences=preferences)
