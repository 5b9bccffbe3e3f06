"""Reading the legal tags of each class and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.sources.lexicon_text import read_lines


def parse_marks(lines: DataFrame) -> DataFrame:
    """(ofl, mark, pos) of lines (line_no, line) like ``kk;NFET``: pos counts from 0 within the class, in the file's order.

    Blank lines and lines that begin with # are skipped.  A class has some dozens or hundreds of tags.
    """
    kept = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("_f", F.split(F.trim("line"), ";"))
    named = kept.select("line_no", F.get("_f", F.lit(0)).alias("ofl"), F.get("_f", F.lit(1)).alias("mark"))
    return named.select("ofl", "mark", (F.row_number().over(Window.partitionBy("ofl").orderBy("line_no")) - 1).alias("pos"))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    return parse_marks(read_lines(spark, path))
