"""Reading lexicon lines: augmented (15 fields) and basic (6 fields) rows, id allocation and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.schema import AUGMENTED, BASIC, INTEGERS
from morphlake.storage import numbered

CHUNK = 1_000_000  # unnumbered rows that one task gives their ids


def read_lines(spark: SparkSession, path: str, file_no: int = 0) -> DataFrame:
    """(file_no, line_no, line) of a text file; line_no increases along the file."""
    return spark.read.text(path).select(F.lit(file_no).alias("file_no"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def _number(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.trim(text).cast("int"))


def commas(text: Column) -> Column:
    """Runs of commas as one, and none at the ends."""
    return F.trim(F.regexp_replace(text, ",,+", ","), F.lit(","))


def parse(lines: DataFrame) -> DataFrame:
    """The rows of lines (file_no, line_no, line), with ``n_fields``: 15 or 6.

    Blank lines and lines that begin with # are skipped; any other number of fields is an error.  A basic row has 0 and
    empty strings in the fields that it lacks.
    """
    kept = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("_f", F.split(F.trim("line"), ";"))
    n = F.size("_f")
    wrong = F.raise_error(F.concat(F.lit("a line needs 15 or 6 fields: "), F.col("line")))
    kept = kept.withColumn("n_fields", F.when(n.isin(len(AUGMENTED), len(BASIC)), n).otherwise(wrong.cast("int")))

    def field(name: str) -> Column:
        wide = F.get("_f", F.lit(AUGMENTED.index(name)))
        narrow = F.get("_f", F.lit(BASIC.index(name))) if name in BASIC else F.lit("")
        text = F.coalesce(F.when(F.col("n_fields") == len(AUGMENTED), wide).otherwise(narrow), F.lit(""))
        if name == "malfraedi":
            text = commas(text)
        return _number(text) if name in INTEGERS else text

    return kept.select("file_no", "line_no", "n_fields", *[field(c).alias(c) for c in AUGMENTED])


def allocate_ids(rows: DataFrame) -> DataFrame:
    """Give rows with bin_id 0 or less new ids, and tag what came from where.

    The first new id is the maximum id plus 1999, rounded down to thousands; it grows by one whenever ``ord`` differs
    from that of the unnumbered row before, in file and line order.  birting becomes S for -1, blank for 0, and G for
    numbered rows of basic files.
    """
    open_rows = numbered(rows.where(F.col("bin_id") <= 0).select("file_no", "line_no", "ord"), ["file_no", "line_no"], "_n")
    before = open_rows.select((F.col("_n") + 1).alias("_n"), F.col("ord").alias("_before"))
    changes = open_rows.join(before, "_n").where("ord <> _before").select("_n", "file_no", "line_no")
    # The k-th change of lemma begins the ids that are k above the first; rows between changes share one.
    begins = numbered(changes, ["_n"], "_step").select(F.col("_n").alias("_from"), "_step", (F.col("_n") / CHUNK).cast("long").alias("_chunk"))
    chunks = open_rows.withColumn("_chunk", (F.col("_n") / CHUNK).cast("long"))
    earlier = begins.groupBy("_chunk").agg(F.max("_step").alias("_last"))
    whole = chunks.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size")).join(earlier, "_chunk", "left")
    carried = whole.select("_chunk", F.coalesce(F.max("_last").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    own = chunks.join(begins.select(F.col("_from").alias("_n"), "_step"), "_n", "left").withColumn("_own", F.max("_step").over(Window.partitionBy("_chunk").orderBy("_n")))
    given_steps = own.join(F.broadcast(carried), "_chunk").select("file_no", "line_no", F.coalesce("_own", "_carried").alias("_step"))
    first = rows.agg((F.floor((F.max("bin_id") + 1999) / 1000) * 1000).cast("int").alias("_first"))
    basic = F.col("n_fields") == len(BASIC)
    tag = F.when(basic & (F.col("bin_id") == -1), "S").when(basic & (F.col("bin_id") == 0), "").when(basic, "G").otherwise(F.col("birting"))
    given = F.when(F.col("bin_id") <= 0, (F.col("_first") + F.col("_step")).cast("int")).otherwise(F.col("bin_id"))
    return rows.join(given_steps, ["file_no", "line_no"], "left").crossJoin(F.broadcast(first)).withColumn("birting", tag).withColumn("bin_id", given).select("file_no", "line_no", *AUGMENTED)


def suffix_rows(rows: DataFrame) -> DataFrame:
    """The rows of parsed lines that serve as the last part of compounds only: those with the id -1."""
    return rows.where("bin_id = -1")


def read_lexicon(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files in order: the augmented one first, because new ids depend on the largest id."""
    parts = [parse(read_lines(spark, p, i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return allocate_ids(out)
