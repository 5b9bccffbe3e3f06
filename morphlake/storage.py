"""Tables that are computed once: written to the shared checkpoint folder, so that no plan repeats them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session that names none gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later plans read only the columns that they need, and know its size."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be sent to all tasks of a join where it is counted to have few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of ``by``.

    Rows are dealt to ranges of that order and numbered within them; only the sizes of the ranges meet in one task.
    """
    dealt = stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


CHUNK = 50_000


def carried(rows: DataFrame, n: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the value of the nearest row at or before each, by the numbers ``n``, that has one.

    Rows are dealt to chunks of numbers; only one value for each chunk meets in one task.
    """
    of_chunk = rows.withColumn("_chunk", F.floor(F.col(n) / CHUNK))
    last = of_chunk.where(F.col(value).isNotNull()).groupBy("_chunk").agg(F.max_by(value, n).alias("_last"))
    every = of_chunk.select("_chunk").distinct().join(last, "_chunk", "left")
    before = every.select("_chunk", F.last("_last", True).over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last(value, True).over(Window.partitionBy("_chunk").orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return of_chunk.withColumn("_own", own).join(F.broadcast(before), "_chunk").withColumn(name, F.coalesce("_own", "_before")).drop("_chunk", "_own", "_before")
