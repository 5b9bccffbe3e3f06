"""What the operators of this folder share: tables, checkpoints and the training split of the queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_IDS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local session that names none gets one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that neither its lineage nor its computation is repeated."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


MOST_BUCKETS = 100_000


@contextmanager
def bucketed(df: DataFrame, key: str, groups: int) -> Iterator[DataFrame]:
    """df as a table in the checkpoint folder that is bucketed by ``key``, so that grouping by it moves no row again.

    There are as many buckets as groups, at least those of a shuffle and at most MOST_BUCKETS; a bucket is one file.  The
    table goes at the end: what is read from it must be written by then.
    """
    spark = df.sparkSession
    buckets = min(MOST_BUCKETS, max(groups, partitions(spark)))
    database = f"tables_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{checkpoint_dir(spark)}/{database}'")
    try:
        df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").saveAsTable(f"{database}.rows")
        yield spark.table(f"{database}.rows")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


FORGET = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WHOLE_STAGES = "spark.sql.codegen.wholeStage"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Inside, the session has this setting; what it had before comes back at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_forgotten(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, the shuffle files of each query go when it ends, as what is needed later is written by ``cut`` anyway.

    Else Spark keeps them until the driver's garbage collection finds the query.
    """
    return setting(spark, FORGET, "true")


def stages_not_compiled(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, the driver compiles no class for each stage of a query; tasks run its operators one by one.

    Many short queries would fill the driver's memory with classes and what compiling them leaves.  Results are the same.
    """
    return setting(spark, WHOLE_STAGES, "false")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in the only column of gone (null ids too, if gone has one).

    Up to BROADCAST_IDS ids are sent to all tasks, so that no text is shuffled; more of them are joined by a shuffle.
    """
    name = fresh(docs, "gone")
    gone = cut(gone.toDF(name).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


BROADCAST_BYTES = 32 << 20
CELL_BLOCKS = 64


def meet(blocks: DataFrame, queries: DataFrame, group: str, size: str) -> DataFrame:
    """Every row of blocks with every row of queries: both are blocks of bounded size, and ``group`` numbers those of queries.

    Where the queries' blocks (``size`` has their bytes) take up to BROADCAST_BYTES together, they are sent to all tasks and no
    block moves.  Else both are dealt to the cells of a grid of groups and of some CELL_BLOCKS blocks each, so that a cell's size
    doesn't grow with either table.
    """
    n, total = queries.agg(F.max(group), F.sum(size)).first()
    groups = F.explode(F.sequence(F.lit(0), F.lit(n or 0))).alias(group)
    if (total or 0) <= BROADCAST_BYTES:
        return blocks.select(*blocks.columns, groups).join(F.broadcast(queries.drop(size)), group)
    lanes = max(1, blocks.count() // CELL_BLOCKS)
    dealt = blocks.withColumn("_lane", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int"))
    copied = queries.drop(size).withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return dealt.select(*blocks.columns, "_lane", groups).join(copied.hint("shuffle_hash"), [group, "_lane"]).drop("_lane")


def best_of_each(rows: DataFrame, by: list[str], order: list, n: int, rank: str) -> DataFrame:
    """The first n different rows of each group by ``order``, with their ``rank`` from 1; rows that agree in the order are one.

    Spark keeps only the first n of a group in each task before it shuffles them.
    """
    placed = rows.withColumn(rank, F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    return placed.where(F.col(rank) <= n).dropDuplicates([*by, rank])


HOT_ROWS = 500_000


def join_hot(rows: DataFrame, facts: DataFrame, on: str, how: str = "left") -> DataFrame:
    """rows.join(facts, on), where facts has one row for each key and some keys may have very many of the rows.

    Facts of keys with more than HOT_ROWS rows are sent to all tasks (there are fewer of them than rows / HOT_ROWS), so that the
    rows of such a key stay where they are; the others meet by a shuffle.
    """
    size = fresh(rows, "n")
    hot = cut(rows.groupBy(on).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > HOT_ROWS).select(on))
    if hot.isEmpty():
        return rows.join(facts, on, how)
    few = cut(facts.join(F.broadcast(hot), on, "left_semi"))
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(facts, on, how)
    return rest.unionByName(rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))
