"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of each source are dealt to shards (by a seeded digest of the document id); within a shard the documents
stand in seeded order and their words are cut into blocks of equal size.  Blocks are the seats: the divisor method
gives each source a number of blocks by the highest quotients votes / (2k + 1), then each shard of the source its
quota.  A shard with quota q of n blocks takes all of them ``q div n`` times and ``q mod n`` of them once more; those
are picked at even distances from a seeded start, so which part of a document is taken follows from arithmetic on
its place in the shard and no block is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.storage import numbered

from .common import cut, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 8
SHARDS = 512
SEED = "mix-1"


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, cap: str, order: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each row when its group's ``seats`` go to the highest quotients votes / (2k + 1).

    No row gets more than ``cap``.  Ties go to the smaller ``order``.  Rounding at the ideal divisor is wrong by less
    than a seat for each party of the group, so only the quotients near it are compared: a number of rows in
    proportion to the parties, however many the seats are.
    """
    of = Window.partitionBy(*group)
    p = (
        parties.withColumn("_w", F.sum(votes).over(of))
        .withColumn("_n", F.count(F.lit(1)).over(of))
        .withColumn("_ideal", F.when(F.col("_w") > 0, F.col(seats) * F.col(votes) / F.col("_w")).otherwise(0.0))
        .withColumn("_k", F.ceil(1.5 * F.col("_n") * F.when(F.col("_w") > 0, F.col(votes) / F.col("_w")).otherwise(0.0)) + 2)
        .withColumn("_least", F.least(F.greatest(F.round("_ideal").cast("long") - F.col("_k"), F.lit(0)), F.col(cap)).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_least").over(of))
    )
    k = F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_k")))
    by = Window.partitionBy(*group).orderBy(F.desc("_quotient"), F.asc(order), F.asc("_step"))
    won = (
        p.select(*group, order, votes, cap, "_least", "_left", k.alias("_step"))
        .withColumn("_seat", F.col("_least") + F.col("_step"))
        .where((F.col("_seat") < F.col(cap)) & (F.col(votes) > 0))
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
        .withColumn("_place", F.row_number().over(by))
        .where(F.col("_place") <= F.col("_left"))
        .groupBy(*group, order)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    kept = [c for c in parties.columns]
    return p.join(won, [*group, order], "left").select(*kept, (F.col("_least") + F.coalesce("_won", F.lit(0))).cast("long").alias(out))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add _target to (_skey, _source, _words, ...): weights repeat over the sources by code point, null last.

    No target is above cap times its source's words; what that leaves over is shared among the others by weight: a target
    is the level times the weight, and the level is found by sums over all sources.
    """
    s = numbered(sources.withColumn("_null", F.col("_source").isNull()), ["_null", "_source"], "_pos").withColumn("_pos", F.col("_pos") - 1).drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_pos", F.lit(len(weights))) + 1).cast("int"))
    s = cut(s.withColumns({"_weight": weight, "_most": F.col("_words") * float(cap)}))
    goal = (s.agg(F.sum("_words")).first()[0] or 0) * float(share)
    level, before = 0.0, None
    while level != before:  # it rises until no other source comes to its cap
        full = F.col("_most") <= level * F.col("_weight")
        capped, weights_left = s.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))).first()
        before, level = level, (goal - (capped or 0.0)) / weights_left if weights_left else level
    target = F.least(F.col("_most"), F.lit(level) * F.col("_weight")) if level else F.col("_most")
    return s.withColumn("_target", target).drop("_weight", "_most")


def _picked_before(j: Column) -> Column:
    """How many of the shard's blocks 0 to j - 1 are taken once more."""
    n, r, o = F.col("_blocks"), F.col("_extra"), F.col("_start")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(
        F.when(j + o <= n, _div((j + o) * r, n) - _div(o * r, n)).otherwise(r - _div(o * r, n) + _div((j + o - n) * r, n))
    )


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs; null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, taken) of each row: how many of its words the mix takes.

    size is the number of words (null or empty text: 0); a source's words and their copies add up to about its
    target, off by at most a block for each shard.  No document is taken more than ``cap`` times its size.  Null
    sources are a source of their own.  Repeated rows and null ids are rows like others: rows that agree in id,
    source and size may exchange their ``taken``.  An empty table gives an empty result.  Other columns are ignored.
    """
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_skey"),
            word_count(F.col(text_col)).alias("_size"),
            digest.alias("_digest"),
        ).withColumn("_shard", F.pmod(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    )
    stats = sized.groupBy("_skey", "_source", "_shard").agg(F.sum("_size").alias("_shard_words")).withColumn("_blocks", F.ceil(F.col("_shard_words") / block))
    sources = targets(stats.groupBy("_skey", "_source").agg(F.sum("_shard_words").alias("_words"), F.sum("_blocks").alias("_all_blocks")), weights, share, cap)
    sources = sources.withColumn("_one", F.lit(0)).withColumn("_votes", F.when(F.col("_words") > 0, F.col("_target") / F.col("_words") * F.col("_all_blocks")).otherwise(0.0))
    sources = sources.withColumn("_seats", F.round(F.sum("_votes").over(Window.partitionBy("_one"))).cast("long")).withColumn("_cap", F.col("_all_blocks") * cap)
    sources = sainte_lague(sources, ["_one"], "_votes", "_seats", "_cap", "_pos", "_given")
    per_shard = stats.join(sources.select("_skey", "_words", "_target", "_given"), "_skey").withColumn("_shard_cap", F.col("_blocks") * cap)
    per_shard = sainte_lague(per_shard, ["_skey"], "_blocks", "_given", "_shard_cap", "_shard", "_quota")
    start = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "_skey", F.col("_shard").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    per_shard = per_shard.select(
        "_skey",
        "_shard",
        "_words",
        "_target",
        "_blocks",
        F.coalesce(_div(F.col("_quota"), F.col("_blocks")), F.lit(0)).alias("_times"),
        F.coalesce(F.pmod("_quota", F.nullif(F.col("_blocks"), F.lit(0))), F.lit(0)).alias("_extra"),
        F.coalesce(F.pmod(start, F.nullif(F.col("_blocks"), F.lit(0))), F.lit(0)).alias("_start"),
    )
    placed = sized.withColumn("_end", F.sum("_size").over(Window.partitionBy("_skey", "_shard").orderBy("_digest", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def taken_before(x: Column) -> Column:
        j = _div(x, F.lit(block).cast("long"))
        return block * _picked_before(j) + (_picked_before(j + 1) - _picked_before(j)) * F.pmod(x, F.lit(block))

    return placed.join(per_shard, ["_skey", "_shard"]).select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_times") * F.col("_size") + taken_before(F.col("_end")) - taken_before(F.col("_end") - F.col("_size"))).cast("long").alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_mixing."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
