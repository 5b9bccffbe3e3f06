"""URL filters: fixed host and path rules, and association rules mined from what they decide.

The rules' verdicts label the URLs that they fit.  FP-growth finds the token combinations that go with a label often
and surely enough; they judge the other URLs through an inverted index from token to rule.

FP-growth: the frequent tokens of each basket stand by falling frequency, and each of them is sent what stands before it,
its conditional baskets.  A task grows the sets that end with its token from these, and no set above the wanted size is
grown, so a URL of many tokens costs no more than its sets of that size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.storage import numbered

from .common import cut, join_hot, table

# Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT, CONFIDENCE = 0.002, 0.8
LONGEST = 3  # tokens of a rule; a parameter of the model
BASKETS = 100_000  # different baskets of one token that one task grows sets from
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null or where there is no ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a URL: host labels, path words and names of parameters; numbers count as one token."""
    words = lambda kind, text, by: F.transform(F.filter(F.split(text, by), lambda t: t != ""), lambda t: F.concat(F.lit(kind), F.when(t.rlike("^[0-9]+$"), "#").otherwise(t)))
    query = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "=[^&]*", "")
    return F.array_sort(F.array_distinct(F.concat(words("host:", host, r"\."), words("path:", path, "[/._-]"), words("query:", query, "&"))))


def grow(base: list[tuple[tuple[int, ...], int, list[int]]], size: int, least: int) -> Iterator[tuple[tuple[int, ...], list[int]]]:
    """(set, counts of each verdict) of all sets of up to ``size`` tokens in conditional baskets (tokens, end, counts).

    A conditional basket is what stands before the end; a token's own conditional baskets end where it stands.  Sets that no
    verdict has ``least`` times are left out.
    """
    total: dict[int, list[int]] = {}
    places: dict[int, list] = {}
    for tokens_, end, counts in base:
        for i in range(end):
            t = tokens_[i]
            if t in total:
                total[t] = [a + b for a, b in zip(total[t], counts, strict=True)]
            else:
                total[t], places[t] = counts, []
            if size > 1:
                places[t].append((tokens_, i, counts))
    for t, counts in total.items():
        if max(counts) >= least:
            yield (t,), counts
            if size > 1:
                for more, n in grow(places[t], size - 1, least):
                    yield (*more, t), n


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """(rule_id, antecedent, verdict, confidence, support) from (items, verdict).

    A token that all baskets have is dealt to several tasks by its conditional baskets, and their counts are added.
    """
    baskets = cut(labelled.groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("n")))
    total = baskets.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(support * total))
    verdicts = [r[0] for r in baskets.select("verdict").distinct().orderBy("verdict").collect()] or [DEFAULT]
    often = baskets.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("often"), F.count(F.lit(1)).alias("baskets")).where(F.col("often") >= least)
    # No more tokens than a basket's tokens / support are frequent.
    ranks = cut(numbered(often.withColumn("_less", -F.col("often")), ["_less", "item"], "rank").select("item", F.col("rank").cast("int").alias("rank"), F.ceil(F.col("baskets") / BASKETS).cast("int").alias("lanes")))
    whole = baskets.select("items", "verdict", "n", F.explode("items").alias("item")).join(F.broadcast(ranks), "item")
    sorted_ = whole.groupBy("items", "verdict", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "lanes"))).alias("by_rank")).drop("items")
    conditional = sorted_.select("verdict", "n", "by_rank", F.posexplode("by_rank").alias("at", "own")).select(F.col("own.rank").alias("token"), F.transform(F.slice("by_rank", F.lit(1), F.col("at") + 1), lambda x: x["rank"]).alias("basket"), "verdict", "n", F.pmod(F.xxhash64(F.slice("by_rank", F.lit(1), F.col("at") + 1)), F.col("own.lanes")).alias("lane"), F.col("own.lanes").alias("lanes"))

    def grown(group: pa.Table) -> pa.Table:
        token, alone = group.column("token")[0].as_py(), group.column("lanes")[0].as_py() == 1
        base: dict[tuple[int, ...], list[int]] = {}
        for basket, verdict, n in zip(group.column("basket").to_pylist(), group.column("verdict").to_pylist(), group.column("n").to_pylist(), strict=True):
            base.setdefault(tuple(basket), [0] * len(verdicts))[verdicts.index(verdict)] += n
        own = [sum(x) for x in zip(*base.values(), strict=True)]
        baskets_ = [(k[:-1], len(k) - 1, v) for k, v in base.items()]
        found = [((), own), *(grow(baskets_, longest - 1, least if alone else 1) if longest > 1 else ())]
        return pa.table({"tokens": pa.array([[*s, token] for s, _ in found], type=pa.list_(pa.int32())), "counts": pa.array([c for _, c in found], type=pa.list_(pa.int64()))})

    sets = conditional.groupBy("token", "lane").applyInArrow(grown, "tokens array<int>, counts array<long>")
    summed = sets.groupBy("tokens").agg(*[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(len(verdicts))])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(f"n{k}").alias("n")) for k, v in enumerate(verdicts)]))
    of_set = summed.select("tokens", sum((F.col(f"n{k}") for k in range(len(verdicts))), F.lit(0)).alias("n_set"), each.alias("v")).select("tokens", "n_set", "v.*")
    rules = cut(of_set.where((F.col("n") >= least) & (F.col("n") / F.col("n_set") >= confidence)).withColumn("no", F.monotonically_increasing_id()))
    names = rules.select("no", F.explode("tokens").alias("rank")).join(F.broadcast(ranks.select("rank", "item")), "rank").groupBy("no").agg(F.array_sort(F.collect_list("item")).alias("antecedent"))
    named = rules.join(names, "no").select("antecedent", "verdict", (F.col("n") / F.col("n_set")).alias("confidence"), (F.col("n") / F.lit(total)).alias("support"))
    return named.withColumn("rule_id", F.md5(F.to_json(F.struct("antecedent", "verdict")).cast("binary")))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every row.

    mined is the antecedent of the association rule that decided, null where a fixed rule or the default (allow) did.
    Of the association rules that match, the surest wins, then the longer, the more frequent, the last by its digest.  A null
    URL, or one without ://, has no tokens and gets the default.  Repeated rows and null ids are judged like others; an
    empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("_url"))
    known = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"_host": host, "_path": path})
    rule, verdict = fitting_rule(F.col("_host"), F.col("_path"), rules)
    known = known.withColumns({"_rule": rule, "_verdict": verdict, "_items": tokens(F.col("_host"), F.col("_path"), F.col("_url"))}).drop("_url")
    labelled = known.where(F.col("_verdict").isNotNull() & (F.size("_items") > 0)).select(F.col("_items").alias("items"), F.col("_verdict").alias("verdict"))
    mined = cut(mine(labelled))
    # URLs with the same tokens are judged once; those with a fixed rule or without tokens need no other.
    is_open = F.col("_verdict").isNull() & (F.size("_items") > 0)
    open_items = cut(known.where(is_open).select(F.col("_items").alias("items")).distinct())
    tokens_of = open_items.select("items", F.explode("items").alias("item"))
    often = tokens_of.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    # A rule stands in the index under its rarest token, so popular tokens lead to few rules; the others are looked up in the row.
    rarest = mined.select("rule_id", F.explode("antecedent").alias("item")).join(often, "item").groupBy("rule_id").agg(F.min_by(F.struct("often", "item"), F.struct("often", "item")).alias("key"))
    index = cut(rarest.join(mined, "rule_id").select("key.item", F.ceil(F.col("key.often") / BASKETS).cast("int").alias("lanes"), *mined.columns))
    # The index has no more keys than there are frequent tokens; a key with many URLs is dealt to several lanes.
    keys = F.broadcast(index.select("item", "lanes").distinct())
    lanes = index.select("*", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")).drop("lanes")
    asked_of = tokens_of.join(keys, "item").withColumn("lane", F.pmod(F.xxhash64("items"), F.col("lanes")).cast("int")).drop("lanes")
    found = asked_of.join(lanes, ["item", "lane"]).where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max_by(F.struct("verdict", "antecedent"), F.struct("confidence", F.size("antecedent"), "support", "rule_id")).alias("best")
    decided = cut(found.groupBy("items").agg(best).select(F.col("items").alias("_items"), F.col("best.verdict").alias("_mined_verdict"), F.col("best.antecedent").alias("mined")))
    judged = join_hot(known.where(is_open), decided, "_items").unionByName(known.where(~is_open), allowMissingColumns=True)
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", "_mined_verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("_verdict").isNull(), F.col("mined")).alias("mined"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_url_filter; the mined rule's tokens as text."""
    return judge(table(spark, sf_dir, "pages")).withColumn("mined", F.array_join("mined", " "))
