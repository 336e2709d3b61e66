"""Profile operators: counters, length statistics, duplicates, coverage, top lists, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from materia.operators.running import running
from materia.sources.shared import shared_table


def at_ranks(df: DataFrame, value: Column, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column a rank): exact values at ranks (from 1, expressions of the group's count ``n``); nulls don't count.

    Values are counted first, in part before the shuffle; running sums of the counts, spread over ranges of values, say
    which value has the rank. No task holds the values of a group, and nothing is sorted but the distinct ones.
    """
    at, many, upto = "_value", "_many", "_upto"
    counts = df.select(*keys, value.alias(at)).filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.count("*").alias(many))
    summed = running(counts, keys, [at], **{upto: ("sum", F.col(many))})
    summed = shared_table(summed, "value-counts")
    whole = summed.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.sum(many).alias("n"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.lit(True))
    joined = summed.join(whole, same) if keys else summed.join(F.broadcast(whole))
    return joined.groupBy(*keys, "n").agg(*(F.min(F.when(F.col(upto) >= r, F.col(at))).alias(name) for name, r in ranks.items()))


def length_stats(df: DataFrame, length: Column, keys: list[str] | None = None) -> DataFrame:
    """count, min, max, median, mean (rounded half-even to 2) of a length, overall or by key."""
    keys = keys or []
    middle = at_ranks(df, length, keys, {"low": F.floor((F.col("n") + 1) / 2), "high": F.floor(F.col("n") / 2) + 1})
    middle = middle.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.bround((F.col("low") + F.col("high")) / 2, 2).alias("median"))
    plain = df.groupBy(*keys).agg(F.count(length).alias("n"), F.min(length).cast("long").alias("least"), F.max(length).cast("long").alias("most"), F.bround(F.avg(length), 2).alias("mean"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.lit(True))
    joined = plain.join(middle, same, "left") if keys else plain.join(F.broadcast(middle), how="left")
    return joined.select(*keys, "n", "least", "most", "median", "mean")


def nearest_rank(df: DataFrame, value: str, p: float = 0.95) -> DataFrame:
    """The nearest-rank percentile of a column, and how many rows are at or above it. One row."""
    limit = at_ranks(df, F.col(value), [], {"limit_value": F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))}).select("limit_value")
    return df.join(F.broadcast(limit)).groupBy("limit_value").agg(F.count_if(F.col(value) >= F.col("limit_value")).alias("at_or_above"))


def duplicates(df: DataFrame, value: str) -> DataFrame:
    """Values that occur more than once, and the rows beyond the first."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).filter("n > 1").withColumn("extra", F.col("n") - 1)


def most_common(df: DataFrame, value: str, n: int, seq: str) -> DataFrame:
    """Top ``n`` values by count; of equal counts the one seen first."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(n)


def longest(df: DataFrame, length: Column, n: int, tie: str) -> DataFrame:
    """Top ``n`` rows by length: a bounded heap in each task, then one of the heaps."""
    return df.withColumn("size", length).orderBy(F.desc("size"), tie).limit(n)


def sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """A fixed draw of ``n`` rows by seeded hash order: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def first_by_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
