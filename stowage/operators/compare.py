"""Comparisons of catalogs and of measured runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalogs(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with ``missing``, ``extra``, ``different`` or ``same``, comparing nulls as values; both sides have a key once."""
    a = expected.select(*keys, F.struct(*values).alias("expected"))
    b = actual.select(*keys, F.struct(*values).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "same").otherwise("different")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def baseline(required: DataFrame, observed: DataFrame, key: str, digest: str) -> DataFrame:
    """Required rows that were not observed, or with another digest."""
    absent = required.join(observed, key, "left_anti").select(key, F.lit("absent").alias("problem"))
    other = required.join(observed.select(key, F.col(digest).alias("_seen")), key).where(F.col("_seen") != F.col(digest)).select(key, F.lit("changed").alias("problem"))
    return absent.unionByName(other)


def best_runs(runs: DataFrame, keys: list[str], elapsed: str) -> DataFrame:
    """The fastest run of each group; ties go to the least row."""
    rest = [c for c in runs.columns if c not in (*keys, elapsed)]
    best = runs.groupBy(*keys).agg(F.min(F.struct(elapsed, *rest)).alias("best"), F.count("*").alias("runs"))
    return best.select(*keys, "best.*", "runs")


def speedups(before: DataFrame, after: DataFrame, key: str, elapsed: str) -> DataFrame:
    """Key, times of both runs and their ratio; a key that one run lacks has nulls there."""
    a, b = (x.groupBy(key).agg(F.min(elapsed).alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, key, "full").withColumn("speedup", F.when(F.col("after") > 0, F.col("before") / F.col("after")))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two frames hold a different number of times."""
    left = a.groupBy(*keys).agg(F.count("*").alias("left_count"))
    right = b.groupBy(*keys).agg(F.count("*").alias("right_count"))
    return left.join(right, keys, "full").na.fill(0, ["left_count", "right_count"]).where("left_count <> right_count")


def slowest(runs: DataFrame, elapsed: str, n: int = 15) -> DataFrame:
    return runs.orderBy(F.desc(elapsed), *[c for c in runs.columns if c != elapsed]).limit(n)
