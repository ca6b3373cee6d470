"""Checks over byte ranges and record order of an archive.

An ordered check needs what came before a row only. Rows are cut into blocks along the order (of offsets or record
numbers), so that one archive spreads over tasks; a window sees the rows of a block, and each block hands what the next
needs on through a window over one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, archive: str, order: list[str], value: str, block: Column) -> DataFrame:
    """Adds ``prev``: ``value`` of the row before within the archive by ``order``; null for the first.

    ``block`` is any expression that does not decrease along the order; rows of one block share a task and blocks
    hand their last value on through a window over one row each."""
    b = rows.withColumn("_b", block)
    last = b.groupBy(archive, "_b").agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_l")).select(archive, "_b", F.col("_l._v").alias("_last"))
    handed = last.select(archive, "_b", F.lag("_last").over(Window.partitionBy(archive).orderBy("_b")).alias("_before"))
    w = Window.partitionBy(archive, "_b").orderBy(*order)
    out = b.join(handed, [archive, "_b"]).withColumn("prev", F.coalesce(F.lag(value).over(w), F.col("_before")))
    return out.select(*rows.columns, "prev")


def overlaps(spans: DataFrame, archive: str, start: str, size: str, allow_equal: bool = True, block_size: int = 1 << 16) -> DataFrame:
    """Spans that begin before their predecessor ends, by (start, end). Some pair overlaps iff such a row exists.

    Empty spans overlap nothing. Equal spans are one where that is allowed."""
    full = spans.where((F.col(size) > 0) & F.col(start).isNotNull()).select(archive, F.col(start).alias("start"), (F.col(start) + F.col(size)).alias("stop"))
    full = full.distinct() if allow_equal else full
    return with_previous(full, archive, ["start", "stop"], "stop", F.floor(F.col("start") / block_size)).where("prev > start").select(archive, "start", "stop", F.col("prev").alias("prev_stop"))


def clashes(rows: DataFrame, archive: str, start: str, size: str, index: str, block_size: int = 1 << 16) -> DataFrame:
    """(archive, index): the later record of full spans that partly overlap; equal spans are one, of its least index.

    Each span is held against the one before it that reaches furthest. A span that several others overlap is reported
    against that one only; some row is given iff two spans overlap."""
    full = rows.where((F.col(size) > 0) & F.col(start).isNotNull()).groupBy(archive, F.col(start).alias("_start"), (F.col(start) + F.col(size)).alias("_stop")).agg(F.min(index).alias(index))
    full = full.withColumn("_b", F.floor(F.col("_start") / block_size)).withColumn("_reach", F.struct("_stop", -F.col(index)))
    blocks = full.groupBy(archive, "_b").agg(F.max("_reach").alias("_top"))
    blocks = blocks.select(archive, "_b", F.max("_top").over(Window.partitionBy(archive).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = F.max("_reach").over(Window.partitionBy(archive, "_b").orderBy("_start", "_stop").rowsBetween(Window.unboundedPreceding, -1))
    prev = F.greatest(F.col("_before"), inner)
    found = full.join(blocks, [archive, "_b"]).withColumn("_prev", prev).where("_prev._stop > _start")
    return found.select(archive, F.greatest(F.col(index), -F.col("_prev.col2")).alias(index))


def exclusivity(spans: DataFrame, archive: str, start: str, size: str, allow_equal: bool = True) -> DataFrame:
    """One row an archive: number of full spans, of distinct ones, of overlapping neighbours, and whether it passes."""
    full = spans.where((F.col(size) > 0) & F.col(start).isNotNull())
    once = full.groupBy(archive, start, size).agg(F.count("*").alias("c")).groupBy(archive).agg(F.sum("c").cast("long").alias("spans"), F.count("*").alias("distinct_spans"))
    bad = overlaps(spans, archive, start, size, allow_equal).groupBy(archive).agg(F.count("*").alias("overlaps"))
    every = spans.select(archive).distinct().join(once, archive, "left").join(bad, archive, "left").na.fill(0, ["spans", "distinct_spans", "overlaps"])
    return every.withColumn("exclusive", F.col("overlaps") == 0)


def record_order(records: DataFrame, archive: str, index: str, key: str, block: int = 4096) -> DataFrame:
    """Records whose key is less than the one before, or equal to it, by record index."""
    seen = with_previous(records.select(archive, index, key), archive, [index], key, F.floor(F.col(index) / block))
    problem = F.when(F.col("prev") > F.col(key), "unsorted").when(F.col("prev") == F.col(key), "duplicate")
    return seen.withColumn("problem", problem).where("problem is not null").select(archive, index, key, "prev", "problem")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "times")


def out_of_bounds(spans: DataFrame, start: str, size: str, total: str) -> DataFrame:
    from ..functions.numbers import span_fits

    return spans.where(~span_fits(F.col(start), F.col(size), F.col(total)))
