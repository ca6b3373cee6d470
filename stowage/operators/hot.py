"""Joins whose keys may be hot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is hot, unless a thousandth of all rows is more: at most 1000 keys are hot.
HOT = 256


def met(rows: DataFrame, facts: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has a row for each key and in ``count`` how many of the ``total`` rows bear it.

    Hot keys, at most 1000, meet their rows by broadcast, so that no task takes all rows of one key."""
    least = max(HOT, total // 1000)
    hot = facts.where(F.col(count) >= least)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(facts.where(F.col(count) < least), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def membership(keys: DataFrame, column: str, bits: int = 24):
    """A condition on a long column that holds for every key in ``keys``, and for few others while those number few.

    It rests on a bit set of fixed size (``2**bits`` bits), filled section by section in tasks, whatever the number of
    keys; so it serves to spare rows a shuffle, not to decide."""
    sections, width = 64, (1 << bits) // 64

    def fill(key, table):
        import pyarrow as pa

        part = np.zeros(width, np.uint8)
        part[table.column("slot").to_numpy() - key[0].as_py() * width] = 1
        return pa.table({"section": pa.array(key[:1], pa.int32()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    slots = keys.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).distinct().withColumn("section", F.floor(F.col("slot") / width).cast("int"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for p in slots.groupBy("section").applyInArrow(fill, "section int, part binary").collect():
        whole[p.section * width // 8 : (p.section + 1) * width // 8] = np.frombuffer(p.part, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(whole.tobytes())

    @F.pandas_udf("boolean")
    def has(values: pd.Series) -> pd.Series:
        have = np.frombuffer(shared.value, np.uint8)
        k = values.to_numpy(np.int64) & np.int64(len(have) * 8 - 1)
        return pd.Series((have[k >> 3] >> (k & 7).astype(np.uint8)) & 1 > 0)

    def condition(value: Column) -> Column:
        return has(value)

    return condition
