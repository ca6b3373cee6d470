"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised helper works on at once.
SLICE_BYTES = 1 << 20
#: Setting by which Spark deletes the shuffle files of an execution when that ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share. Only a session on one machine (tests) may do without and gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, computed once, kept if executors go.

    Files stay for as long as results may be read; whoever owns the folder clears it. What the write shuffled goes with
    its end: nothing that is built on the files reads it, and left to the driver's garbage it would pile up step by step."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with nulls read as empty, without an offset into a larger buffer."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    return col


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) row ranges with about ``limit`` bytes of text each; a longer text is alone in its range."""
    if not len(texts):
        return
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows in them."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts: byte starts and ends, document of each, 64-bit hash of each."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, offsets = raw(texts)
        if lower:
            data = _LOWER[data]
        n = len(data)
        self.data, self.offsets, self.rows = data, offsets, len(texts)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets[:-1])
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.doc = np.repeat(np.arange(self.rows), self.counts)
        self._inside = inside

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        terms = _BYTE_VALUES[self.data] * _power(_BASE, n)
        terms[~self._inside] = 0
        sums = np.add.reduceat(terms, self.starts)
        back = _power(pow(_BASE, -1, 1 << 64), n)[self.starts]
        return mix(sums * back + (self.ends - self.starts).astype(np.uint64))


def ngrams(word_hashes: np.ndarray, k: int, salt: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of the ``k`` words from each word on; the last ``k - 1`` entries wrap and are to be masked by the caller."""
    n = len(word_hashes)
    out = np.zeros(n, np.uint64)
    m = np.uint64(salt | 1)
    for j in range(k):
        out *= m
        if n > j:
            out[: n - j] += word_hashes[j:]
    return mix(out)


def bitset(keys: DataFrame, column: str, bits: int = 27, sections: int = 128) -> bytes:
    """A fixed-size bit set (``2**bits`` bits, whatever the number of keys) of a long column.

    It serves as a prefilter only: a key in it always tests true, others may. Each task fills one section,
    so no task or message grows with the keys beyond ``2**bits / 8`` bytes in all."""
    width = (1 << bits) // sections

    def fill(key, table):
        part = np.zeros(width, np.uint8)
        section = key[0].as_py()
        part[table.column("slot").to_numpy() - section * width] = 1
        return pa.table({"section": pa.array([section], pa.int32()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    # one row a slot before the shuffle, so that a hot key or section is never more than its slots
    slots = keys.select(slot.alias("slot")).distinct().withColumn("section", F.floor(F.col("slot") / width).cast("int"))
    parts = slots.groupBy("section").applyInArrow(fill, "section int, part binary").collect()
    whole = bytearray((1 << bits) // 8)
    for p in parts:
        whole[p.section * width // 8 : (p.section + 1) * width // 8] = p.part
    return bytes(whole)


def has_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which signed or unsigned 64-bit keys are in a bit set read as ``np.uint8``."""
    k = keys.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 > 0
