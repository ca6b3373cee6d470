"""Texture chunks: roll-ups, mip sizes, mip ranges, and the order chunks must come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 148
#: Marks of records that are cube maps and that are none (fixed values of the format).
CUBE, FLAT = 2049, 2048
#: Pixel formats by number: name, bytes a block, pixels along a block's side (fixed values of the format).
FORMATS = (
    (28, "R8G8B8A8_UNORM", 4, 1), (29, "R8G8B8A8_UNORM_SRGB", 4, 1), (31, "R8G8B8A8_SNORM", 4, 1), (61, "R8_UNORM", 1, 1), (71, "BC1_UNORM", 8, 4),
    (72, "BC1_UNORM_SRGB", 8, 4), (77, "BC3_UNORM", 16, 4), (80, "BC4_UNORM", 8, 4), (83, "BC5_UNORM", 16, 4), (84, "BC5_SNORM", 16, 4),
    (87, "B8G8R8A8_UNORM", 4, 1), (95, "BC6H_UF16", 16, 4), (96, "BC6H_SF16", 16, 4), (98, "BC7_UNORM", 16, 4), (99, "BC7_UNORM_SRGB", 16, 4),
)


def formats(spark: SparkSession) -> DataFrame:
    """Dimension table of FORMATS: a fixed number of rows."""
    return spark.createDataFrame(list(FORMATS), "dxgi_format int, format_name string, block_bytes int, block_side int")


def mip_dimension(size: Column, mip: Column) -> Column:
    return F.greatest(F.call_function("shiftright", size.cast("long"), F.least(mip.cast("int"), F.lit(31))), F.lit(1))


def mip_bytes(width: Column, height: Column, mip: Column, block_bytes: Column, block_side: Column) -> Column:
    across = F.ceil(mip_dimension(width, mip) / block_side)
    down = F.ceil(mip_dimension(height, mip) / block_side)
    return (across * down * block_bytes).cast("long")


def mip_range_bytes(width: Column, height: Column, first: Column, last: Column, block_bytes: Column, block_side: Column) -> Column:
    return F.aggregate(F.sequence(first.cast("int"), last.cast("int")), F.lit(0).cast("long"), lambda acc, m: acc + mip_bytes(width, height, m, block_bytes, block_side))


def rollup(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row a texture from ``chunks(offset, packed, raw, start_mip)``: sizes, first offset, codec, array size.

    A chunk that is not packed is stored raw; cube maps have six chunks that start at mip 0 for each element."""
    stored = F.when(F.col("packed") == 0, F.col("raw")).otherwise(F.col("packed"))
    g = chunks.groupBy(*keys).agg(
        (F.lit(HEADER) + F.sum("raw")).cast("long").alias("raw_size"),
        F.sum(stored).cast("long").alias("stored_size"),
        F.min("offset").cast("long").alias("payload_offset"),
        F.max(F.col("packed") != 0).alias("any_packed"),
        F.count_if(F.col("start_mip") == 0).alias("_tops"),
        F.count("*").alias("chunk_count"),
        F.max("is_cubemap").alias("_cube"),
    )
    size = F.greatest(F.when(F.col("_cube"), F.floor(F.col("_tops") / 6)).otherwise(F.col("_tops")), F.lit(1))
    return g.withColumn("array_size", size.cast("long")).drop("_tops", "_cube")


def default_ranges(width: Column, height: Column, mips: Column, singles: int = 3, least: int = 512) -> Column:
    """Mip ranges of a texture: up to ``singles`` leading mips whose sides are ``least`` or more stand alone, the rest
    forms a tail. Array of (first, last)."""
    alone = F.size(F.filter(F.sequence(F.lit(0), F.lit(singles - 1)), lambda m: (m < mips - 1) & (mip_dimension(width, m) >= least) & (mip_dimension(height, m) >= least)))
    lone = F.filter(F.transform(F.sequence(F.lit(0), F.lit(singles - 1)), lambda m: F.struct(m.alias("first"), m.alias("last"))), lambda r: r["first"] < alone)
    return F.concat(lone, F.array(F.struct(alone.alias("first"), (mips - 1).cast("int").alias("last"))))


def capped_ranges(sizes: Column, cap: int) -> Column:
    """Greedy ranges whose mips' sizes sum to ``cap`` at most: (ranges, error); one mip over the cap is an error."""
    zero = F.struct(
        F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("error")
    )

    def step(acc: Column, s: Column) -> Column:
        over = (acc["sum"] + s > cap) & (acc["at"] > acc["first"])
        done = F.when(over, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(over, acc["at"]).otherwise(acc["first"]).alias("first"), (acc["at"] + 1).alias("at"), F.when(over, s).otherwise(acc["sum"] + s).cast("long").alias("sum"), (acc["error"] | (s > cap)).alias("error"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("long")), zero, step, lambda a: F.struct(F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["at"] - 1).alias("last")))).alias("ranges"), a["error"].alias("error")))


def sequence_error(chunks: Column, mips: Column) -> Column:
    """First fault in an ordered array of chunks (start_mip, end_mip): null, ``gap``, ``overlap``, ``backwards`` or
    ``incomplete``. Each face covers mips 0 to ``mips - 1`` without a hole; the next face starts again at 0."""
    start = F.struct(F.lit(0).alias("next"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, c: Column) -> Column:
        want = F.when(acc["next"] >= mips, 0).otherwise(acc["next"])
        fault = F.when(c["end_mip"] < c["start_mip"], "backwards").when(c["start_mip"] > want, "gap").when(c["start_mip"] < want, "overlap")
        return F.struct((c["end_mip"] + 1).cast("int").alias("next"), F.coalesce(acc["error"], fault).alias("error"))

    return F.aggregate(chunks, start, step, lambda a: F.coalesce(a["error"], F.when(a["next"] != mips, "incomplete")))


def layout_error(chunks: Column, width: Column, height: Column, mips: Column, cube: Column, block_bytes: Column, block_side: Column, sizes: bool = True) -> Column:
    """First fault in the chunks (start_mip, end_mip, raw_size) of a whole texture: null, ``shape``, ``surplus``,
    ``range``, ``gap``, ``overlap``, ``size`` or ``incomplete``.

    Slices ascend, within them the six faces of a cube map, within those the mips, and a chunk has just the bytes of its
    mips. Only a single cube map may keep the rest of its first face and all others in its last chunk, after chunks of
    one mip each. Without ``sizes``, or for a format that isn't known, sizes are not compared but for that."""
    tops = F.size(F.filter(chunks, lambda c: c["start_mip"] == 0))
    arrays = F.greatest(F.when(cube, F.floor(tops / 6)).otherwise(tops), F.lit(1)).cast("int")
    faces = F.when(cube, 6).otherwise(1)
    bytes_of = lambda first, last: mip_range_bytes(width, height, first, last, block_bytes, block_side)
    start = F.struct(F.lit(0).alias("array"), F.lit(0).alias("face"), F.lit(0).alias("next"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, x: Column) -> Column:
        c, i = x["c"], x["i"]
        first, last = c["start_mip"], c["end_mip"]
        tail = cube & (arrays == 1) & (i == F.size(chunks) - 1) & (acc["array"] == 0) & (acc["face"] == 0) & (first == i) & (last == mips - 1)
        whole = tail & (c["raw_size"] == bytes_of(first, last) + 5 * bytes_of(F.lit(0), mips - 1))
        odd = (c["raw_size"] != bytes_of(first, last)) & ~whole if sizes else F.lit(False)
        fault = F.when(acc["array"] >= arrays, "surplus").when((first > last) | (last >= mips), "range").when(first > acc["next"], "gap").when(first < acc["next"], "overlap").when(odd, "size")
        face_ends = last + 1 == mips
        slice_ends = face_ends & ((acc["face"] + 1 == faces) | F.coalesce(whole, F.lit(False)))
        return F.struct(
            F.when(slice_ends, acc["array"] + 1).otherwise(acc["array"]).alias("array"),
            F.when(slice_ends, 0).when(face_ends, acc["face"] + 1).otherwise(acc["face"]).alias("face"),
            F.when(face_ends, 0).otherwise(last + 1).cast("int").alias("next"),
            F.coalesce(acc["error"], fault).alias("error"),
        )

    numbered = F.transform(chunks, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    ends = lambda a: F.coalesce(a["error"], F.when((a["array"] != arrays) | (a["face"] != 0) | (a["next"] != 0), "incomplete"))
    return F.when((width == 0) | (height == 0) | (mips == 0), "shape").otherwise(F.aggregate(numbered, start, step, ends))


def place_subresources(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Each chunk (texture, array_index, face, start_mip, end_mip) with its subresources (…, mip, size).

    A range join without a range: chunks are expanded to their few mips and meet by equality. Both sides are sorted: Spark
    takes expanded rows for as few as before, and would send them all to every task."""
    mips = chunks.withColumn("mip", F.explode(F.sequence("start_mip", "end_mip"))).hint("merge")
    return mips.join(parts, ["texture", "array_index", "face", "mip"])
