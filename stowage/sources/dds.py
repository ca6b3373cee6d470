"""Texture files: header facts, subresources, and the chunks a texture archive stores, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import little_endian as le
from ..operators.textures import default_ranges, formats, mip_range_bytes

#: Four-character codes of the short header and the formats they mean (fixed values of the format).
FOURCC = {"DXT1": 71, "DXT3": 74, "DXT5": 77, "ATI1": 80, "BC4U": 80, "ATI2": 83, "BC5U": 83}
#: Formats that version 1 of texture archives doesn't take (fixed values of the format).
NEW_FORMATS = (29, 31, 72, 84, 95, 96, 99)
#: Formats that record-table archives take, and those that version 105 takes besides (fixed values of the format).
RECORD_FORMATS, RECORD_FORMATS_105 = (28, 61, 65, 71, 74, 77, 87, 88), (80, 83, 98)


def facts(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds width, height, mip_count, dxgi_format, array_size, is_cubemap, header_bytes and error.

    Two-dimensional textures and complete cubes only; anything else has an error code, and null facts if unreadable."""
    c = F.col(content)
    n = lambda at, width=4: le(c, at, width)
    four = F.decode(F.substring(c, 85, 4), "ISO-8859-1")
    extended = four == "DX10"
    readable = (F.octet_length(c) >= F.when(F.coalesce(extended, F.lit(False)), 148).otherwise(128)) & (F.substring(c, 1, 4) == F.lit(b"DDS "))
    short = F.when((n(88) == 32) & (n(92) == 0xFF0000), 87).when((n(88) == 32) & (n(92) == 0xFF), 28)
    for code, number in FOURCC.items():
        short = F.when(four == code, number).otherwise(short)
    cube = F.when(extended, n(136).bitwiseAND(4) != 0).otherwise(n(112).bitwiseAND(0x200) != 0)
    whole = n(112).bitwiseAND(0xFC00) == 0xFC00
    out = files.withColumn("_ok", F.coalesce(readable, F.lit(False)))
    pick = lambda x: F.when(F.col("_ok"), x)
    out = out.withColumns(
        {
            "height": pick(n(12)).cast("int"),
            "width": pick(n(16)).cast("int"),
            "mip_count": pick(F.greatest(n(28), F.lit(1))).cast("int"),
            "dxgi_format": pick(F.when(extended, n(128)).otherwise(short)).cast("int"),
            "array_size": pick(F.when(extended, F.greatest(n(140), F.lit(1))).otherwise(1)).cast("int"),
            "is_cubemap": pick(cube),
            "header_bytes": pick(F.when(extended, 148).otherwise(128)).cast("int"),
            "_flat": pick((n(24) <= 1) & (n(112).bitwiseAND(0x200000) == 0) & (~cube | whole | extended)),
        }
    )
    error = F.when(~F.col("_ok"), "format_error").when(~F.col("_flat") | F.col("dxgi_format").isNull() | (F.col("width") == 0) | (F.col("height") == 0), "unsupported")
    return out.withColumn("error", error).drop("_ok", "_flat")


def _faces() -> Column:
    return F.when(F.col("is_cubemap"), 6).otherwise(1)


def _known(files: DataFrame, content: str) -> DataFrame:
    """Facts with the format's block, and the bytes that one face takes; a fixed table is broadcast."""
    f = facts(files, content).join(F.broadcast(formats(files.sparkSession)), "dxgi_format", "left")
    face = mip_range_bytes(F.col("width"), F.col("height"), F.lit(0), F.col("mip_count") - 1, F.col("block_bytes"), F.col("block_side"))
    f = f.withColumn("face_bytes", face)
    short = F.octet_length(content) < F.col("header_bytes") + F.col("face_bytes") * F.col("array_size") * _faces()
    return f.withColumn("error", F.coalesce("error", F.when(F.col("block_bytes").isNull(), "unsupported").when(short, "format_error")))


def _cut(known: DataFrame, ranges: Column, content: str) -> DataFrame:
    """One row for each element, face and mip range, with its bytes, which lie together in the file."""
    k = known.where("error is null").withColumn("element", F.explode(F.sequence(F.lit(0), F.col("array_size") * _faces() - 1)))
    k = k.withColumn("_n", F.size(ranges)).select("*", F.posexplode(ranges).alias("_i", "r"))
    size = lambda a, b: mip_range_bytes(F.col("width"), F.col("height"), a, b, F.col("block_bytes"), F.col("block_side"))
    before = F.when(F.col("r.first") > 0, size(F.lit(0), F.greatest(F.col("r.first") - 1, F.lit(0)))).otherwise(0)
    k = k.withColumn("offset", (F.col("header_bytes") + F.col("element") * F.col("face_bytes") + before).cast("int")).withColumn("bytes", size(F.col("r.first"), F.col("r.last")).cast("int"))
    return k.withColumn("payload", F.substring(F.col(content), F.col("offset") + 1, F.col("bytes"))).withColumn("nth", (F.col("element") * F.col("_n") + F.col("_i")).cast("int"))


def subresources(files: DataFrame, content: str = "content") -> DataFrame:
    """archive_id, path, array_index, face, mip, offset, payload of every image in every file without an error."""
    each = F.transform(F.sequence(F.lit(0), F.col("mip_count") - 1), lambda m: F.struct(m.alias("first"), m.alias("last")))
    out = _cut(_known(files, content), each, content)
    return out.select("archive_id", "path", F.floor(F.col("element") / _faces()).cast("int").alias("array_index"), (F.col("element") % _faces()).alias("face"), F.col("r.first").alias("mip"), "offset", "payload")


def chunks(files: DataFrame, content: str = "content") -> DataFrame:
    """Input of the texture writer: large leading mips alone, the rest of a face as its tail."""
    out = _cut(_known(files, content), default_ranges(F.col("width").cast("long"), F.col("height").cast("long"), F.col("mip_count")), content)
    return out.select("archive_id", "path", "nth", F.col("r.first").cast("int").alias("start_mip"), F.col("r.last").cast("int").alias("end_mip"), "payload", "width", "height", "mip_count", "dxgi_format", "is_cubemap")


def rejected(files: DataFrame, content: str = "content", newest: bool = True) -> DataFrame:
    """archive_id, path, code of files that can't go into a texture archive."""
    k = _known(files, content)
    code = F.coalesce("error", F.when(F.col("dxgi_format").isin(*NEW_FORMATS) & F.lit(not newest), "format_error"))
    return k.withColumn("code", code).where("code is not null").select("archive_id", "path", "code")


def rejected_as_records(files: DataFrame, version: int, content: str = "content") -> DataFrame:
    """archive_id, path, code of textures whose format a record-table archive of the version doesn't take."""
    allowed = (*RECORD_FORMATS, *(RECORD_FORMATS_105 if version == 105 else ()))
    f = facts(files, content)
    code = F.coalesce("error", F.when(~F.col("dxgi_format").isin(*allowed), "format_error"))
    return f.withColumn("code", code).where("code is not null").select("archive_id", "path", "code")
