"""Payload extraction: range reads, decoding, and files under a target folder."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, paths
from ..functions.numbers import encode_little_endian as le

#: Stored bytes of neighbouring entries that one task reads.
RANGE_BYTES = 64 << 20
#: Bytes of payloads that one batch of a task holds before it goes on.
BATCH_BYTES = 64 << 20
#: Largest entry that is extracted into a row: what one binary value can hold.
MOST = (1 << 31) - 1024


def ranges(e: DataFrame) -> DataFrame:
    """One row a stored range: an entry's payload, or each chunk of a texture."""
    whole = e.where("chunks is null").select("archive_id", "path", "size_bytes", F.lit(0).alias("nth"), F.col("data_offset").alias("offset"), (F.col("stored_size") - (F.col("data_offset") - F.col("payload_offset"))).alias("length"), "raw_size", "compression")
    parts = e.where("chunks is not null").select("archive_id", "path", "size_bytes", F.posexplode("chunks").alias("nth", "c")).select("archive_id", "path", "size_bytes", "nth", F.col("c.payload_offset").alias("offset"), F.col("c.stored_size").alias("length"), F.col("c.raw_size").alias("raw_size"), F.col("c.compression").alias("compression"))
    return whole.unionByName(parts)


def read_ranges(r: DataFrame) -> DataFrame:
    """Adds ``stored``: the bytes of each range, null where the file ends before or has another size than it was scanned
    with. Neighbouring ranges share a task; what is read goes out whenever ``BATCH_BYTES`` of it are held."""
    dealt = r.repartition("archive_id", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("archive_id", "offset")
    names = [*r.columns, "stored"]

    def run(batches):
        name, f, size = None, None, -1
        try:
            for batch in batches:
                out, held, first = [], 0, 0
                at = [batch.schema.get_field_index(c) for c in ("archive_id", "offset", "length", "size_bytes")]
                for i, (a, o, n, total) in enumerate(zip(*(batch.column(i).to_pylist() for i in at), strict=True)):
                    if a != name:
                        if f:
                            f.close()
                        name, f = a, open(a, "rb")
                        size = os.fstat(f.fileno()).st_size
                    data = None
                    if n >= 0 and size == total and o + n <= size:
                        f.seek(o)
                        data = f.read(n)
                    out.append(data)
                    held += n
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([*batch.slice(first, i + 1 - first).columns, pa.array(out, pa.binary())], names)
                        out, held, first = [], 0, i + 1
                if out:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first).columns, pa.array(out, pa.binary())], names)
        finally:
            if f:
                f.close()

    schema = ", ".join(f"`{n}` {t}" for n, t in r.dtypes) + ", stored binary"
    return dealt.mapInArrow(run, schema)


def dds_header(width, height, mips, fmt, array_size, is_cubemap):
    """148-byte texture header with the extended block (flags and capabilities are fixed values of the format)."""
    cube = F.when(is_cubemap, 1).otherwise(0)
    n = lambda x: le(x.cast("long") if not isinstance(x, int) else F.lit(x).cast("long"), 4)
    caps = F.lit(0x1000) + F.when((mips > 1) | is_cubemap, 0x8).otherwise(0) + F.when(mips > 1, 0x400000).otherwise(0)
    parts = [F.lit(b"DDS "), n(124), n(0x2100F), n(height), n(width), n(0), n(0), n(mips), F.lit(bytes(44)), n(32), n(4), F.lit(b"DX10"), F.lit(bytes(20)), n(caps), n(cube * 0xFE00), F.lit(bytes(12)), n(fmt), n(3), n(cube * 4), n(array_size), n(0)]
    return F.concat(*parts)


def payloads(e: DataFrame, most: int = MOST) -> DataFrame:
    """archive_id, path, content, failure of each entry; textures get their header before their chunks.

    An entry of more than ``most`` raw or stored bytes is not read and fails with ``too_large``; one whose raw size
    can't be known (damaged prefix) with ``format_error``."""
    size = F.greatest("raw_size", "stored_size")
    failure = F.when(F.col("raw_size").isNull() | (F.col("error").isNotNull() if "error" in e.columns else F.lit(False)), "format_error").when(size > most, "too_large")
    sorted_out = e.withColumn("_failure", failure)
    refused = sorted_out.where("_failure is not null").select("archive_id", "path", F.lit(None).cast("binary").alias("content"), F.col("_failure").alias("failure"))
    e = sorted_out.where("_failure is null")
    got = codecs.decoded(F.col("compression"), F.coalesce("stored", F.lit(b"")), F.col("raw_size"))
    parts = read_ranges(ranges(e)).withColumn("d", got).select("archive_id", "path", "nth", F.col("d.content").alias("content"), F.when(F.col("stored").isNull(), "io_error").otherwise(F.col("d.error")).alias("error"))
    joined = parts.groupBy("archive_id", "path").agg(F.sort_array(F.collect_list(F.struct("nth", "content"))).alias("parts"), F.max("error").alias("failure"))
    head = F.when(F.col("chunks").isNotNull(), dds_header(F.col("width"), F.col("height"), F.col("mip_count"), F.col("dxgi_format"), F.col("array_size"), F.col("is_cubemap"))).otherwise(F.lit(b""))
    body = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, F.coalesce(p["content"], F.lit(b""))))
    out = joined.join(e.withColumn("head", head).select("archive_id", "path", "head"), ["archive_id", "path"])
    return out.select("archive_id", "path", F.when(F.col("failure").isNull(), F.concat("head", body)).alias("content"), "failure").unionByName(refused)


def publish(contents: DataFrame, directory: str, overwrite: bool = False) -> DataFrame:
    """Writes each (path, content) below ``directory`` through a temporary file; rows path, failure."""
    safe = contents.withColumn("failure", F.coalesce("failure", F.when(~paths.is_safe_destination(F.col("path")), "invalid_argument")))

    def run(batches):
        made = set()
        for batch in batches:
            out = []
            for path, content, failure in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if failure is None:
                    target = os.path.join(directory, *path.split("/"))
                    parent = os.path.dirname(target)
                    temp = os.path.join(parent, f".{uuid.uuid4().hex}")
                    try:
                        if parent not in made:
                            os.makedirs(parent, exist_ok=True)
                            made.add(parent)
                        with open(temp, "wb") as f:
                            f.write(content)
                        if overwrite:
                            os.replace(temp, target)
                        else:
                            os.link(temp, target)
                    except FileExistsError:
                        failure = "exists"
                    except OSError:
                        failure = "io_error"
                    finally:
                        if os.path.exists(temp):
                            os.unlink(temp)
                out.append({"path": path, "failure": failure})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("failure", pa.string())]))

    return safe.select("path", "content", "failure").mapInArrow(run, "path string, failure string")
