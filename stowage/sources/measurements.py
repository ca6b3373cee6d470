"""Evidence about archives: measured runs as CSV, inventories of a folder, fingerprints of extracted files."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import little_endian
from ..functions.paths import diagnostic
from ..operators.spans import duplicates
from . import archives

MEASURED = "label string, command string, archive string, size_bytes long, entry_count long, type string, variant string, version string, exit_code int, elapsed_ms double, diagnostic string"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV of measured runs with a header, its diagnostics made comparable. Columns are found by name."""
    raw = spark.read.csv(path, header=True)
    kinds = dict(c.strip().split() for c in MEASURED.split(","))
    picked = [F.expr(f"try_cast(`{c}` as {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    return raw.select(*picked).withColumn("diagnostic", diagnostic(F.col("diagnostic")))


def repeated_archives(runs: DataFrame) -> DataFrame:
    """Archives that a run names more than once: such a run can't be compared."""
    return duplicates(runs, "label", "command", "archive")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``, with slashes), size, sha256, family, variant, version, compression_method, entry_count and
    error of every archive in a folder. Each file is read once in pieces, by one task."""
    found = archives.archive_files(root)
    listed = spark.createDataFrame([(f,) for f in found], "archive_id string").repartition(max(len(found), 1))

    def run(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with open(name, "rb") as f:
                    out.append((name, os.path.relpath(name, root).replace(os.sep, "/"), hashlib.file_digest(f, "sha256").hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, ["archive_id", "path", "sha256"])

    digests = listed.mapInArrow(run, "archive_id string, path string, sha256 string")
    facts = archives.archives(archives.read_archives(spark, found))
    return digests.join(facts, "archive_id").select("path", F.col("size_bytes").alias("size"), "sha256", "family", "variant", "version", "compression_method", F.col("file_count").alias("entry_count"), "error")


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with size, sha256 and for textures their header in hex and the digests of what follows 128 and 148 bytes.

    ``identity`` is equal for files that are the same texture, whatever the hints in their headers say: size, mips,
    format, array and faces with the pixels; for other files it is their digest."""
    c = F.col(content).cast("binary")
    texture = F.coalesce(F.substring(c, 1, 4) == F.lit(b"DDS "), F.lit(False))
    extended = texture & (F.substring(c, 85, 4) == F.lit(b"DX10"))
    after = lambda n: F.sha2(F.substring(c, n + 1, 2147483647), 256)
    n = lambda at: little_endian(c, at, 4).cast("string")
    shape = F.concat_ws(",", n(16), n(12), F.greatest(little_endian(c, 28, 4), F.lit(1)).cast("string"), n(128), F.greatest(little_endian(c, 140, 4), F.lit(1)).cast("string"), n(136))
    out = files.withColumn("size", F.octet_length(c).cast("long")).withColumn("sha256", F.sha2(c, 256))
    out = out.withColumn("dds_header_hex", F.when(texture, F.lower(F.hex(F.substring(c, F.lit(1), F.when(extended, 148).otherwise(128))))))
    out = out.withColumn("payload_sha256_128", F.when(texture, after(128))).withColumn("payload_sha256_148", F.when(texture, after(148)))
    return out.withColumn("identity", F.when(extended, F.concat_ws(":", F.lit("texture"), shape, F.col("payload_sha256_148"))).otherwise(F.col("sha256")))
