"""Validation rules as data: every violation is a row; the first one decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_sound

#: Largest payload that an extraction check reads by default.
EXTRACT_LIMIT = 64 << 20
SEVERITY = {
    "target_family_mismatch": "risky",
    "bsa_embedded_name_compatibility_risk": "risky",
    "ba2_record_identity_mismatch": "risky",
    "bsa_file_name_table_trailing_bytes": "advisory",
    "bsa_folder_name_table_length_mismatch": "advisory",
    "compressed_sound_payload": "advisory",
}


def violations(rows: DataFrame, key: list[str], index: str, rules: list[tuple[str, str, Column]], phase: int = 0) -> DataFrame:
    """key, phase, record_index, rule_rank, code, rule: one row for each rule (name, error code, condition) a row breaks.

    One pass: the broken rules of a row are an array that is exploded."""
    broken = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rank).alias("rule_rank"), F.lit(code).alias("code"), F.lit(name).alias("rule"))) for rank, (name, code, cond) in enumerate(rules))), lambda v: v.isNotNull())
    return rows.select(*key, F.lit(phase).alias("phase"), F.col(index).cast("long").alias("record_index"), F.explode(broken).alias("v")).select(*key, "phase", "record_index", "v.*")


def first_error(found: DataFrame, key: list[str]) -> DataFrame:
    """The violation that a sequential check would meet first: by phase, then record, then rule."""
    g = found.groupBy(*key).agg(F.min(F.struct("phase", "record_index", "rule_rank", "code", "rule")).alias("e"), F.count("*").alias("violations"))
    return g.select(*key, F.col("e.phase").alias("phase"), F.col("e.record_index").alias("record_index"), F.col("e.code").alias("code"), F.col("e.rule").alias("rule"), "violations")


def warnings(archives: DataFrame, entries: DataFrame, expected_family: str | None = None) -> DataFrame:
    """archive_id, warn_ord, code, severity, path: family, then archive, then entry warnings of each archive."""
    whole = [
        ("target_family_mismatch", F.lit(expected_family).isNotNull() & (F.col("family") != F.lit(expected_family))),
        ("bsa_embedded_name_compatibility_risk", F.col("has_embedded_names")),
        ("bsa_file_name_table_trailing_bytes", F.col("file_name_table_has_trailing_bytes")),
        ("bsa_folder_name_table_length_mismatch", F.col("folder_name_table_length_mismatch")),
    ]
    each = [("ba2_record_identity_mismatch", F.col("record_identity_mismatch")), ("compressed_sound_payload", is_sound(F.col("path")) & (F.col("compression") != "none"))]

    def raised(rows: DataFrame, rules, path: Column, base: int) -> DataFrame:
        found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(base + i).alias("warn_ord"), F.lit(n).alias("code"), F.lit(SEVERITY[n]).alias("severity"))) for i, (n, c) in enumerate(rules))), lambda x: x.isNotNull())
        return rows.select("archive_id", path.alias("path"), F.explode(found).alias("w")).select("archive_id", "w.*", "path")

    return raised(archives, whole, F.lit(None).cast("string"), 0).unionByName(raised(entries, each, F.col("path"), len(whole)))


def report(archives: DataFrame, errors: DataFrame, warned: DataFrame) -> DataFrame:
    """One row an archive: numbers of errors and warnings, valid (no error), clean (no warning either)."""
    e = errors.groupBy("archive_id").agg(F.count("*").alias("errors"))
    w = warned.groupBy("archive_id").agg(F.count("*").alias("warnings"), F.count_if(F.col("severity") == "risky").alias("risky"))
    out = archives.select("archive_id").join(e, "archive_id", "left").join(w, "archive_id", "left").na.fill(0, ["errors", "warnings", "risky"])
    return out.withColumn("valid", F.col("errors") == 0).withColumn("clean", (F.col("errors") == 0) & (F.col("warnings") == 0))


def too_large(entries: DataFrame, limit: int = EXTRACT_LIMIT) -> DataFrame:
    """Entries that an extraction check leaves out: raw or stored size over the limit, of the whole or of a chunk."""
    over = (F.col("raw_size") > limit) | (F.col("stored_size") > limit)
    if "chunks" in entries.columns:
        over |= F.coalesce(F.exists("chunks", lambda c: (c["raw_size"] > limit) | (c["stored_size"] > limit)), F.lit(False))
    return entries.where(over)
