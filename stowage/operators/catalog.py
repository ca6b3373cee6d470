"""The archive catalog: listing, lookups, bulk requests and what extraction would do with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical, display, folder_of


def listing(entries: DataFrame, details: bool = False) -> DataFrame:
    """Entries by canonical path, bytewise."""
    cols = ["archive_id", "path", *(["raw_size", "stored_size", "compression"] if details else [])]
    return entries.select(*cols).orderBy("archive_id", "path")


def with_paths(entries: DataFrame, path: str = "original_path") -> DataFrame:
    """Adds the canonical path and the spelling shown; entries whose path is not valid have a null path."""
    return entries.withColumn("path", canonical(F.col(path))).withColumn("display_path", display(F.col(path)))


def find(entries: DataFrame, path: str) -> DataFrame:
    """The entries of a path in any spelling; the filter reaches the scan."""
    return entries.where(F.col("path") == canonical(F.lit(path)))


def contains(entries: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """Each wanted path with whether an entry has it; a path that is not valid is found nowhere."""
    keyed = wanted.withColumn("_key", canonical(F.col(path)))
    known = entries.select(F.col("path").alias("_key")).distinct().withColumn("_found", F.lit(True))
    return keyed.join(known, "_key", "left").select(*wanted.columns, F.coalesce("_found", F.lit(False)).alias("found"))


def bulk(requests: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """requests(ord, path) -> ord, path, first_ord, failure and the entry, one row a request.

    Requests for the same spelling are worked once and mirror the first. A path that is not valid fails with
    ``invalid_argument``, one without an entry with ``not_found``, one whose raw size can't be read with ``format_error``, an entry over ``most`` raw bytes with ``too_large``."""
    first = requests.groupBy("path").agg(F.min("ord").alias("first_ord")).withColumn("_key", canonical(F.col("path")))
    found = first.join(entries.withColumnRenamed("path", "_key").withColumn("_there", F.lit(True)), "_key", "left")
    failure = F.when(F.col("_key").isNull(), "invalid_argument").when(F.col("_there").isNull(), "not_found").when(F.col("raw_size").isNull(), "format_error")
    if most is not None:
        failure = failure.when(F.col("raw_size") > most, "too_large")
    worked = found.withColumn("failure", failure).drop("_key", "_there")
    return requests.select("ord", F.col("path").alias("_p")).join(worked.withColumnRenamed("path", "_p"), "_p").withColumnRenamed("_p", "path")


def parents(paths: DataFrame, path: str = "path") -> DataFrame:
    """Folders to create, each once."""
    return paths.select(folder_of(F.col(path)).alias("parent")).distinct()


def with_folder_failures(planned: DataFrame, failed: DataFrame) -> DataFrame:
    """planned(path, failure) and failed(parent, code): a destination fails with its folder unless it failed before."""
    p = planned.withColumn("parent", folder_of(F.col("path")))
    return p.join(failed.withColumnRenamed("code", "_code"), "parent", "left").withColumn("failure", F.coalesce("failure", "_code")).drop("_code")


def outcome(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("requested"), F.count_if(F.col("failure").isNull()).alias("succeeded"), F.count_if(F.col("failure").isNotNull()).alias("failed"))
