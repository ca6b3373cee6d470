"""``python -m stowage.cli info|list|validate|pack|unpack``: exit code 0, 1 for a failure, 2 for wrong usage."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from .functions.paths import escaped
from .operators import catalog, validation
from .session import local_session, ship, written
from .sources import archives, dds, extract, writers


def _workers(text: str) -> int:
    """Workers from 1 to 1024; ``auto`` and 0 are one a processor."""
    n = 0 if text == "auto" else int(text)
    if not 0 <= n <= 1024:
        raise argparse.ArgumentTypeError("workers: 1 to 1024, auto or 0")
    return n or min(os.cpu_count() or 1, 1024)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stowage")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "list", "validate", "unpack"):
        c = sub.add_parser(name)
        c.add_argument("archive")
        if name == "list":
            c.add_argument("--details", action="store_true")
        if name == "validate":
            c.add_argument("--strict", action="store_true")
            c.add_argument("--family", choices=("bsa", "ba2"))
        if name == "unpack":
            c.add_argument("output")
            c.add_argument("--path", action="append")
            c.add_argument("--overwrite", action="store_true")
            c.add_argument("-j", "--threads", "--workers", dest="workers", type=_workers)
    c = sub.add_parser("pack")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--format", required=True, choices=list(writers.TARGETS))
    c.add_argument("--compress", choices=writers.POLICIES, default="default")
    c.add_argument("--embed-names", action="store_true")
    c.add_argument("-j", "--threads", "--workers", dest="workers", type=_workers)
    c.add_argument("--no-share", action="store_true")
    c.add_argument("--overwrite", action="store_true")
    return p


def _show(rows) -> None:
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))


def info(spark, a) -> int:
    head = archives.archives(archives.read_archives(spark, [a.archive])).withColumn("archive_flags", F.concat(F.lit("0x"), F.hex("archive_flags"))).first().asDict()
    for k, v in head.items():
        if v is not None:
            print(f"{k}: {v}")
    return int(head["error"] is not None)


def listing(spark, a) -> int:
    rows = archives.read_archives(spark, [a.archive])
    e = archives.entries(rows).withColumn("path", escaped(F.col("path")))
    _show(catalog.listing(e, a.details).drop("archive_id").toLocalIterator())
    return int(archives.archives(rows).first().error is not None)


def validate(spark, a) -> int:
    rows = archives.read_archives(spark, [a.archive])
    first = validation.first_error(archives.checked(rows), ["archive_id"]).first()
    facts = archives.archives(rows).withColumnRenamed("trailing_names", "file_name_table_has_trailing_bytes").withColumnRenamed("folder_names_mismatch", "folder_name_table_length_mismatch")
    facts = facts.withColumn("has_embedded_names", (F.col("variant") == "tes4") & (F.col("version") > 103) & (F.col("archive_flags").bitwiseAND(0x100) != 0))
    warned = validation.warnings(facts, archives.identity_mismatch(archives.entries(rows)), a.family)
    if first:
        print(f"error\t{first.code}\t{first.rule}")
    n = 0
    for r in warned.orderBy("warn_ord", "path").toLocalIterator():
        print(f"{r.severity}\t{r.code}\t{r.path or ''}")
        n += 1
    print("valid" if not first else "invalid")
    return int(bool(first) or a.strict and n > 0)


def unpack(spark, a) -> int:
    rows = archives.read_archives(spark, [a.archive])
    if archives.archives(rows).first().error:
        return 1
    e = archives.entries(rows)
    key = archives.paths.canonical(F.col("path"))
    if a.path:
        asked = spark.createDataFrame(list(enumerate(a.path)), "ord long, path string")
        results = written(catalog.bulk(asked, e.select("path", "raw_size")).select("ord", "path", "failure"), "requests")
        e = e.join(results.where("failure is null").select(key.alias("path")).distinct(), "path", "left_semi")
    if a.workers:
        e = e.repartition(a.workers)
    done = written(extract.publish(extract.payloads(e), a.output, a.overwrite), "published")
    if a.path:  # a result for each request, in the order of the requests; a path asked for twice is written once
        own = done.select(F.col("path").alias("_key"), F.col("failure").alias("_own"))
        done = results.withColumn("_key", key).join(own, "_key", "left").select("ord", "path", F.coalesce("failure", "_own").alias("failure")).orderBy("ord")
    else:
        done = done.orderBy("path")
    total = done.agg(F.count("*").alias("n"), F.count_if(F.col("failure").isNotNull()).alias("failed")).first()
    _show(done.where("failure is not null").select(escaped(F.col("path")), "failure").toLocalIterator())
    print(f"{total.n - total.failed} extracted, {total.failed} failed")
    return int(total.failed > 0)


def pack(spark, a) -> int:
    root = os.path.abspath(a.input)
    name, suffix = os.path.splitext(os.path.basename(a.output))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^file:/+", "/")
    e = files.select(F.lit(name).alias("archive_id"), F.substring(rel, len(root) + 2, 1 << 20).alias("path"), F.col("content").alias("payload"))
    if a.workers:
        e = e.repartition(a.workers)
    found = writers.problems(e, a.format, a.embed_names, spark.createDataFrame([(name,)], "archive_id string")).collect()
    family, version, _ = writers.TARGETS[a.format]
    if family == "dx10" and not found:
        textures = e.withColumnRenamed("payload", "content")
        found = dds.rejected(textures, newest=version > 1).collect()
    if found:
        _show(found)
        return 1
    source = dds.chunks(textures) if family == "dx10" else e
    done = writers.write(writers.segments(source, a.format, not a.no_share, a.compress, a.embed_names), os.path.dirname(os.path.abspath(a.output)), suffix, a.overwrite).collect()
    _show(done)
    return int(any(r.failure for r in done))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = ship(local_session(memory="4g"))
    return {"info": info, "list": listing, "validate": validate, "pack": pack, "unpack": unpack}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
