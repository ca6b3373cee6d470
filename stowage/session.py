"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package to the Python workers of all executors, once a context; the driver serves the archive."""
    sc = spark.sparkContext
    if not getattr(sc, "_stowage_shipped", False):
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="stowage-"), "stowage.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
            top = here.parent / "corpus_pipeline.py"
            if top.exists():
                z.write(top, top.name)
        sc.addPyFile(target)
        sc._stowage_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine (tests) may do without and gets one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def written(df, name: str):
    """``df`` written to the shared folder and read again, so that plans built on it stay small and work is done once.

    The folder is ``spark.checkpoint.dir``, which all executors share. Files stay there for as long as results may be
    read; whoever owns the folder clears it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
