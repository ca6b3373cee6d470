"""Archives as they arrive in a folder: a stream of their rows, and catalogs kept up to date."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession

from ..sources import archives


def arriving(spark: SparkSession, directory: str, files_each: int = 100) -> DataFrame:
    """Streaming rows, as ``read_archives`` gives them, of files that come to lie in ``directory``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_each).load(directory).select("path", "content")
    schema = archives._arrow_schema()

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from archives._batches(name, io.BytesIO(content.as_py()), schema)

    return files.mapInArrow(run, archives.SCHEMA)


def keep_catalog(rows: DataFrame, target: str, checkpoint: str):
    """Starts a query that appends arriving archives' rows to Parquet files, each archive once."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
