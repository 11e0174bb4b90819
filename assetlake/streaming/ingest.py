"""Incremental ingest: files that arrive in a folder become rows of the catalog, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetlake.sources.catalog import Catalog

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(root, content) of the files of a folder, as they come."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("path").alias("root"), "content")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the objects and diagnostics of what arrives to tables below `out`, once each: a batch that
    runs again writes over its own folder."""

    def batch(roots: DataFrame, number: int) -> None:
        catalog = Catalog.of(roots, **options)
        for name in ("objects", "resources", "diagnostics"):
            getattr(catalog, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        catalog.parsed.unpersist()
        catalog.items.unpersist()

    return arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
