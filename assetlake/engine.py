"""The engine's verbs (CMD-01 to CMD-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators import hierarchy, sinks
from assetlake.sources import catalog as catalog_


class Engine:
    """A collection opened from a path or from bytes; every verb returns a DataFrame."""

    def __init__(self, spark: SparkSession, catalog: catalog_.Catalog):
        self.spark, self.catalog = spark, catalog

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Engine:
        return cls(spark, catalog_.Catalog.open(spark, path, **options))

    @classmethod
    def of(cls, spark: SparkSession, inputs: list[tuple[str, bytes]], **options) -> Engine:
        return cls(spark, catalog_.Catalog.of(catalog_.in_memory(spark, inputs), **options))

    def inspect(self) -> DataFrame:
        """What each root holds, in order."""
        return self.catalog.items.select("root", "seq", "file", "kind", "depth", F.octet_length("content").alias("bytes"), "family", "message").orderBy("root", "seq")

    def info(self) -> DataFrame:
        return self.catalog.histogram()

    def list(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return self.catalog.page(offset, limit)

    def scene(self) -> DataFrame:
        """Paths of all game objects from their roots."""
        nodes = self.catalog.scene()
        key = lambda a, b: F.when(F.col(b).isNotNull(), F.concat_ws("\0", a, F.col(b).cast("string")))
        slim = nodes.select(key("file", "path_id").alias("key"), key("parent_file", "parent_id").alias("parent"), "name", "file", "path_id").persist()
        lost = hierarchy.unreachable(slim, "key", "parent").limit(1).collect()
        if lost:
            raise hierarchy.HierarchyError(f"no root reaches {lost[0]['path_id']} in {lost[0]['file']}")
        found = hierarchy.paths(slim, "key", "parent", "name")
        return found.join(slim.select("key", "file", "path_id"), "key").select("file", "path_id", "depth", "path").orderBy("path")

    def export(self, folder: str, mode: str = "json", class_ids=None, overwrite: bool = False) -> DataFrame:
        return sinks.export(self.catalog, folder, mode, class_ids, overwrite)

    def extract(self, folder: str, overwrite: bool = False) -> DataFrame:
        return sinks.extract(self.catalog, folder, overwrite)
