"""Every registered query, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT event_type AS class_name, count(*) AS object_count, CAST(sum(event_id) AS BIGINT) AS byte_total FROM events GROUP BY 1")
def info_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02: objects and bytes by class."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class_name")).agg(F.count(F.lit(1)).alias("object_count"), F.sum("event_id").alias("byte_total"))
