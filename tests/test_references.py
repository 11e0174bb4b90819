"""References as joins."""

import pytest
from pyspark.sql import functions as F

from assetlake.operators import references as ref


@pytest.mark.parametrize("null", [True, False])
def test_null_references_are_not_dealt_to_one_task(spark, null):
    told = F.col("id") % 2 == 0
    rows = spark.range(0, 20_000, 1, 8)
    refs = rows.select("id", F.when(~told | F.lit(null), F.col("id")).alias("key"))
    targets = rows.select(F.col("id").alias("key"), (F.col("id") * 10).alias("target"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = ref.resolve(refs, targets, ["key"], null=told if null else None).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 4_000


def test_null_references_keep_their_rows(spark):
    refs = spark.createDataFrame([("a", 1, 7), ("b", None, 7), ("c", 2, 0), ("d", 3, None), ("d", 3, None), ("e", 9, 7), ("f", 1, 7)], "name string, key int, kind int")
    targets = spark.createDataFrame([(1, "x", "t"), (1, "y", "t"), (2, "x", "u"), (3, "n", "v"), (None, "x", "w")], "key int, name string, target string")
    null, wanted = F.col("kind") == 0, F.col("target") != "v"
    rest = [("b", None, 7, None, None), ("d", 3, None, None, None), ("d", 3, None, None, None), ("e", 9, 7, None, None)]
    ones = [(n, 1, 7, t, "t") for n in "af" for t in "xy"]
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    left, inner = (ref.resolve(refs, targets, ["key"], wanted, null, how) for how in ("left", "inner"))
    assert left.columns == ["name", "key", "kind", "name", "target"]
    assert got(left) == sorted([*ones, *rest, ("c", 2, 0, None, None)], key=str) and got(inner) == sorted(ones, key=str)
    plain = ref.resolve(refs, targets, ["key"], wanted)
    assert plain.columns == ["key", "name", "kind", "name", "target"]
    assert got(plain) == sorted([(b, a, *c) for a, b, *c in [*ones, *rest, ("c", 2, 0, "x", "u")]], key=str)
