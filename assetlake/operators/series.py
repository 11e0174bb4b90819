"""Time series, spans and windows (WIN-01 to WIN-06, ANI-02, ANI-03, JOIN-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.operators.storage import written


def offsets(df: DataFrame, by: list[str], order: list[str], width: str, name: str) -> DataFrame:
    """WIN-05: the sum of the widths before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(width).over(w), F.lit(0).cast("long")))


def spans(rows: DataFrame, indices: DataFrame, by: list[str], binding: str, width: str, index: str) -> DataFrame:
    """JOIN-16: the row whose span [start, start + width) holds an index, and whether it is its start.

    Spans of a group don't overlap: both sides are sorted together and the last start is carried
    along, so a join needs no range condition.
    """
    starts = offsets(rows, by, [binding], width, "start").select(*by, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(binding, "start", width).alias("_span"), F.lit(None).cast("long").alias(index))
    asked = indices.select(*by, F.col(index).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_span"].dataType).alias("_span"), index)
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("_last", F.last("_span", ignorenulls=True).over(w)).filter(f"_kind = 1 and {index} < _last.start + _last.{width}")
    return found.select(*by, index, F.col(f"_last.{binding}").alias(binding), (F.col(index) == F.col("_last.start")).alias("on_start"))


def in_slopes(keys: DataFrame, by: list[str], order: list[str], time: str, value: str) -> DataFrame:
    """WIN-02: (value - value before) / (time - time before) in frames [2, last); else 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    frame, count = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*by))
    gap = F.col(time) - F.lag(time).over(w)
    slope = (F.col(value) - F.lag(value).over(w)) / F.when(gap > 0, gap)
    return keys.withColumn("in_slope", F.when((frame >= 2) & (frame <= count - 2), F.coalesce(slope, F.lit(0.0))).otherwise(0.0))


def trimmed(frames: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """WIN-03: without the first and last frame of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(F.lit(1)).over(w)).filter("_n > 1 and _next is not null").drop("_n", "_next")


def segments(keys: DataFrame, by: str, order: list[str], key: str, value: str) -> DataFrame:
    """WIN-01: walk over a curve's keys; a dip that is made good at once takes two keys (inverse
    stepped), any other segment one: stepped, linear or bezier. Of two neighbouring keys one at most
    starts a dip, so the key after a dip is what the walk leaves out."""
    w = Window.partitionBy(by).orderBy(*order)
    now, one, two = F.col("_value"), F.col("_one"), F.col("_two")
    walked = keys.select(by, *order, F.col(key).alias("_key"), F.col(value).alias("_value")).select("*", F.lead("_value").over(w).alias("_one"), F.lead("_value", 2).over(w).alias("_two"))
    walked = walked.withColumn("_dip", F.coalesce((one < now) & (two > now), F.lit(False)))
    walked = walked.withColumn("_inside", F.lag("_dip", 1, False).over(w)).filter(~F.col("_inside") & one.isNotNull())
    kind = F.when(F.col("_dip"), "inverse_stepped").when(one > now * 2, "stepped").when(F.abs(one - now) < 1, "linear").otherwise("bezier")
    return walked.select(by, F.col("_key").alias(key), kind.alias("segment"))


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """SRT-04: the place of every row in a total order, from 1: ranges are sorted apart from each other and shifted
    by the sizes of those before."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    within = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, shift, total = F.shiftright("_at", 33), F.lit(0).cast("long"), 0
    for p, n in sorted((r["p"], r["count"]) for r in within.groupBy(part.alias("p")).count().collect()):
        shift = F.when(part == p, F.lit(total).cast("long")).otherwise(shift)
        total += n
    return within.withColumn(name, shift + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def recent(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """SRT-05: the first `most` rows of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def dense(df: DataFrame, key: str, samples: str, curves: int, begin: float, rate: float) -> DataFrame:
    """ANI-02: frame-major samples as (frame, curve, time, value)."""
    keys = df.select(key, F.posexplode(samples).alias("_pos", "_value"))
    frame = F.floor(F.col("_pos") / curves).cast("long")
    return keys.select(key, frame.alias("frame"), (F.col("_pos") % curves).cast("long").alias("curve"), (F.lit(begin) + frame / F.lit(rate)).alias("time"), F.col("_value").cast("double").alias("value"))


def constant(df: DataFrame, stop: float) -> DataFrame:
    """ANI-03: each value at 0 and at the stop."""
    return df.withColumn("time", F.explode(F.array(F.lit(0.0), F.lit(stop))))


def strip(df: DataFrame, by: str, order: list[str], index: str) -> DataFrame:
    """WIN-06, FLT-08: triangles of a strip; every other one is turned, those with equal corners are dropped."""
    w = Window.partitionBy(by).orderBy(*order)
    i, a, b, c = (F.row_number().over(w) - 1).cast("long"), F.col(index), F.lead(index).over(w), F.lead(index, 2).over(w)
    corners = df.select(by, i.alias("i"), a.alias("_a"), b.alias("_b"), c.alias("_c")).filter("_c is not null and _a <> _b and _b <> _c and _a <> _c")
    even = F.col("i") % 2 == 0
    return corners.select(by, "i", F.when(even, F.col("_a")).otherwise(F.col("_b")).alias("v0"), F.when(even, F.col("_b")).otherwise(F.col("_a")).alias("v1"), F.col("_c").alias("v2"))
