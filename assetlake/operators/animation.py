"""Clips (ANI-01, ANI-05): streamed keys, their slopes, and curves as tracks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.functions import numeric
from assetlake.sources.binary import InvalidData

KEYS = pa.list_(pa.struct([("frame", pa.int32()), ("time", pa.float32()), ("curve", pa.int32()), ("c0", pa.float32()), ("c1", pa.float32()), ("out_slope", pa.float32()), ("value", pa.float32()), ("last", pa.int32())]))
KEYS_DDL = "array<struct<frame: int, time: float, curve: int, c0: float, c1: float, out_slope: float, value: float, last: int>>"


def streamed_keys(data: bytes) -> list[dict]:
    """ANI-01: frames of a time, a count and as many keys: a curve's number, three coefficients and a value."""
    out, at, frame = [], 0, 0
    while at + 8 <= len(data):
        time, count = struct.unpack_from("<fi", data, at)
        at += 8
        if count < 0 or at + 20 * count > len(data):
            raise InvalidData(f"frame {frame} has {count} keys, which don't fit")
        for _ in range(count):
            curve, c0, c1, slope, value = struct.unpack_from("<i4f", data, at)
            at += 20
            out.append({"frame": frame, "time": time, "curve": curve, "c0": c0, "c1": c1, "out_slope": slope, "value": value})
        frame += 1
    if at != len(data):
        raise InvalidData(f"{len(data) - at} bytes of a streamed clip are left")
    return [k | {"last": frame - 1} for k in out]  # the last frame may be without keys


def streamed(data: Column) -> Column:
    @arrow_udf(KEYS_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if v is None else streamed_keys(v) for v in values.to_pylist()], KEYS)

    return run(data)


def next_in_slope(dx: Column, c0: Column, c1: Column, out_slope: Column, value: Column, following: Column) -> Column:
    """WIN-02: the slope into the following key of a cubic segment; a segment without coefficients is stepped (infinite)."""
    d = F.greatest(dx.cast("double"), F.lit(0.0001))
    rise = following - value
    slope = (3 * rise - 2 * out_slope * d - c1 * d * d) / d
    return F.when((c0 == 0) & (c1 == 0) & (out_slope == 0), F.lit(float("inf"))).otherwise(slope)


def streamed_tracks(clips: DataFrame, key: str, data: str) -> DataFrame:
    """(key, curve, time, value, in_slope, out_slope) of streamed clips, without the first and last frame."""
    keys = clips.select(key, F.inline(streamed(F.col(data))))
    w = Window.partitionBy(key, "curve").orderBy("frame")
    before = lambda c: F.lag(c).over(w)
    slope = next_in_slope(F.col("time") - before("time"), before("c0"), before("c1"), before("out_slope"), before("value"), F.col("value"))
    sloped = keys.withColumn("in_slope", F.when(F.col("frame") >= 2, F.coalesce(slope, F.lit(0.0))).otherwise(0.0))
    return sloped.filter("frame >= 1 and frame < last").select(key, "curve", "time", "value", "in_slope", "out_slope")


def rotation_tracks(keys: DataFrame, by: list[str]) -> DataFrame:
    """ANI-05: quaternion keys (q with x, y, z, w) as three tracks of angles in the other handedness."""
    q = F.col("q")
    angles = numeric.euler(q["x"], -q["y"], -q["z"], q["w"])
    kinds = F.array(*[F.struct(F.lit(n).alias("axis"), c.alias("value")) for n, c in angles.items()])
    return keys.select(*by, "time", F.inline(kinds))


def muscle_matrix(samples: np.ndarray, curves: int) -> np.ndarray:
    """A frame-major array as (frames, curves)."""
    if curves <= 0 or len(samples) % curves:
        raise InvalidData(f"{len(samples)} samples don't make frames of {curves}")
    return samples.reshape(-1, curves)
