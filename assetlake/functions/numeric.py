"""Numbers and bits (NUM-01 to NUM-14). Single precision is kept by a cast after every operation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x: Column) -> Column:
    return x.cast("float")


def dequantize(value: Column, bits: int, span: Column, start: Column) -> Column:
    """NUM-02: value / ((1 / span) * max) + start, rounded to single precision three times."""
    scale = f32(f32(F.lit(1.0) / f32(span)) * f32(F.lit(float((1 << bits) - 1))))
    return f32(f32(f32(value) / scale) + f32(start))


def quantize(value: Column, bits: int, span: Column, start: Column) -> Column:
    """The nearest of 2^bits steps of a range."""
    return F.floor((value.cast("double") - start.cast("double")) / span.cast("double") * ((1 << bits) - 1) + 0.5).cast("int")


def flip_handedness(x: Column, y: Column, z: Column) -> Column:
    """NUM-06: a position in the other handedness."""
    return F.struct((-x).alias("x"), y.alias("y"), z.alias("z"))


def euler(x: Column, y: Column, z: Column, w: Column) -> dict[str, Column]:
    """NUM-05: XYZ angles in degrees of a quaternion, with the gimbal branch near a pitch of 90 degrees."""
    norm = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = (c / norm for c in (x, y, z, w))
    m20, m21, m22 = 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    m10, m00, m11, m12 = 2 * (x * y + w * z), 1 - 2 * (y * y + z * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)
    flat = F.sqrt(m00 * m00 + m10 * m10)
    gimbal = flat <= F.lit(16 * 2.220446049250313e-16)
    pitch = F.degrees(F.atan2(-m20, flat))
    return {
        "angle_x": F.when(gimbal, F.degrees(F.atan2(-m12, m11))).otherwise(F.degrees(F.atan2(m21, m22))),
        "angle_y": pitch,
        "angle_z": F.when(gimbal, F.lit(0.0)).otherwise(F.degrees(F.atan2(m10, m00))),
    }


def bezier(t0: Column, v0: Column, out_slope: Column, t1: Column, v1: Column, in_slope: Column) -> dict[str, Column]:
    """NUM-09: control points at the thirds of an interval."""
    third = (t1 - t0) / 3
    return {"c1_time": t0 + third, "c1_value": v0 + out_slope * third, "c2_time": t1 - third, "c2_value": v1 - in_slope * third}


def aligned(offset: Column, to: int) -> Column:
    """NUM-14: the next multiple."""
    return offset + F.pmod(-offset, F.lit(to))


def bit_field(data: Column, index: Column, width: int) -> Column:
    """NUM-01: the index-th little-endian field of `width` bits (32 at most) of a binary."""
    bit = index.cast("long") * width
    byte = lambda k: F.conv(F.hex(data.substr((F.floor((bit + k) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    one = lambda k: F.pmod(F.floor(byte(k) / F.pow(F.lit(2.0), F.pmod(bit + k, F.lit(8)))), F.lit(2)).cast("long")
    places = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, k: total + one(k) * F.pow(F.lit(2.0), k).cast("long"))


def finite(x: Column) -> Column:
    """NUM-17: neither NaN nor infinite."""
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def unity_crc(text: Column) -> Column:
    """AGG-15: CRC-32 of the UTF-8 bytes."""
    return F.crc32(text.cast("binary"))


def ticks(seconds: Column, per_second: int) -> Column:
    """NUM-13: whole ticks, halves away from zero."""
    return F.round(seconds * per_second).cast("long")
