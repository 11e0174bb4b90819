"""Bit-packed arrays (NUM-01 to NUM-04, NUM-07, NUM-08) with numpy, and as column functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    """`count` little-endian fields of `width` bits, 32 at most."""
    if not 0 <= width <= 32 or len(data) * 8 < count * width:
        raise ValueError(f"{count} fields of {width} bits don't fit in {len(data)} bytes")
    if not width:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * width].reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def pack_bits(values, width: int) -> bytes:
    """The inverse of unpack_bits."""
    values = np.asarray(values, np.uint64)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_floats(data: bytes, count: int, width: int, span: float, start: float) -> np.ndarray:
    """NUM-02: single precision throughout; without bits every value is the start."""
    if not width:
        return np.full(count, np.float32(start), np.float32)
    scale = (np.float32(1.0) / np.float32(span)) * np.float32((1 << width) - 1)
    return unpack_bits(data, count, width).astype(np.float32) / scale + np.float32(start)


def unpack_quaternions(data: bytes, count: int) -> np.ndarray:
    """NUM-04: 32 bits each: three flags (which component is left out, its sign), then components of
    10 bits, of which the one before the last is of 9; the one left out follows from unit length."""
    at, out = 0, np.zeros((count, 4), np.float32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(np.int64)

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise ValueError("packed quaternions are cut off")
        at += n
        return int((bits[at - n : at] << np.arange(n)).sum())

    for q in out:
        flags = take(3)
        left, total = flags & 3, np.float32(0)
        for j in range(4):
            if j == left:
                continue
            width = 9 if (left + 1) % 4 == j else 10
            q[j] = np.float32(take(width)) / (np.float32(0.5) * np.float32((1 << width) - 1)) - np.float32(1)
            total += q[j] * q[j]
        q[left] = np.sqrt(max(np.float32(0), np.float32(1) - total))
        if flags & 4:
            q[left] = -q[left]
    return out


def half(data: bytes) -> np.ndarray:
    """NUM-07: 16-bit floats, widened."""
    return np.frombuffer(data, "<f2").astype(np.float32)


def rgb9e5(data: bytes) -> np.ndarray:
    """NUM-07: three mantissas of nine bits and one exponent."""
    v = np.frombuffer(data, "<u4")
    scale = np.exp2((v >> 27).astype(np.float32) - 24)
    return np.stack([((v >> s) & 511).astype(np.float32) * scale for s in (0, 9, 18)], axis=1)


def octahedral_normals(pairs: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """NUM-08: z from x and y; a pair outside the unit circle is brought onto it."""
    squares = (pairs.astype(np.float32) ** 2).sum(axis=1)
    outside = squares > 1
    xy = np.where(outside[:, None], pairs / np.sqrt(np.maximum(squares, 1))[:, None], pairs)
    z = np.where(outside, 0, np.sqrt(np.maximum(0, 1 - squares)))
    return np.c_[xy, np.where(negative, -z, z)].astype(np.float32)


def floats(data: Column, count: Column, width: Column, span: Column, start: Column) -> Column:
    """NUM-02 over a column of packed vectors."""

    @arrow_udf("array<float>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns))
            yield pa.array([None if d is None else unpack_floats(d, n, w, r, s) for d, n, w, r, s in rows], pa.list_(pa.float32()))

    return run(data, count, width, span, start)


def integers(data: Column, count: Column, width: Column) -> Column:
    """NUM-03 over a column of packed vectors."""

    @arrow_udf("array<long>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([None if d is None else unpack_bits(d, n, w).astype(np.int64) for d, n, w in zip(*(c.to_pylist() for c in columns))], pa.list_(pa.int64()))

    return run(data, count, width)
