"""Exact deduplication through counting quotient filters.

Every partition folds the 64-bit fingerprints of its texts into counting quotient filters, one
for each shard of the quotient space. A shard's filters merge losslessly by their sorted
remainders. Only texts whose merged count is above one go to byte verification, where whole
texts are compared.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import join_small, materialize, pack, pick, text_of, unpack

#: Fingerprints that a partition gathers before it closes its filters, and those meant for a shard.
FLUSH, PER_SHARD = 4_000_000, 1 << 17


class QuotientFilter:
    """A counting quotient filter without false merges: the quotient and remainder are the whole key.

    occupied: a bit for each quotient; last: a bit for each slot that ends a run; remainders and
    counts: one for each slot, sorted by quotient and then remainder.
    """

    def __init__(self, width: int, q: int, occupied: np.ndarray, last: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.width, self.q, self.occupied, self.last, self.remainders, self.counts = width, q, occupied, last, remainders, counts

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """keys: sorted, distinct, below 2^width."""
        q = min(width - 1, max(4, int(len(keys)).bit_length()))
        r = np.uint64(width - q)
        quotients = (keys >> r).astype(np.int64)
        occupied, last = np.zeros(1 << q, bool), np.zeros(len(keys), bool)
        occupied[quotients] = True
        if len(keys):
            last[:-1] = quotients[1:] != quotients[:-1]
            last[-1] = True
        return cls(width, q, occupied, last, keys & ((np.uint64(1) << r) - np.uint64(1)), counts)

    def keys(self) -> np.ndarray:
        ends = np.flatnonzero(self.last)
        runs = np.diff(ends, prepend=-1)
        return (np.repeat(np.flatnonzero(self.occupied), runs).astype(np.uint64) << np.uint64(self.width - self.q)) | self.remainders

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Sum the counts of equal keys; nothing is lost, whatever the sizes of the filters."""
        keys = np.concatenate([f.keys() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if not len(keys):
            return cls.of(keys, counts, filters[0].width)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return cls.of(keys[starts], np.add.reduceat(counts, starts), filters[0].width)

    def dump(self) -> bytes:
        n, size = len(self.remainders), (self.width - self.q + 7) // 8
        many = np.flatnonzero(self.counts > 1)
        return b"".join((
            struct.pack("<BBQQ", self.width, self.q, n, len(many)), np.packbits(self.occupied).tobytes(), np.packbits(self.last).tobytes(),
            np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]).tobytes(),
            many.astype("<u4").tobytes(), self.counts[many].astype("<u8").tobytes(),
        ))

    @classmethod
    def load(cls, blob: bytes) -> QuotientFilter:
        width, q, n, more = struct.unpack_from("<BBQQ", blob)
        at, size, data = struct.calcsize("<BBQQ"), (width - q + 7) // 8, np.frombuffer(blob, np.uint8)

        def take(k: int) -> np.ndarray:
            nonlocal at
            at += k
            return data[at - k : at]

        occupied = np.unpackbits(take(((1 << q) + 7) // 8))[: 1 << q].astype(bool)
        last = np.unpackbits(take((n + 7) // 8))[:n].astype(bool)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = take(n * size).reshape(n, size)
        counts = np.ones(n, np.uint64)
        at_many = take(4 * more).copy().view("<u4")
        counts[at_many] = take(8 * more).copy().view("<u8")
        return cls(width, q, occupied, last, wide.reshape(-1).view("<u8").copy(), counts)


def _fold(parts: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    width = 64 - bits
    shards = (keys >> np.uint64(width)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(keys) else np.zeros(0, int)
    low = keys & np.uint64((1 << width) - 1)
    for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
        blob = QuotientFilter.of(low[a:b], counts[a:b].astype(np.uint64), width).dump()
        yield pa.RecordBatch.from_arrays([pa.array([shards[a]], pa.int64()), pa.array([blob], pa.binary())], ["shard", "filter"])


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, copies) of the values in a single long column that occur more than once, from merged filters.

    A partition's memory holds FLUSH fingerprints; a shard's merged filter about PER_SHARD keys,
    as the number of shards follows the row count. Copies collapse before the shuffle.
    """
    rows = fingerprints.count()
    bits = max(5, int(max(1, rows // PER_SHARD)).bit_length())

    def build(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held += len(parts[-1])
            if held >= FLUSH:
                yield from _fold(parts, bits)
                parts, held = [], 0
        if held:
            yield from _fold(parts, bits)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = QuotientFilter.merge([QuotientFilter.load(x) for x in pdf["filter"]])
        many = merged.counts > 1
        keys = merged.keys()[many] | (np.uint64(int(pdf["shard"].iloc[0])) << np.uint64(64 - bits))
        return pd.DataFrame({"fp": keys.view(np.int64), "copies": merged.counts[many].astype(np.int64)})

    filters = fingerprints.mapInArrow(build, "shard long, filter binary")
    return filters.groupBy("shard").applyInPandas(merge, "fp long, copies long")


def _verified(packed: DataFrame, kept) -> tuple[DataFrame, DataFrame, int]:
    """Fingerprints that repeat, and the texts that bear them, grouped by their bytes.

    packed has _fp, _text, _id; kept: aggregates for each distinct text.
    """
    repeated = materialize(repeated_fingerprints(packed.select("_fp")))
    n = repeated.count()
    suspects = join_small(packed, repeated.select(F.col("fp").alias("_fp")), "_fp", "left_semi", n)
    return repeated, suspects.groupBy("_fp", "_text").agg(*kept), n


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id
    stays. A null id is below every other; where all ids of a group are null, keep_id is null
    and its rows are kept. Rows that repeat both id and text are all counted and all marked
    alike (deduplicate() leaves one). An empty table gives an empty result; other columns, of
    whatever name, are not read.
    """
    packed = pick(docs, _id=id_col, _text=text_col).select("_id", text_of("_text").alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    _, groups, _ = _verified(packed, (F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    groups = groups.select("_fp", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    every = packed.select(F.col("_id").alias("doc_id"), "_fp", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    joined = every.join(groups, ["_fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each distinct text: that of the largest id.

    Rows that also share the id are told apart by nothing: exactly one of them stays.
    """
    packed = pack(docs, _id=id_col, _text=text_col).select("_row", "_id", text_of("_text").alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    best = F.max_by("_row", F.struct(F.col("_id").isNotNull().alias("a"), F.col("_id").alias("b"))).alias("_row")
    repeated, groups, n = _verified(packed, (best,))
    single = join_small(packed, repeated.select(F.col("fp").alias("_fp")), "_fp", "left_anti", n)
    return unpack(single.select("_row").unionByName(groups.select("_row")), docs)
