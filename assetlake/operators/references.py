"""References between objects, as joins (JOIN-01 to JOIN-24)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_null_reference(file_id: Column, path_id: Column) -> Column:
    """FLT-03: no object is meant."""
    return (path_id == 0) | (file_id < 0)


def resolve(references: DataFrame, targets: DataFrame, on: list[str], wanted: Column | None = None, null: Column | None = None, how: str = "left") -> DataFrame:
    """JOIN-01, JOIN-02: look references up by key. Null references, those that null tells and those with a null
    key, find nothing; a target of another kind (wanted, over the targets' columns) is like none, since the
    condition stands in the join. Null references stay out of the join, where all of them would be dealt to one
    task; a left join gets them back as they are."""
    right = targets.filter(wanted) if wanted is not None else targets
    if how not in ("left", "inner"):
        if null is None:
            return references.join(right, on, how)
        keyed = references.select("*", *[F.when(null, F.lit(None)).otherwise(F.col(k)).alias(f"_ref_{k}") for k in on])
        joined = keyed.join(right, [keyed[f"_ref_{k}"] == right[k] for k in on], how)
        return joined.drop(*[right[k] for k in on]).drop(*[f"_ref_{k}" for k in on])
    missing = reduce(or_, [F.col(k).isNull() for k in on], F.coalesce(null, F.lit(False)) if null is not None else F.lit(False))
    left = references.filter(~missing)
    if null is None:
        joined, places = left.join(right, on, how), [*on, *[c for c in references.columns if c not in on]]
    else:
        joined, places = left.join(right, [left[k] == right[k] for k in on], how).drop(*[right[k] for k in on]), references.columns
    if how == "inner":
        return joined
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in on]
    return joined.union(references.filter(missing).select(*places, *blank))


def first_by(df: DataFrame, keys: list[str], value: Column, seq: Column, name: str) -> DataFrame:
    """WIN-09: the value of the earliest row of each key."""
    return df.groupBy(*keys).agg(F.min_by(value, seq).alias(name))


def first_seen(df: DataFrame, keys: list[str], seq: Column, name: str, count: str) -> DataFrame:
    """AGG-14, SET-02: the first position of each distinct key, and how often it is there."""
    return df.groupBy(*keys).agg(F.min(seq).alias(name), F.count(F.lit(1)).alias(count))


def inherit(rows: DataFrame, others: DataFrame, on: str, own: str, other: str, allowed: Column | None = None) -> DataFrame:
    """JOIN-05, JOIN-06: a row's own name, else, where it is allowed, that of what it refers to."""
    joined = rows.join(others, on, "left")
    found = F.col(other) if allowed is None else F.when(allowed, F.col(other))
    return joined.withColumn(own, F.coalesce(own, found)).drop(other)


def expand(controllers: DataFrame, clips: DataFrame, source: str) -> DataFrame:
    """JOIN-17: the clips of the controller that each controller takes them from: itself, or the one it overrides."""
    return controllers.join(clips, source)


def last_by(df: DataFrame, keys: list[str], value: Column, seq: Column, name: str) -> DataFrame:
    """WIN-09: the value of the latest row of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(name))


def either_key(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], seq: str) -> DataFrame:
    """JOIN-03: match by one key or by another, the earliest match wins: two equi joins, never an OR."""
    a = right.groupBy(F.col(first[1]).alias("_k1")).agg(F.min(seq).alias("_s1"))
    b = right.groupBy(F.col(second[1]).alias("_k2")).agg(F.min(seq).alias("_s2"))
    joined = left.join(a, left[first[0]] == a["_k1"], "left").join(b, left[second[0]] == b["_k2"], "left")
    return joined.withColumn("match", F.least("_s1", "_s2")).drop("_k1", "_k2", "_s1", "_s2")


def assign_slices(slices: DataFrame, items: DataFrame, owner: str, position: str) -> DataFrame:
    """JOIN-04, JOIN-16: give each item the latest slice [first, first + length) that holds its position.

    slices: owner, key, seq, first, length; positions from 0 on, each once for an owner. A slice is cut
    into blocks of a power of two of positions, two of a size at most, and an item lies in one block of
    each size: the join is an equi join, and rows grow with the logarithm of the lengths.
    """
    cut = slices.filter("length > 0").select(owner, "key", "seq", F.col("first").alias("_lo"), (F.col("first") + F.col("length")).alias("_hi"))
    longest = cut.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    sizes = F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length()))).alias("_size")
    one = F.lit(1).cast("long")
    cut = cut.select("*", sizes).withColumn("_power", F.call_function("shiftleft", one, F.col("_size")))
    cut = cut.withColumn("_lo", F.ceil(F.col("_lo") / F.col("_power"))).withColumn("_hi", F.floor(F.col("_hi") / F.col("_power"))).filter("_lo < _hi")
    blocks = F.array(F.when(F.col("_lo") % 2 == 1, F.col("_lo")), F.when(F.col("_hi") % 2 == 1, F.col("_hi") - 1))
    cut = cut.select(owner, "key", "seq", "_size", F.explode(blocks).alias("_block")).filter("_block is not null")
    best = cut.groupBy(owner, "_size", "_block").agg(F.max(F.struct("seq", "key")).alias("_best"))
    asked = items.select(owner, position, sizes).withColumn("_block", F.floor(F.col(position) / F.call_function("shiftleft", one, F.col("_size"))))
    chosen = asked.join(best, [owner, "_size", "_block"]).groupBy(owner, position).agg(F.max("_best")["key"].alias("container"))
    return items.join(chosen, [owner, position], "left")


def exact_or_fallback(rows: DataFrame, schemas: DataFrame, exact: list[str], fallback: list[str], value: str, seq: str) -> DataFrame:
    """JOIN-18: the first schema that fits all keys, else the first that fits fewer."""
    a = first_by(schemas, exact, F.col(value), F.col(seq), "_exact")
    b = first_by(schemas, fallback, F.col(value), F.col(seq), "_fallback")
    return rows.join(a, exact, "left").join(b, fallback, "left").withColumn("found", F.coalesce("_exact", "_fallback")).drop("_exact", "_fallback")


def suffix_match(paths: DataFrame, nodes: DataFrame, path: str, node_path: str, order: str) -> DataFrame:
    """JOIN-14: nodes whose last component equals the path's and whose path ends with it; the least order wins."""
    tail = lambda c: F.substring_index(F.col(c), "/", -1)
    left, right = paths.withColumn("_tail", tail(path)), nodes.select(tail(node_path).alias("_tail"), F.col(node_path).alias("_node"), F.col(order).alias("_order"))
    return left.join(right, "_tail").filter(F.col("_node").endswith(F.col(path))).groupBy(path).agg(F.min("_order").alias("match"))


def hash_match(rows: DataFrame, nodes: DataFrame, hash_col: str, node_path: str, seq: str) -> DataFrame:
    """JOIN-13, JOIN-15: by the CRC of every `/`-suffix of the nodes' paths; of equal hashes the last generated wins."""
    parts = F.split(node_path, "/")
    suffixes = nodes.select(F.col(seq).alias("_seq"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_i", "_suffix"))
    table = suffixes.groupBy(F.crc32(F.col("_suffix").cast("binary")).alias(hash_col)).agg(F.max_by("_seq", F.struct("_seq", "_i")).alias("node"))
    return rows.join(table, hash_col, "left")


def atlas_choice(candidates: DataFrame, key: str, item: Column, seq: Column, is_master: Column) -> DataFrame:
    """JOIN-10: the first master in order; without one the last candidate."""
    return candidates.groupBy(key).agg(F.coalesce(F.min_by(F.when(is_master, item), F.when(is_master, seq)), F.max_by(item, seq)).alias("chosen"))


def broken(references: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """JOIN-09: references whose target isn't there."""
    return references.join(targets, on, "left_anti")
