"""Putting models and packages together (JOIN-11, JOIN-22 to JOIN-24, MED-07, MED-14, PRJ-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.operators.references import first_by


def render_keys(sprites: DataFrame, entries: DataFrame, key: list[str], own: str, value: str, seq: str) -> DataFrame:
    """JOIN-11: the atlas entry of a sprite's key (the first of equal keys), else the sprite's own data."""
    found = first_by(entries, key, F.col(value), F.col(seq), "_entry")
    return sprites.join(found, key, "left").withColumn("data", F.coalesce("_entry", own)).withColumn("from_atlas", F.col("_entry").isNotNull()).drop("_entry")


def reference_list(lists: DataFrame, owner: str, items: str, targets: DataFrame, key: str, fits: Column) -> tuple[DataFrame, DataFrame]:
    """JOIN-22: each owner's ordered references to their targets, of duplicates the first; and, apart, a
    diagnostic for each reference to nothing or to a target of another role."""
    rows = lists.select(owner, F.posexplode(items).alias("pos", key)).groupBy(owner, key).agg(F.min("pos").alias("pos"))
    joined = rows.join(targets.withColumn("_there", F.lit(True)), key, "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    wrong = joined.filter("not _fits").select(owner, "pos", key, F.when(F.col("_there"), "wrong role").otherwise("not there").alias("diagnostic"))
    return joined.filter("_fits").drop("_there", "_fits"), wrong


def blend_targets(weights: DataFrame, channels: DataFrame) -> DataFrame:
    """JOIN-23: the channel of a node by its name, else by its name's hash."""
    named = channels.select("node", F.col("name").alias("_name"), F.col("channel").alias("_by_name"))
    hashed = channels.groupBy("node", F.crc32(F.col("name").cast("binary")).alias("_hash")).agg(F.min("channel").alias("_by_hash"))
    joined = weights.join(named, (weights["node"] == named["node"]) & (weights["target"] == named["_name"]), "left").drop(named["node"], "_name")
    joined = joined.join(hashed, (joined["node"] == hashed["node"]) & (joined["target_hash"] == hashed["_hash"]), "left").drop(hashed["node"], "_hash")
    return joined.withColumn("channel", F.coalesce("_by_name", "_by_hash")).drop("_by_name", "_by_hash")


def registered(uses: DataFrame, assets: DataFrame, key: str, seq: str) -> DataFrame:
    """JOIN-24: each asset that is used and there, once, numbered by its first use."""
    first = uses.groupBy(key).agg(F.min(seq).alias("first_use"))
    return first.join(assets, key, "left_semi")


def levels(textures: DataFrame, width: str, height: str, count: str, pixel: int) -> DataFrame:
    """MED-07: a row for each mip level with its size, and where it starts."""
    half = lambda c, level: F.greatest(F.lit(1).cast("long"), F.expr(f"shiftright({c}, {level})").cast("long"))
    rows = textures.withColumn("level", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    rows = rows.withColumn("bytes", half(width, "level") * half(height, "level") * pixel)
    before = F.aggregate(F.sequence(F.lit(0), F.col("level")), F.lit(0).cast("long"), lambda total, k: total + F.when(k < F.col("level"), F.greatest(F.lit(1).cast("long"), F.floor(F.col(width) / F.pow(F.lit(2.0), k)).cast("long")) * F.greatest(F.lit(1).cast("long"), F.floor(F.col(height) / F.pow(F.lit(2.0), k)).cast("long")) * pixel).otherwise(0))
    return rows.withColumn("start", before)


def layers(arrays: DataFrame, depth: str, size: str) -> DataFrame:
    """MED-14: a row for each layer of a texture array, and where it starts."""
    return arrays.withColumn("layer", F.explode(F.sequence(F.lit(0), F.col(depth).cast("int") - 1))).withColumn("start", F.col("layer") * F.col(size))


def settings(values: DataFrame) -> DataFrame:
    """PRJ-14: company and product of player settings, scenes of build settings."""
    parsed = values.filter("value is not null and class_id in (129, 141)").select("file", "path_id", "class_id", F.from_json("value", "companyName string, productName string, scenes array<string>, levels array<string>").alias("v"))
    return parsed.select("file", "path_id", F.col("v.companyName").alias("company"), F.col("v.productName").alias("product"), F.coalesce("v.scenes", "v.levels").alias("scenes"))

