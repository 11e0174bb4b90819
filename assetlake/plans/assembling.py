"""Assembly of models and packages on the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators import assembly, motion
from assetlake.plans.registry import query, table


@query("""
SELECT p.p_partkey, coalesce(e.entry, p.p_partkey) AS data, e.entry IS NOT NULL AS from_atlas FROM part p
LEFT JOIN (SELECT p_brand, p_size, min(p_partkey) AS entry FROM part WHERE p_retailprice < 1000 GROUP BY 1, 2) e USING (p_brand, p_size)""")
def render_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11: sprites by a composite key, with their own data where it is missing."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return assembly.render_keys(parts, parts.filter("p_retailprice < 1000"), ["p_brand", "p_size"], "p_partkey", "p_partkey", "p_partkey").select("p_partkey", "data", "from_atlas")


def _lists(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("c_custkey") * 9 + i * i % 3 * 7).alias("items"))
    targets = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("role"))
    return assembly.reference_list(lists, "owner", "items", targets, "key", F.col("role") == "F")


_LISTS = """
WITH r AS (SELECT c_custkey AS owner, c_custkey * 9 + i * i % 3 * 7 AS key, CAST(min(i) AS INTEGER) AS pos FROM customer, range(5) v(i) GROUP BY 1, 2)
"""


@query(_LISTS + "SELECT r.owner, r.pos, r.key FROM r JOIN orders o ON o.o_orderkey = r.key WHERE o.o_orderstatus = 'F'")
def reference_lists(spark, sf_dir):
    """JOIN-22: ordered references, of duplicates the first."""
    return _lists(spark, sf_dir)[0].select("owner", "pos", "key")


@query(_LISTS + "SELECT r.owner, r.pos, r.key, CASE WHEN o.o_orderkey IS NULL THEN 'not there' ELSE 'wrong role' END AS diagnostic FROM r LEFT JOIN orders o ON o.o_orderkey = r.key WHERE o.o_orderstatus IS DISTINCT FROM 'F'")
def reference_diagnostics(spark, sf_dir):
    """JOIN-22, L2D-11: references that are skipped, and why."""
    return _lists(spark, sf_dir)[1]


@query("""
WITH c AS (SELECT p_brand AS node, p_name AS name, min(p_partkey) AS channel FROM part GROUP BY 1, 2)
SELECT p.p_partkey, c.channel FROM part p LEFT JOIN c ON c.node = p.p_brand AND c.name = p.p_name""")
def blend_shape_targets(spark, sf_dir):
    """JOIN-23: channels by name, for every other row by the name's hash alone."""
    parts = table(spark, sf_dir, "part")
    channels = parts.groupBy(F.col("p_brand").alias("node"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("channel"))
    weights = parts.select("p_partkey", F.col("p_brand").alias("node"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("target"), F.crc32(F.col("p_name").cast("binary")).alias("target_hash"))
    return assembly.blend_targets(weights, channels).select("p_partkey", "channel")


@query("SELECT l_partkey AS key, min(l_orderkey) AS first_use FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1")
def asset_registration(spark, sf_dir):
    """JOIN-24: what is used and there, once, by its first use."""
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("seq"))
    assets = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("key"))
    return assembly.registered(uses, assets, "key", "seq")


@query("""
WITH t AS (SELECT p_partkey, CAST(p_size * 4 AS BIGINT) AS w, CAST(p_size + 3 AS BIGINT) AS h, 1 + p_partkey % 6 AS n FROM part),
l AS (SELECT p_partkey, CAST(k AS INTEGER) AS level, greatest(1, w >> CAST(k AS INTEGER)) * greatest(1, h >> CAST(k AS INTEGER)) * 4 AS bytes FROM t, range(6) v(k) WHERE k < n)
SELECT p_partkey, level, bytes, CAST(coalesce(sum(bytes) OVER (PARTITION BY p_partkey ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l""")
def mip_levels(spark, sf_dir):
    """MED-07: levels of textures and where they start."""
    textures = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 4).cast("long").alias("w"), (F.col("p_size") + 3).cast("long").alias("h"), (1 + F.col("p_partkey") % 6).alias("n"))
    return assembly.levels(textures, "w", "h", "n", 4).select("p_partkey", "level", "bytes", "start")


@query("SELECT s_suppkey, CAST(k AS INTEGER) AS layer, k * 100 AS start FROM supplier, range(4) v(k) WHERE k <= s_suppkey % 4")
def array_layers(spark, sf_dir):
    """MED-14: layers of texture arrays."""
    arrays = table(spark, sf_dir, "supplier").select("s_suppkey", (1 + F.col("s_suppkey") % 4).alias("depth"), F.lit(100).cast("long").alias("size"))
    return assembly.layers(arrays, "depth", "size").select("s_suppkey", "layer", "start")


@query("SELECT user_id, count(*) AS parts, min(event_id) AS first_part, max(event_id) AS last_part FROM events WHERE event_type = 'click' GROUP BY 1")
def pose_groups(spark, sf_dir):
    """AGG-07, L2D-05: ordered parts of groups."""
    events = table(spark, sf_dir, "events").filter("event_type = 'click'")
    groups = motion.pose_groups(events, "user_id", "event_id", "event_id")
    return groups.select("user_id", F.size("parts").cast("long").alias("parts"), F.element_at("parts", 1).alias("first_part"), F.element_at("parts", -1).alias("last_part"))


@query("SELECT o_custkey AS moc, min(o_orderkey) AS first_seen, max_by(o_totalprice, o_orderkey) AS model FROM orders GROUP BY 1")
def package_per_moc(spark, sf_dir):
    """JOIN-21: one package each, of the last model."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("moc"), F.col("o_totalprice").alias("model"), F.col("o_orderkey").alias("seq"))
    return motion.packages(orders, "moc", "model", "seq")


@query("""
SELECT p_partkey, CASE WHEN p_name IN ('Opacity', 'EyeBlink') THEN 'Model' WHEN p_size < 10 THEN 'Parameter' WHEN p_size < 20 OR contains(lower(p_name), 'part') THEN 'PartOpacity' ELSE 'Parameter' END AS target FROM part""")
def motion_targets(spark, sf_dir):
    """L2D-09: what a curve drives."""
    parts = table(spark, sf_dir, "part")
    name = F.col("p_name")
    parameters, members = F.when(F.col("p_size") < 10, F.array(name)).otherwise(F.array(F.lit(""))), F.when(F.col("p_size") < 20, F.array(name)).otherwise(F.array(F.lit("")))
    return parts.select("p_partkey", motion.target(name, parameters, members).alias("target"))
