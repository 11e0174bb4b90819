"""Strings, numbers, JSON, formats and hierarchies on the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions import formats, numeric, text
from assetlake.operators import hierarchy
from assetlake.plans.registry import query, table


@query("""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://(.*)$', 1), '[/\\\\:*?"<>|]', '_', 'g'), '^[ .]+', ''), '[ .]+$', '') AS clean FROM pages)
SELECT page_id, CASE WHEN clean = '' THEN 'unnamed' ELSE clean END AS name FROM c""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: components that any file system takes."""
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize(F.regexp_extract("url", "://(.*)$", 1)).alias("name"))


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS name, lower(replace('archive:/' || url, 'archive:/', '')) AS path FROM pages")
def portable_name(spark, sf_dir):
    """STR-01, STR-03: names and paths without their containers."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.portable_name(F.concat(F.lit("a::b::"), url)).alias("name"), text.resource_path(F.concat(F.lit("archive:/"), url)).alias("path"))


@query("""
WITH v AS (SELECT p_partkey, 2015 + p_size AS major, p_size % 4 AS minor, p_partkey % 50 AS build FROM part)
SELECT p_partkey, CAST(major AS INTEGER) AS major, CAST(minor AS INTEGER) AS minor, CAST(build AS INTEGER) AS build, 'f' AS kind, CAST(1 AS INTEGER) AS revision,
  CASE WHEN major < 2019 THEN 'unsupported' WHEN (major, minor, build) <= (2022, 3, 62) THEN 'verified' ELSE 'attempt' END AS gate FROM v""")
def version_parse(spark, sf_dir):
    """STR-12, FLT-04: versions and how far they are verified."""
    declared = F.concat(2015 + F.col("p_size"), F.lit("."), F.col("p_size") % 4, F.lit("."), F.col("p_partkey") % 50, F.lit("f1"))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.version(declared).alias("v"))
    return parts.select("p_partkey", "v.major", "v.minor", "v.build", "v.kind", "v.revision", text.version_gate(F.col("v"), (2019, 0, 0), (2022, 3, 62)).alias("gate"))


@query("""
WITH q AS (SELECT vec_id, pos - 1 AS pos, CAST(floor((CAST(v AS DOUBLE) + 1.0) / 2.0 * 255 + 0.5) AS INTEGER) AS q FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))
SELECT vec_id, pos, q, CAST(CAST(CAST(q AS FLOAT) / CAST(CAST(CAST(1.0 AS DOUBLE) / CAST(2.0 AS DOUBLE) AS FLOAT) * CAST(255 AS FLOAT) AS FLOAT) AS FLOAT) + CAST(-1.0 AS FLOAT) AS FLOAT) AS value FROM q""")
def packed_dequant(spark, sf_dir):
    """NUM-01, NUM-02: packed floats, in single precision throughout."""
    span, start = F.lit(2.0), F.lit(-1.0)
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    values = values.select("vec_id", F.col("pos").cast("long").alias("pos"), numeric.quantize(F.col("v"), 8, span, start).alias("q"))
    return values.select("vec_id", "pos", "q", numeric.dequantize(F.col("q"), 8, span, start).alias("value"))


@query("""
WITH r AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS w FROM embeddings),
n AS (SELECT vec_id, x / s AS x, y / s AS y, z / s AS z, w / s AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS s FROM r)),
m AS (SELECT vec_id, 2 * (x * z - w * y) AS m20, 2 * (y * z + w * x) AS m21, 1 - 2 * (x * x + y * y) AS m22, 2 * (x * y + w * z) AS m10, 1 - 2 * (y * y + z * z) AS m00 FROM n)
SELECT vec_id, round(degrees(atan2(m21, m22)), 4) AS angle_x, round(degrees(atan2(-m20, sqrt(m00 * m00 + m10 * m10))), 4) AS angle_y, round(degrees(atan2(m10, m00)), 4) AS angle_z FROM m""")
def quaternion_euler(spark, sf_dir):
    """NUM-05, NUM-06: quaternions as angles."""
    q = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 4).alias(n) for n, c in numeric.euler(*q).items()])


@query("""
SELECT event_id, t + ((t + 3.0::DOUBLE) - t) / 3 AS c1_time, value + 0.5::DOUBLE * (((t + 3.0::DOUBLE) - t) / 3) AS c1_value FROM (SELECT event_id, CAST(event_id AS DOUBLE) AS t, value FROM events)""")
def bezier_points(spark, sf_dir):
    """NUM-09: control points at thirds."""
    t = F.col("event_id").cast("double")
    points = numeric.bezier(t, F.col("value"), F.lit(0.5), t + 3.0, F.col("value"), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", *[points[n].alias(n) for n in ("c1_time", "c1_value")])


@query("SELECT o_orderkey, o_orderkey * 3 + (4 - (o_orderkey * 3) % 4) % 4 AS aligned, CAST(round(o_orderkey / 8.0::DOUBLE * 10) AS BIGINT) AS ticks FROM orders")
def aligned_offsets(spark, sf_dir):
    """NUM-13, NUM-14: alignment and ticks."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", numeric.aligned(F.col("o_orderkey") * 3, 4).alias("aligned"), numeric.ticks(F.col("o_orderkey") / F.lit(8.0), 10).alias("ticks"))


@query("""
SELECT s.s_suppkey AS node, r.r_name || '/' || n.n_name || '/' || s.s_name AS path, CAST(2 AS INTEGER) AS depth FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey""")
def hierarchy_paths(spark, sf_dir):
    """HIER-01, HIER-03: paths from the roots."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("node"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"), F.lit(None).cast("long").alias("node"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("node"))
    nodes = r.unionByName(n).unionByName(s)
    return hierarchy.paths(nodes, "key", "parent", "name").join(nodes.select("key", "node"), "key").filter("node is not null").select("node", "path", "depth")


def _tree(spark, sf_dir):
    """Parts as a forest: the parent of i is i div 4, but for the roots 0 and 1 to 3 below 0."""
    parts = table(spark, sf_dir, "part")
    parent = F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4).cast("long"))
    return parts.select(F.col("p_partkey").alias("key"), parent.alias("parent"), "p_size", "p_name")


@query("""
WITH t AS (SELECT p_partkey AS key, CASE WHEN p_partkey > 0 THEN CASE WHEN p_partkey % 97 = 0 THEN p_partkey ELSE p_partkey // 4 END END AS parent FROM part)
SELECT count(*) AS unreached FROM t WHERE key NOT IN (WITH RECURSIVE d AS (SELECT key FROM t WHERE parent IS NULL UNION ALL SELECT t.key FROM t JOIN d ON t.parent = d.key) SELECT key FROM d)""")
def hierarchy_cycle_check(spark, sf_dir):
    """HIER-02: nodes that no root reaches."""
    nodes = _tree(spark, sf_dir).withColumn("parent", F.when((F.col("key") > 0) & (F.col("key") % 97 == 0), F.col("key")).otherwise(F.col("parent")))
    return hierarchy.unreachable(nodes, "key", "parent").agg(F.count(F.lit(1)).alias("unreached"))


@query("SELECT r_regionkey, bool_or(s_acctbal < 0) AS has_geometry FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def subtree_bool_or(spark, sf_dir):
    """AGG-11, FLT-05: whether anything below has a flag."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("flag"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.lit(False).alias("flag"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), (F.col("s_acctbal") < 0).alias("flag"))
    found = hierarchy.subtree_or(r.unionByName(n).unionByName(s), "key", "parent", F.col("flag"), "has_geometry")
    return found.filter("key like 'r%'").select(F.expr("cast(substring(key, 2) as int)").alias("r_regionkey"), "has_geometry")


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS key, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent, p_size > 30 AS mark FROM part),
d AS (SELECT key, CAST(NULL AS BIGINT) AS model, mark FROM t WHERE parent IS NULL
  UNION ALL SELECT t.key, CASE WHEN d.mark THEN d.key ELSE d.model END, t.mark FROM t JOIN d ON t.parent = d.key)
SELECT key, model FROM d""")
def nearest_ancestor(spark, sf_dir):
    """JOIN-20: the nearest marked node strictly above."""
    return hierarchy.nearest_ancestor(_tree(spark, sf_dir), "key", "parent", F.col("p_size") > 30, "model")


@query("""
SELECT key, CAST(distance AS INTEGER) AS distance, role FROM (
WITH RECURSIVE t AS (SELECT p_partkey AS key, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent FROM part),
d AS (SELECT key, 0 AS distance FROM t WHERE key = 17 UNION ALL SELECT t.key, d.distance + 1 FROM t JOIN d ON t.parent = d.key),
u AS (SELECT key, parent, 0 AS distance FROM t WHERE key = 17 UNION ALL SELECT t.key, t.parent, u.distance - 1 FROM t JOIN u ON u.parent = t.key)
SELECT key, distance, 'subtree' AS role FROM d UNION ALL SELECT key, distance, 'ancestor' FROM u WHERE distance < 0)""")
def branch_selection(spark, sf_dir):
    """HIER-04: a node's ancestors and its subtree."""
    return hierarchy.branch(_tree(spark, sf_dir), "key", "parent", 17)


@query("SELECT p_partkey // 4 AS key, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS children FROM part WHERE p_partkey > 0 GROUP BY 1")
def ordered_children(spark, sf_dir):
    """HIER-01: children in their order."""
    return hierarchy.children(_tree(spark, sf_dir), "key", "parent", "key").select("key", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_project(spark, sf_dir):
    """ARR-06, PRJ-04: one field of a document."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query()
def json_write(spark, sf_dir):
    """ARR-04: objects as JSON text, in the pretty and in the compact layout."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("m_Name"), F.col("s_acctbal").cast("float").alias("m_Value"), F.array("s_nationkey").alias("m_Keys")).alias("value"))
    return rows.select("s_suppkey", formats.pretty_json(F.col("value")).alias("pretty"), F.to_json("value").alias("compact"))


@query("""
SELECT page_id, CASE WHEN starts_with(html, 'UnityFS') THEN 'bundle' WHEN html[1:2] = 'PK' THEN 'zip' WHEN starts_with(html, '<!DOCTYPE') THEN 'markup' WHEN starts_with(html, '<html') THEN 'markup' ELSE 'resource' END AS format FROM pages""")
def detect_format(spark, sf_dir):
    """SRC-07: formats by their first bytes, in order of priority."""
    return table(spark, sf_dir, "pages").select("page_id", formats.text_format(F.col("html")).alias("format"))


@query("SELECT doc_id, text, CAST((octet_length(encode(text)) + 63) // 64 AS INTEGER) AS parts FROM documents WHERE text <> ''")
def split_reassembly(spark, sf_dir):
    """SRC-04, SRC-05: split files put together again."""
    data = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.col("text").cast("binary").alias("content"))
    count = F.ceil(F.octet_length("content") / 64).cast("int")
    parts = data.select("doc_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("idx"), "content").select("doc_id", "idx", F.expr("substring(content, idx * 64 + 1, 64)").alias("content"))
    return formats.reassemble(parts, "doc_id", "idx", "content").select("doc_id", F.col("content").cast("string").alias("text"), "parts")


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%.%' THEN p_name ELSE p_name || '.txt' END AS file_name, p_name || '_' || p_partkey AS suffixed FROM part")
def extension_restore(spark, sf_dir):
    """STR-07, STR-11: extensions and suffixes before them."""
    return table(spark, sf_dir, "part").select("p_partkey", text.with_extension(F.col("p_name")).alias("file_name"), text.before_extension(F.col("p_name"), F.concat(F.lit("_"), F.col("p_partkey"))).alias("suffixed"))


@query("SELECT vec_id, count(*) AS n, CAST(sum(CASE WHEN isfinite(v) THEN 1 ELSE 0 END) AS BIGINT) AS finite FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def finite_check(spark, sf_dir):
    """NUM-17: finite values."""
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    return values.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(numeric.finite(F.col("v")).cast("long")).alias("finite"))


@query("SELECT vec_id, list_sum(list_transform(embedding[9:16], lambda x: CAST(x AS DOUBLE))) AS total, CAST(len(embedding[61:70]) AS INTEGER) AS tail FROM embeddings")
def array_slices(spark, sf_dir):
    """ARR-07: slices, with bounds that the array may not reach."""
    total = F.aggregate(F.slice("embedding", 9, 8), F.lit(0.0), lambda t, x: t + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", total.alias("total"), F.size(F.slice("embedding", 61, 10)).alias("tail"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'albedo') OR contains(lower(p_name), 'a') THEN 'diffuse' WHEN contains(lower(p_name), 'e') THEN 'emission' ELSE 'other' END AS slot FROM part")
def slot_classification(spark, sf_dir):
    """PRJ-19: names to slots, in order."""
    name = text.ascii_lower(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(name.contains("albedo") | name.contains("a"), "diffuse").when(name.contains("e"), "emission").otherwise("other").alias("slot"))
