"""Scans, filters, lookups and set operations on the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions import text
from assetlake.operators import references as ref
from assetlake.operators import series
from assetlake.plans.registry import query, table


@query("SELECT count(*) AS object_count, count(DISTINCT l_orderkey) AS file_count, CAST(sum(l_linenumber) AS BIGINT) AS byte_total FROM lineitem")
def info_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: a collection's totals."""
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("object_count"), F.countDistinct("l_orderkey").alias("file_count"), F.sum(F.col("l_linenumber").cast("long")).alias("byte_total"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase')")
def class_filter_project(spark, sf_dir):
    """FLT-01, PRJ-01: objects of some classes; the filter reaches the scan."""
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase")).select("event_id", "event_type", "value")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 1")
def point_lookup(spark, sf_dir):
    """FLT-02: the first object of a key."""
    return table(spark, sf_dir, "orders").filter("o_custkey = 7").orderBy("o_orderkey").limit(1).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_offset_limit(spark, sf_dir):
    """SRT-02: a page of the enumeration."""
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderstatus")


@query("""
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, o.o_custkey AS target
FROM lineitem l LEFT JOIN orders o ON CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE l.l_orderkey END = o.o_orderkey""")
def pptr_resolve_left(spark, sf_dir):
    """JOIN-01, FLT-03: references to their targets; null references find none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("target"))
    references = lines.withColumn("key", F.col("l_orderkey"))
    return ref.resolve(references, orders, ["key"], null=F.col("l_orderkey") % 7 == 0).drop("key")


@query("""
SELECT o.o_orderkey, o.o_custkey, c.c_name AS target_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'""")
def pptr_typed_resolve(spark, sf_dir):
    """JOIN-02: targets of another class count as none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("key"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("target_name"), "c_mktsegment")
    return ref.resolve(orders, customers, ["key"], wanted=F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "o_custkey", "target_name")


@query("""
WITH p AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS full_path, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages),
a AS (SELECT full_path, min(page_id) AS s FROM p GROUP BY 1), b AS (SELECT name, min(page_id) AS s FROM p GROUP BY 1)
SELECT p.page_id, least(a.s, b.s) AS match FROM p LEFT JOIN a USING (full_path) LEFT JOIN b USING (name)""")
def resource_two_key_lookup(spark, sf_dir):
    """JOIN-03: by normalised path or by name, the earliest wins."""
    cut = F.regexp_replace("url", "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", text.ascii_lower(cut).alias("full_path"), text.portable_name(cut).alias("name"))
    return ref.either_key(pages, pages, ("full_path", "full_path"), ("name", "name"), "page_id").select("page_id", "match")


@query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos FROM lineitem),
s AS (SELECT o_orderkey AS owner, o_orderkey * 10 + k AS key, k AS seq, k AS first, 1 + (o_orderkey + k) % 3 AS length FROM orders, (VALUES (0), (1), (2)) v(k)),
m AS (SELECT l.l_orderkey, l.pos, max_by(s.key, s.seq) AS container FROM l JOIN s ON s.owner = l.l_orderkey AND l.pos >= s.first AND l.pos < s.first + s.length GROUP BY 1, 2)
SELECT l.l_orderkey AS owner, l.pos, m.container FROM l LEFT JOIN m ON l.l_orderkey = m.l_orderkey AND l.pos = m.pos""")
def container_slice_assign(spark, sf_dir):
    """JOIN-04: slices of preload lists give containers; a later one overwrites."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    items = lines.select(F.col("l_orderkey").alias("owner"), (F.row_number().over(order) - 1).cast("long").alias("pos"))
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("seq")
    slices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), k)
    slices = slices.select("owner", (F.col("owner") * 10 + F.col("seq")).alias("key"), "seq", F.col("seq").alias("first"), (1 + (F.col("owner") + F.col("seq")) % 3).alias("length"))
    return ref.assign_slices(slices, items, "owner", "pos")


@query("""
SELECT s.s_suppkey, coalesce(CASE WHEN s.s_suppkey % 3 = 0 THEN s.s_name END, CASE WHEN s.s_suppkey % 3 = 1 THEN n.n_name END, r.r_name) AS name
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def name_inheritance(spark, sf_dir):
    """JOIN-05, JOIN-06: an own name, else one inherited from what is referred to."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    third = F.col("s_suppkey") % 3
    own = s.select("s_suppkey", F.col("s_nationkey").alias("to"), F.when(third == 0, F.col("s_name")).alias("own"), third.alias("third"))
    first = ref.inherit(own, n.select(F.col("n_nationkey").alias("to"), F.col("n_name").alias("other"), F.col("n_regionkey").alias("next")), "to", "own", "other", F.col("third") == 1)
    second = ref.inherit(first.drop("to").withColumnRenamed("next", "to"), r.select(F.col("r_regionkey").alias("to"), F.col("r_name").alias("other")), "to", "own", "other")
    return second.select("s_suppkey", F.col("own").alias("name"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_component_wins(spark, sf_dir):
    """JOIN-07, WIN-09: the last component of a kind."""
    return ref.last_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value"), F.col("event_id"), "value")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_wins_dedup(spark, sf_dir):
    """AGG-14, SET-02: the first position of each distinct value."""
    docs = table(spark, sf_dir, "documents")
    return ref.first_seen(docs, ["text"], F.col("doc_id"), "doc_id", "copies").select("doc_id", "copies")


@query("""
SELECT p_brand, coalesce(min_by(p_partkey, p_partkey) FILTER (WHERE p_size > 45), max_by(p_partkey, p_partkey)) AS chosen
FROM part GROUP BY 1""")
def atlas_master_select(spark, sf_dir):
    """JOIN-10: the first master, else the last candidate."""
    return ref.atlas_choice(table(spark, sf_dir, "part"), "p_brand", F.col("p_partkey"), F.col("p_partkey"), F.col("p_size") > 45)


@query("""
WITH c AS (SELECT n_nationkey AS controller, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey * 5 END AS base FROM nation),
b AS (SELECT controller, coalesce(base, controller) AS source FROM c)
SELECT b.controller, s.s_suppkey AS clip FROM b JOIN supplier s ON s.s_nationkey = b.source""")
def override_expand(spark, sf_dir):
    """JOIN-17: an overriding controller exposes its base's clips."""
    controllers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("controller"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_regionkey") * 5).otherwise(F.col("n_nationkey")).alias("source"))
    clips = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("clip"))
    return ref.expand(controllers, clips, "source").select("controller", "clip")


@query("""
WITH s AS (SELECT p_type, p_size, p_brand AS layout, p_partkey AS seq FROM part WHERE p_size < 25),
e AS (SELECT p_type, p_size, min_by(layout, seq) AS l FROM s GROUP BY 1, 2), f AS (SELECT p_type, min_by(layout, seq) AS l FROM s GROUP BY 1)
SELECT p.p_partkey, coalesce(e.l, f.l) AS found FROM part p LEFT JOIN e USING (p_type, p_size) LEFT JOIN f USING (p_type)""")
def schema_exact_or_fallback(spark, sf_dir):
    """JOIN-18: a schema of the exact version, else one without a version; the first document wins."""
    parts = table(spark, sf_dir, "part")
    schemas = parts.filter("p_size < 25").select("p_type", "p_size", F.col("p_brand").alias("layout"), F.col("p_partkey").alias("seq"))
    return ref.exact_or_fallback(parts.select("p_partkey", "p_type", "p_size"), schemas, ["p_type", "p_size"], ["p_type"], "layout", "seq").select("p_partkey", "found")


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages),
q AS (SELECT DISTINCT regexp_extract(path, '([^/]*/[^/]*)$', 1) AS suffix FROM p)
SELECT q.suffix, min(p.page_id) AS match FROM q JOIN p ON regexp_extract(q.suffix, '([^/]*)$', 1) = regexp_extract(p.path, '([^/]*)$', 1) AND suffix(p.path, q.suffix) GROUP BY 1""")
def suffix_join(spark, sf_dir):
    """JOIN-14: nodes whose path ends with a curve's path; the least order wins."""
    nodes = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "").alias("path"))
    curves = nodes.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("suffix")).distinct()
    return ref.suffix_match(curves, nodes, "suffix", "path", "page_id")


@query("SELECT a.p_partkey, b.first_key FROM part a JOIN (SELECT p_name, min(p_partkey) AS first_key FROM part GROUP BY 1) b USING (p_name)")
def crc_hash_join(spark, sf_dir):
    """AGG-15, JOIN-15: a join by the CRC of names."""
    from assetlake.functions.numeric import unity_crc

    parts = table(spark, sf_dir, "part").select("p_partkey", unity_crc(F.col("p_name")).alias("hash"))
    return parts.join(parts.groupBy("hash").agg(F.min("p_partkey").alias("first_key")), "hash").select("p_partkey", "first_key")


@query("""
SELECT r.role, count(*) AS n, count(*) FILTER (WHERE m.conv_id IS NOT NULL) AS with_model
FROM (SELECT conv_id, CASE WHEN role = 'user' THEN 'motion' WHEN role = 'assistant' THEN 'expression' WHEN contains(role, 'sys') THEN 'model' END AS role FROM conversations) r
LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 2) m ON r.conv_id = m.conv_id WHERE r.role IS NOT NULL GROUP BY 1""")
def role_catalog(spark, sf_dir):
    """JOIN-19, PRJ-19: classes become roles, and models must be known."""
    rows = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "motion").when(F.col("role") == "assistant", "expression").when(F.col("role").contains("sys"), "model")
    known = rows.filter("turn = 2").select("conv_id", F.lit(True).alias("known")).distinct()
    joined = rows.select("conv_id", role.alias("role")).filter("role is not null").join(known, "conv_id", "left")
    return joined.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("with_model"))


@query("""
SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'only_left', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    """SET-01 to SET-04."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    left, right = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    both = c.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(right)
    only = left.subtract(s.filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k")))
    either = left.union(right).distinct()
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(both, "both").unionByName(tag(only, "only_left")).unionByName(tag(either, "either"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def missing_parents(spark, sf_dir):
    """JOIN-09, SET-04: references whose target isn't there."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey")
    targets = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return ref.broken(lines, targets, ["key"]).select(F.col("key").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("""
SELECT m.p_partkey, m.prop, t.p_partkey AS texture FROM (
  SELECT p_partkey, prop, p_partkey + CASE WHEN prop = '_MainTex' THEN p_size ELSE -p_size END AS target FROM part, (VALUES ('_MainTex'), ('_BumpMap')) v(prop)) m
JOIN part t ON m.target = t.p_partkey AND t.p_size < 40""")
def material_texture_bind(spark, sf_dir):
    """JOIN-12: texture slots of materials; dangling references and other classes are skipped."""
    parts = table(spark, sf_dir, "part")
    slots = parts.select("p_partkey", F.explode(F.array(F.struct(F.lit("_MainTex").alias("prop"), F.col("p_size").alias("add")), F.struct(F.lit("_BumpMap").alias("prop"), (-F.col("p_size")).alias("add")))).alias("s"))
    slots = slots.select("p_partkey", "s.prop", (F.col("p_partkey") + F.col("s.add")).alias("key"))
    textures = parts.select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("texture"), "p_size")
    return ref.resolve(slots, textures, ["key"], wanted=F.col("p_size") < 40, how="inner").select("p_partkey", "prop", "texture")


@query("SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1")
def definition_counts(spark, sf_dir):
    """AGG-12: objects of each definition."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 4")
def recent_top_k(spark, sf_dir):
    """SRT-05: the most recent entries of each cache."""
    return series.recent(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 4).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY reverse(p_name), p_partkey) AS BIGINT) AS place FROM part")
def reversed_path_sort(spark, sf_dir):
    """SRT-04: every entry's place in an index sorted by reversed paths."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.reverse("p_name").alias("reversed"))
    return series.placed(rows, ["reversed", "p_partkey"], "place").select("p_partkey", "place")
