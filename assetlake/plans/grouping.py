"""Groups, running state and naming on the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators import naming, series
from assetlake.plans.registry import query, table
from assetlake.sources.catalog import running_budget


@query("""
SELECT outcome, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
  SELECT lang, n_chars, CASE WHEN n_chars > 5000 THEN 'failed' WHEN lang = 'de' THEN 'unsupported' ELSE 'exported' END AS outcome FROM documents) GROUP BY 1, 2""")
def export_report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04: outcomes of an export; unsupported isn't failed."""
    outcome = F.when(F.col("n_chars") > 5000, "failed").when(F.col("lang") == "de", "unsupported").otherwise("exported")
    return table(spark, sf_dir, "documents").groupBy(outcome.alias("outcome"), "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH t AS (SELECT o_custkey, o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS total FROM orders)
SELECT o_custkey, o_orderkey, CAST(total AS BIGINT) AS total FROM t WHERE total <= 500000""")
def budget_running_cutoff(spark, sf_dir):
    """AGG-05: rows before a budget's running total is above its limit."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    return running_budget(orders, ["o_custkey"], ["o_orderkey"], "size", 500000, "total").select("o_custkey", "o_orderkey", "total")


@query("""
SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || ' @' || p_partkey END AS claimed
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part)""")
def collision_naming(spark, sf_dir):
    """WIN-04: the first claimant keeps a name."""
    return naming.claim(table(spark, sf_dir, "part"), "p_name", "p_partkey", F.concat(F.lit(" @"), F.col("p_partkey"))).select("p_partkey", "claimed")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def ordered_group(spark, sf_dir):
    """AGG-06, AGG-07: ordered lists of groups."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["role"]), ",").alias("roles"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT pos - 1 AS bone, count(*) AS vertices, min(vec_id) AS first_vertex, max(vec_id) AS last_vertex
FROM (SELECT vec_id, unnest(embedding) AS weight, generate_subscripts(embedding, 1) AS pos FROM embeddings) WHERE weight > 0 GROUP BY 1""")
def bone_influence_invert(spark, sf_dir):
    """AGG-08, FLT-07: positive weights of vertices, by bone."""
    weights = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bone", "weight")).filter("weight > 0")
    return weights.groupBy(F.col("bone").cast("long").alias("bone")).agg(F.count(F.lit(1)).alias("vertices"), F.min("vec_id").alias("first_vertex"), F.max("vec_id").alias("last_vertex"))


@query("""
WITH s AS (SELECT p_partkey, p_brand, 1 + p_size % 4 AS width, sum(1 + p_size % 4) OVER (PARTITION BY p_brand ORDER BY p_partkey) - (1 + p_size % 4) AS start FROM part),
i AS (SELECT p_brand, unnest(range(0, total, 7)) AS idx FROM (SELECT p_brand, CAST(sum(1 + p_size % 4) AS BIGINT) AS total FROM part GROUP BY 1))
SELECT i.p_brand, i.idx, s.p_partkey AS binding, i.idx = s.start AS on_start FROM i JOIN s ON i.p_brand = s.p_brand AND i.idx >= s.start AND i.idx < s.start + s.width""")
def binding_span_join(spark, sf_dir):
    """JOIN-16, WIN-05: which span of running widths holds an index."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("binding"), (1 + F.col("p_size") % 4).cast("long").alias("width"))
    indices = parts.groupBy("p_brand").agg(F.sum("width").alias("total")).select("p_brand", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(7).cast("long"))).alias("idx"))
    return series.spans(parts, indices, ["p_brand"], "binding", "width", "idx").select("p_brand", "idx", "binding", "on_start")


@query("""
WITH k AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER w AS n,
  lag(epoch_us(ts) / 1e6) OVER w AS pt, lag(value) OVER w AS pv, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN n - 1 BETWEEN 2 AND total - 2 AND t > pt THEN (value - pv) / (t - pt) ELSE 0.0 END AS in_slope FROM k""")
def in_slope_lag(spark, sf_dir):
    """WIN-02: slopes from the key before, in the inner frames alone."""
    keys = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value")
    return series.in_slopes(keys, ["user_id"], ["ts", "event_id"], "t", "value").select("user_id", "event_id", "in_slope")


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE a > 1 AND b > 1""")
def frame_trim(spark, sf_dir):
    """WIN-03: without the first and the last frame."""
    return series.trimmed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""
WITH RECURSIVE k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nv, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nnv FROM events),
s AS (SELECT user_id, n, event_id, value, nv, nnv FROM k WHERE n = 1
  UNION ALL SELECT k.user_id, k.n, k.event_id, k.value, k.nv, k.nnv FROM s JOIN k ON k.user_id = s.user_id
    AND k.n = s.n + CASE WHEN s.nnv IS NOT NULL AND s.nv < s.value AND s.nnv > s.value THEN 2 ELSE 1 END)
SELECT user_id, event_id, CASE WHEN nnv IS NOT NULL AND nv < value AND nnv > value THEN 'inverse_stepped' WHEN nv > value * 2 THEN 'stepped' WHEN abs(nv - value) < 1 THEN 'linear' ELSE 'bezier' END AS segment
FROM s WHERE nv IS NOT NULL""")
def motion_segments(spark, sf_dir):
    """WIN-01: segments of a motion, where one kind takes two keys."""
    return series.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "value")


@query("""
SELECT vec_id, (pos - 1) // 8 AS frame, (pos - 1) % 8 AS curve, CAST(0.5 AS DOUBLE) + ((pos - 1) // 8) / 30.0::DOUBLE AS time, CAST(value AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
def dense_resample(spark, sf_dir):
    """ANI-02: a frame-major matrix of samples as keys of curves."""
    return series.dense(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", curves=8, begin=0.5, rate=30.0)


@query("SELECT u.user_id, v.t AS time, u.value FROM (SELECT user_id, max(value) AS value FROM events GROUP BY 1) u, (VALUES (CAST(0.0 AS DOUBLE)), (CAST(2.5 AS DOUBLE))) v(t)")
def constant_tracks(spark, sf_dir):
    """ANI-03: a constant at the start and at the stop."""
    return series.constant(table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("value")), 2.5).select("user_id", "time", "value")


@query("""
SELECT l_orderkey, i, CASE WHEN i % 2 = 0 THEN a ELSE b END AS v0, CASE WHEN i % 2 = 0 THEN b ELSE a END AS v1, c AS v2 FROM (
  SELECT l_orderkey, row_number() OVER w - 1 AS i, l_partkey AS a, lead(l_partkey) OVER w AS b, lead(l_partkey, 2) OVER w AS c FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) WHERE c IS NOT NULL AND a <> b AND b <> c AND a <> c""")
def strip_triangles(spark, sf_dir):
    """WIN-06, FLT-08: windows of a strip, turned every other time, without degenerate ones."""
    return series.strip(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "l_partkey").select("l_orderkey", "i", "v0", "v1", "v2")


@query("""
SELECT vec_id, CAST(filter - 1 AS BIGINT) AS filter FROM (SELECT vec_id, list_position(s, list_min(s)) AS filter FROM (
  SELECT vec_id, [list_sum(list_transform(embedding[k * 12 + 1 : k * 12 + 12], lambda x: abs(round(x * 100)))) for k in range(5)] AS s FROM embeddings))""")
def min_sum_choice(spark, sf_dir):
    """WIN-07: the candidate of the least sum, the first of equal ones."""
    sums = F.array(*[F.aggregate(F.slice("embedding", k * 12 + 1, 12), F.lit(0.0), lambda t, x: t + F.abs(F.round(x * F.lit(100)).cast("double"))) for k in range(5)])
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(sums, F.array_min(sums)) - 1).alias("filter"))


@query("SELECT o_custkey, o_orderkey, CAST(coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT o_custkey, o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS n FROM orders)")
def running_offsets(spark, sf_dir):
    """WIN-05: where each block starts."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.length("o_orderpriority").cast("long").alias("n"))
    return series.offsets(orders, ["o_custkey"], ["o_orderkey"], "n", "start").select("o_custkey", "o_orderkey", "start")


@query("SELECT user_id, count(*) AS curves, CAST(sum(length(event_type)) AS BIGINT) AS points, max(value) AS top FROM events GROUP BY 1")
def motion_meta(spark, sf_dir):
    """AGG-09, AGG-10: totals of a motion document."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("curves"), F.sum(F.length("event_type").cast("long")).alias("points"), F.max("value").alias("top"))


@query("SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS string_bytes, count(*) AS entries FROM documents GROUP BY 1")
def string_accounting(spark, sf_dir):
    """AGG-13: bytes and entries of strings."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("string_bytes"), F.count(F.lit(1)).alias("entries"))


@query("""
WITH e AS (SELECT user_id, event_type AS clip, 0 AS priority, event_id AS seq FROM events WHERE value > 60 UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE value <= 60)
SELECT user_id, clip, min(priority) AS priority, min_by(seq, priority * 100000000 + seq) AS seq FROM e GROUP BY 1, 2""")
def clip_selection(spark, sf_dir):
    """ANI-06: clips by priority, the first occurrence wins."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("clip"), F.when(F.col("value") > 60, 0).otherwise(1).alias("priority"), F.col("event_id").alias("seq")).filter("priority is not null")
    return events.groupBy("user_id", "clip").agg(F.min("priority").alias("priority"), F.min_by("seq", F.struct("priority", "seq")).alias("seq"))


@query("SELECT url, page_id, CAST(row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/]*)', 1)) ORDER BY page_id) AS INTEGER) AS ordinal FROM pages")
def claim_ordinals(spark, sf_dir):
    """STR-06, WIN-04: the ordinal of each claimant of a case-folded key."""
    return naming.ordinals(table(spark, sf_dir, "pages"), F.regexp_extract("url", "://([^/]*)", 1), "page_id").select("url", "page_id", "ordinal")


