"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet the token constraint of each source, entropy balancing takes
those nearest to equal rates in relative entropy (weighted by tokens). They are exponential
tilts of the constraints' features; the tilts solve a convex dual, here by Newton iterations
whose sums run distributed over the documents. The rates are then rounded into whole copies: of the
documents of a source and a class of sizes, those whose hash lies under a cut are rounded up. The cuts
come from histograms, so whole rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.llm.common import NOT_SPACE, blocks, join_small, materialize, pack, pick, unpack  # noqa: F401  unpack is for callers

NEWTON_STEPS, TOLERANCE = 60, 1e-12
#: Bits of the hash that cuts are told in, and bits that one histogram tells apart.
BITS, LEVEL = 32, 8


def ranked(df: DataFrame, column: str) -> DataFrame:
    """df with _rank (0, 1, ...) in the order of a column of distinct values, nulls last.

    Ranges are sorted apart from each other and shifted by the sizes of those before.
    """
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    order = F.col(column).asc_nulls_last()
    within = materialize(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part, shift = F.shiftright("_at", 33), F.lit(0).cast("long")
    total = 0
    for p, n in sorted((r["p"], r["count"]) for r in within.groupBy(part.alias("p")).count().collect()):
        shift = F.when(part == p, F.lit(total).cast("long")).otherwise(shift)
        total += n
    return within.withColumn("_rank", shift + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def capped_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with target: shares of `share` times all sizes, by weights that
    repeat over the ranked sources; none is above `most` times its size, and what it can't take is
    dealt again by weight until none is above."""
    table = ranked(sources, "source")
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("_rank") % len(weights) == i, F.lit(float(w))).otherwise(weight)
    table = materialize(table.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # a round ends with more sources at their cap than before, or it is the last
        above = F.col("_weight") * F.lit(level) >= F.col("_cap")
        got = table.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0.0)).alias("spent"), F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("open"), F.count(F.when(above, 1)).alias("full")).first()
        if not got["open"] or got["full"] == full:
            break
        full, level = got["full"], (share * total - got["spent"]) / got["open"]
    return table.withColumn("target", F.least(F.col("_weight") * F.lit(level) if got["open"] else F.col("_cap"), F.col("_cap"))).drop("_rank", "_weight", "_cap")


def balance(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, rate): rate = exp(tilt) of a document of the source.

    The dual of source s is sum(size * exp(tilt)) - tilt * target, over its documents; a Newton
    step adds (target - moment) / moment. One step is one distributed aggregate over the documents,
    with partial sums before the shuffle; the Hessian is diagonal, as sources don't overlap.
    A target of 0 has rate 0. If the steps don't settle, that is an error.
    """
    # documents of a size alike contribute alike: the sums run over (source, size) with counts
    weighted = materialize(sized.groupBy("source", "size").count())
    state = materialize(targets.withColumn("tilt", F.lit(0.0)))
    n = state.count()
    for _ in range(NEWTON_STEPS):
        right = state.select(F.col("source").alias("_s"), "tilt")
        joined = join_small(weighted, right, F.col("source").eqNullSafe(F.col("_s")), "inner", n)
        # whole numbers are summed, so that a rerun gives the same bits
        moments = joined.groupBy("source", "tilt").agg(F.sum(F.col("size") * F.col("count")).alias("moment"))
        moments = moments.select(F.col("source").alias("_s"), (F.col("moment") * F.exp("tilt")).alias("moment"))
        step_ = F.when((F.col("target") > 0) & (F.col("moment") > 0), (F.col("target") - F.col("moment")) / F.col("moment")).otherwise(0.0)
        # far above the optimum a full step is about -1; far below it would leap, so it is bounded
        state = materialize(state.join(moments, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("tilt", F.col("tilt") + F.least(step_, F.lit(2.0))).withColumn("gap", F.abs(step_)).drop("_s", "moment"))
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("gap")
    else:
        raise RuntimeError(f"the tilts don't settle in {NEWTON_STEPS} Newton steps")
    return state.select("source", "source_size", "target", F.when(F.col("target") > 0, F.exp("tilt")).otherwise(0.0).alias("rate"))


def words(text: Column) -> Column:
    """The number of words between white space; 0 for null."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *[np.diff(block.bounds) for _, _, block in blocks(texts, NOT_SPACE)]]).astype(np.int64))

    return run(text)


def _sized(df: DataFrame) -> DataFrame:
    """df (id, text, source and others) with size, class (of sizes, by powers of 2; null without words) and spot: BITS of a hash of id and text."""
    spot = F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("string"), F.col("_text"), F.lit(11)), 64 - BITS)
    df = df.select("*", words(F.col("_text")).alias("size"), spot.alias("spot"))
    return df.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))).cast("int")))


def _keyed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _same_class() -> Column:
    return F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))


def cuts(slim: DataFrame, rates: DataFrame, many: int) -> DataFrame:
    """(_s, _c, cut): the documents of a source and class whose spot is below the cut are rounded up.

    A class's words under its cut come as near to its share as one document allows; of the two nearest
    cuts the largest class takes the nearer, and each smaller one what makes up for those before.
    """
    whole = F.floor(F.col("rate") + 1e-9)
    part = rates.select(F.col("source").alias("_s"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("part"))
    slim = slim.filter("class is not null")
    sums = slim.groupBy("source", "class").agg(F.sum("size").alias("words"))
    state = join_small(sums, part, F.col("source").eqNullSafe(F.col("_s")), "inner", many)
    state = materialize(state.select("_s", F.col("class").alias("_c"), (F.col("words") * F.col("part")).alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")))
    classes = state.count()
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        # the words of each cell of what the cut is known to lie in, and the cell in which the share is reached
        within = join_small(slim, state, _same_class(), "inner", classes).filter(F.shiftrightunsigned("spot", shift + LEVEL) == F.col("prefix"))
        cells = within.groupBy("_s", "_c", "need", "below", F.shiftrightunsigned("spot", shift).alias("prefix")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("_s", "_c").orderBy("prefix")
        cells = cells.withColumn("upto", F.sum("words").over(order)).withColumn("place", F.row_number().over(order.orderBy(F.desc("prefix"))))
        reached = cells.filter((F.col("below") + F.col("upto") >= F.col("need")) | (F.col("place") == 1))
        state = reached.groupBy("_s", "_c", "need").agg(F.min_by(F.struct("prefix", (F.col("below") + F.col("upto") - F.col("words")).alias("below"), "words"), "prefix").alias("c"))
        state = materialize(state.select("_s", "_c", "need", "c.prefix", "c.below", F.col("c.words").alias("last")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, owed, out = pdf.sort_values("_c", ascending=False), 0.0, []
        for need, prefix, below, last in zip(pdf["need"], pdf["prefix"], pdf["below"], pdf["last"]):
            short, over = owed + need - below, owed + need - below - last
            up = abs(over) <= abs(short) and need > 0
            owed = over if up else short
            out.append(prefix + up)
        return pdf.assign(cut=out)[["_s", "_c", "cut"]]

    schema = state.select("_s", "_c", F.lit(0).cast("long").alias("cut")).schema
    return materialize(state.groupBy("_s").applyInPandas(choose, schema))


def _mixed(sized: DataFrame, slim: DataFrame, weights, share: float, most: float) -> DataFrame:
    """sized with source_size, target, rate and copies; slim has its source, size, class and spot."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(capped_targets(sources, weights, share, most))
    rates = materialize(balance(slim, targets))
    many = rates.count()
    cut = cuts(slim, rates, many)
    rounded = join_small(sized, cut, _same_class(), "left", cut.count()).drop("_s", "_c")
    right = _keyed(rates, {"source": "_s"})
    joined = join_small(rounded, right, F.col("source").eqNullSafe(F.col("_s")), "inner", many).drop("_s")
    up = F.coalesce((F.col("spot") < F.col("cut")).cast("long"), F.lit(0))
    return joined.withColumn("copies", F.floor(F.col("rate") + 1e-9) + up).drop("cut", "class", "spot")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs as (_row, size, source, source_size, target, rate, copies); _row holds its columns by place (see unpack).

    size: words between white space; null text has none. Null is a source of its own. A source
    without words has target 0 and rate 0; a document without words takes the copies of its
    rate rounded down. Rows that repeat id and text are rounded alike. An empty table gives an empty
    result.
    """
    sized = _sized(pack(docs, _id=id_col, _text=text_col, source=source_col)).drop("_id", "_text")
    slim = materialize(_sized(pick(docs, _id=id_col, _text=text_col, source=source_col)).select("source", "size", "class", "spot"))
    return _mixed(sized, slim, weights, share, most)


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for each row of docs (see mix)."""
    sized = _sized(pick(docs, _id=id_col, _text=text_col, source=source_col))
    slim = materialize(sized.select(F.col("_id").alias("doc_id"), "source", "size", "class", "spot"))
    mixed = _mixed(slim, slim, weights, share, most)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"), "rate")
