"""Quality by importance resampling.

Two generative models over hashed n-grams, of good texts and of all texts, give every document a
log importance weight. Adding Gumbel noise to it and taking the k largest sums samples k documents
without replacement, in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.llm.common import ALNUM, LOWER, NOT_SPACE, Block, blocks, bounded_sample, grams, materialize, pick, remainder, unit

#: Buckets of hashed words and word pairs.
BUCKETS = 1 << 14
#: Good texts that the target model reads at most; the model of all texts reads every one.
SAMPLE = 50_000
SMOOTHING = 1.0
#: Words, and runs of other characters between white space.
CLASSES = (NOT_SPACE.astype(np.uint8) + (NOT_SPACE & ~ALNUM[LOWER]))


def ngrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each pair of neighbours."""
    h, owner = block.hashes(), block.owners()
    pairs, whole = grams(h, block.bounds, 2)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    return np.r_[owner, owner[whole]], np.r_[h >> shift, pairs[whole] >> shift].astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's bucket counts over all texts and over the target's."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = np.array(batch.column(1).to_pylist(), bool)
        for at, to, block in blocks(batch.column(0), CLASSES):
            owner, bucket = ngrams(block)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[target[at:to][owner]], minlength=BUCKETS)
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket's probability in good texts to that in all texts, and the share
    of labelled texts that are good. Good: label 1 and crc32 of the id, modulo 5, not 0; of several
    labels of an id the largest counts."""
    usable = pick(labels, _id=id_col, quality="quality").filter(F.col("quality").isin(0, 1) & F.col("_id").isNotNull() & (remainder(F.col("_id"), 5) != 0))
    usable = usable.groupBy("_id").agg(F.max("quality").alias("quality"))
    good = bounded_sample(usable.filter("quality = 1"), "quality", "_id", bound).select("_id", F.lit(True).alias("_good"))
    share = usable.agg(F.avg("quality")).first()[0]
    slim = pick(docs, _id=id_col, _text=text_col).join(F.broadcast(good), "_id", "left")
    counts = slim.select("_text", F.coalesce("_good", F.lit(False)).alias("_good")).mapInArrow(_count, "bucket long, raw long, target long")
    total = np.zeros((2, BUCKETS))
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        total[:, r["bucket"]] = r["raw"], r["target"]
    raw_, target = np.log(total + SMOOTHING) - np.log(total.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return (target - raw_ if total[1].any() else np.zeros(BUCKETS)), 1.0 if share is None else share


def threshold(keys: DataFrame, k: int, fine: int = 4096, few: int = 2000) -> float:
    """The k-th largest value of column `key`: histograms narrow the range until few values are left."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n == 0 or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0  # values beyond the range
    while True:
        within = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        if n <= few or low == high:
            values = sorted((r["key"] for r in within.select("key").limit(few + 1).collect()), reverse=True) if low < high else [low] * n
            return values[k - above - 1]
        width = (high - low) / fine
        spot = F.least(F.floor((F.col("key") - low) / F.lit(width)), F.lit(fine - 1))
        rows = within.groupBy(spot.alias("b")).agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("b")).collect()
        for r in rows:
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE, seed: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, log_weight, gumbel_key, selected.

    share: the part of docs to sample; without it the labels' share of good texts. Null and empty
    texts have weight 0. Rows whose keys equal the k-th one are all selected, as repeated rows
    are. Without good labels all weights are 0. Other columns are not read; an empty table gives
    an empty result.
    """
    ratios, good = log_ratios(docs, labels, id_col, text_col, bound)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts))
            for at, to, block in blocks(texts, CLASSES):
                owner, bucket = ngrams(block)
                out[at:to] = np.bincount(owner, shared.value[bucket], minlength=to - at)
            yield pa.array(out)

    noise = -F.log(-F.log((unit(F.col("doc_id"), seed) + F.lit(2.0**-54))))
    weighed = pick(docs, doc_id=id_col, text=text_col).select("doc_id", weigh("text").alias("log_weight"))
    weighed = materialize(weighed.select("doc_id", "log_weight", (F.col("log_weight") + noise).alias("key")))
    k = round((good if share is None else share) * weighed.count())
    return weighed.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "log_weight", F.col("key").alias("gumbel_key"), (F.col("key") >= F.lit(float(threshold(weighed, k)))).alias("selected"))
