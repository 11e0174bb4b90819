"""A corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows to the
shared folder as Parquet and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm import decontaminate, exact, mixing, simhash, toxicity
from assetlake.llm.common import materialize, release, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return exact.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with their words and the copies that the mix takes (size and copies, with
    underscores before a name that is taken); documents it doesn't take are gone."""
    taken = {c.lower() for c in docs.columns}

    def fresh(name: str) -> str:
        return fresh(f"_{name}") if name in taken else name

    found = mixing.mix(docs).filter("copies > 0").select("_row.*", "size", "copies")
    return found.toDF(*docs.columns, fresh("size"), fresh("copies"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: The classifier, the fingerprints and the rounding can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Null and empty texts are texts without words, of which one stays;
    of rows that repeat id and text one stays; an empty table gives an empty result. What a stage writes on
    its way is deleted when its rows are written."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        first = written(spark)
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, first, written(spark) - 1)
    return docs
