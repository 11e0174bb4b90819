"""Claiming names (WIN-04)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(df: DataFrame, name: str, seq: str, suffix: Column, scope: list[str] | None = None) -> DataFrame:
    """The first claimant of a case-folded name keeps it, later ones add a suffix."""
    w = Window.partitionBy(*(scope or []), F.lower(name)).orderBy(seq)
    return df.withColumn("claimed", F.when(F.row_number().over(w) == 1, F.col(name)).otherwise(F.concat(F.col(name), suffix)))


def ordinals(df: DataFrame, key: Column, seq: str, name: str = "ordinal") -> DataFrame:
    """STR-06: the ordinal of each claimant of a case-folded key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lower(key)).orderBy(seq)))


def claim_all(df: DataFrame, name: str, seq: str, folder: str) -> DataFrame:
    """As claim(), with ` (n)` before the extension, where a suffixed name may be taken as well.

    Only names that are equal but for such suffixes depend on each other. Where such a family has one
    name alone, a row's number among its equals is its suffix; only a family with several names (`a` and
    `a (2)`) is walked through in order.
    """
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    stem = F.expr(f"substring({name}, 1, length({name}) - length(_extension))")
    marked = df.withColumn("_extension", extension).withColumn("_stem", stem).withColumn("_folded", F.lower(name))
    marked = marked.withColumn("_family", F.concat(F.regexp_replace(F.lower("_stem"), r"(?s)( \(\d+\))+$", ""), F.lower("_extension")))
    family = Window.partitionBy(folder, "_family")
    marked = marked.withColumn("_several", F.min("_folded").over(family) != F.max("_folded").over(family))
    n = F.row_number().over(Window.partitionBy(folder, "_family").orderBy(seq))
    alone = marked.filter("not _several").withColumn("_n", n)
    alone = alone.withColumn("claimed", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat("_stem", F.lit(" ("), F.col("_n"), F.lit(")"), "_extension")))

    columns = [*df.columns, "claimed"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, tried, out = pdf.sort_values(seq, kind="stable"), set(), {}, []
        for own, start, end in zip(pdf[name], pdf["_stem"], pdf["_extension"]):
            candidate, n_ = own, tried.get(own.lower(), 1)
            if n_ > 1:
                candidate = f"{start} ({n_}){end}"
            while candidate.lower() in taken:
                n_ += 1
                candidate = f"{start} ({n_}){end}"
            taken.add(candidate.lower())
            tried[own.lower()] = n_
            out.append(candidate)
        return pdf.assign(claimed=out)[columns]

    schema = df.withColumn("claimed", F.lit("")).schema
    walked = marked.filter("_several").groupBy(folder, "_family").applyInPandas(fold, schema)
    return alone.select(*df.columns, "claimed").unionByName(walked)
