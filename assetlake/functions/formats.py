"""Formats by their first bytes, split files and JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def text_format(content: Column) -> Column:
    """SRC-07 for text: the first rule that fits."""
    rules = (("UnityFS", "bundle"), ("PK", "zip"), ("<!DOCTYPE", "markup"), ("<html", "markup"))
    out = F.lit("resource")
    for prefix, name in reversed(rules):
        out = F.when(content.startswith(prefix), name).otherwise(out)
    return out


def concatenated(parts: Column) -> Column:
    """SRC-04: a list of binaries as one."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([None if x is None else b"".join(x) for x in lists.to_pylist()], pa.binary())

    return run(parts)


class SplitError(ValueError):
    """A split file with a part missing or twice."""


def reassemble(parts: DataFrame, key: str, index: str, content: str) -> DataFrame:
    """SRC-04, SRC-05: parts 0 to n-1 of each key as one content; a gap or a part given twice is an error.

    A file's parts meet in one group, as a file must fit one value.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(content).alias("c"))))
    grouped = parts.groupBy(key).agg(ordered.alias("_parts"))
    wrong = F.exists(F.transform("_parts", lambda p, i: p["i"] < i), lambda x: x), F.exists(F.transform("_parts", lambda p, i: p["i"] > i), lambda x: x)
    joined = concatenated(F.transform("_parts", lambda p: p["c"]))
    checked = F.when(wrong[0], F.raise_error(F.concat(F.lit("a part is given twice: "), F.col(key)))).when(wrong[1], F.raise_error(F.concat(F.lit("a part is missing: "), F.col(key)))).otherwise(joined)
    return grouped.select(key, checked.alias(content), F.size("_parts").alias("parts"))


def json_value(value):
    """A value as JSON knows it: single precision keeps its shortest digits, NaN and infinities are strings."""
    if isinstance(value, dict):
        return {k: json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_value(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return list(value)
    if isinstance(value, np.float32):
        value = float(str(value))
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
    return value


def _singles(kind: pa.DataType, value):
    """Python values with single precision marked, as Arrow widens it."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _singles(f.type, value[f.name]) for f in kind}
    if pa.types.is_list(kind):
        return [_singles(kind.value_type, v) for v in value]
    return np.float32(value) if pa.types.is_float32(kind) else value


def pretty_json(value: Column) -> Column:
    """ARR-04: JSON with two spaces for each level."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([json.dumps(json_value(_singles(values.type, v)), indent=2, ensure_ascii=False) for v in values.to_pylist()], pa.string())

    return run(value)
