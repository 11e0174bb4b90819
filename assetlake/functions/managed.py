"""Numbers as managed code writes them (NUM-10, NUM-11), and type-tree dumps (ARR-05)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Exponents from which a number is written with E, for single and double precision.
SINGLE, DOUBLE = 9, 17


def _layout(value: float, digits: int, limit: int) -> str:
    mantissa, exponent = f"{value:.{digits - 1}e}".split("e")
    sign, figures, power = "-" if mantissa.startswith("-") else "", mantissa.lstrip("-").replace(".", "").rstrip("0") or "0", int(exponent)
    if power < -4 or power >= limit:
        point = f"{figures[0]}.{figures[1:]}" if len(figures) > 1 else figures
        return f"{sign}{point}E{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{figures}"
    whole = figures[: power + 1].ljust(power + 1, "0")
    return sign + whole + (f".{figures[power + 1:]}" if len(figures) > power + 1 else "")


def number_text(value, single: bool = False) -> str:
    """The shortest digits that give the number back, ties to even, laid out as .NET does."""
    v = np.float32(value) if single else np.float64(value)
    if np.isnan(v):
        return "NaN"
    if np.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if v == 0:
        return "-0" if np.signbit(v) else "0"
    shortest = np.format_float_scientific(v, unique=True, trim="-")
    digits = len(shortest.split("e")[0].lstrip("-").replace(".", ""))
    return _layout(float(v), max(1, digits), SINGLE if single else DOUBLE)


def managed_text(column: Column, single: bool = False) -> Column:
    """number_text of a column of floats or doubles."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if v is None else number_text(v, single) for v in values.to_pylist()], pa.string())

    return run(column)


def three_decimals(value: float) -> str:
    """A number with up to three decimals, without trailing zeros."""
    return f"{value:.3f}".rstrip("0").rstrip(".") or "0"


def dump(value, nodes, index: int = 0, level: int = 0) -> list[str]:
    """ARR-05: lines of a decoded record with their types, a tab for each level."""
    out, children, above = [], [[] for _ in nodes], []
    for i, n in enumerate(nodes):
        del above[n.level :]
        if above:
            children[above[-1]].append(i)
        above.append(i)

    def line(depth: int, kind: str, name: str, shown: str | None = None) -> None:
        out.append("\t" * depth + f"{kind} {name}" + ("" if shown is None else f" = {shown}"))

    def walk(v, i: int, depth: int) -> None:
        node, below = nodes[i], children[i]
        if isinstance(v, str):
            line(depth, node.type, node.name, f'"{v}"')
        elif isinstance(v, bool):
            line(depth, node.type, node.name, str(v))
        elif isinstance(v, float):
            line(depth, node.type, node.name, number_text(v, node.type == "float"))
        elif isinstance(v, int):
            line(depth, node.type, node.name, str(v))
        elif isinstance(v, bytes) or (isinstance(v, list) and not (below and len(below) == len(v) and all(isinstance(x, tuple) for x in v))):
            line(depth, node.type, node.name)
            array = i if node.type == "Array" else (below[0] if below else i)
            line(depth + 1, nodes[array].type, nodes[array].name)
            line(depth + 1, "int", "size", str(len(v)))
            for k, x in enumerate(v):
                out.append("\t" * (depth + 2) + f"[{k}]")
                walk(x, children[array][1] if len(children[array]) > 1 else array, depth + 2)
        else:
            line(depth, node.type, node.name)
            for (_, x), k in zip(v, below):
                walk(x, k, depth + 1)

    walk(value, index, level)
    return out
