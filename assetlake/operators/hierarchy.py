"""Forests of nodes with one parent each (HIER-01 to HIER-06, AGG-11, JOIN-20).

What a node takes from its ancestors is found by doubling: each round joins every node's pointer to
the pointer there, so a forest of depth d takes log2(d) joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.operators.storage import written

MAXIMUM_DEPTH = 512


class HierarchyError(ValueError):
    """Nodes that no root reaches: their parents form a cycle, or are missing."""


def _levels(start: DataFrame, step) -> DataFrame:
    """The union of start and of each next level, until one is empty."""
    out = level = start
    for _ in range(MAXIMUM_DEPTH):
        level = written(step(level))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise HierarchyError(f"deeper than {MAXIMUM_DEPTH} levels")


def climbed(nodes: DataFrame, combine: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]]) -> DataFrame:
    """nodes (_node, _up, and others) with the columns in `combine` gathered from all their ancestors.

    A column holds what is known of the way from the node to _up, which is left out; combine[name] takes
    two functions that give the columns of the node's way and of the way that goes on at _up. Nodes
    that no root reaches within MAXIMUM_DEPTH levels are left out.
    """
    state = written(nodes.withColumn("_lost", F.lit(False)))
    for _ in range(MAXIMUM_DEPTH.bit_length()):
        if state.filter("_up is not null").isEmpty():
            break
        ahead = state.select(*[F.col(c).alias(f"_ahead{c}") for c in state.columns])
        joined = state.join(ahead, F.col("_up") == F.col("_ahead_node"), "left")
        more, missing = F.col("_up").isNotNull(), F.col("_ahead_node").isNull()
        own, far = (lambda c: F.col(c)), (lambda c: F.col(f"_ahead{c}"))
        columns = {c: F.when(more & ~missing, f(own, far)).otherwise(F.col(c)).alias(c) for c, f in combine.items()}
        lost = (F.col("_lost") | (more & (missing | F.coalesce("_ahead_lost", F.lit(False))))).alias("_lost")
        fresh = {"_up": F.when(more & ~missing, F.col("_ahead_up")).alias("_up"), "_lost": lost} | columns
        state = written(joined.select(*[fresh.get(c, F.col(c)) for c in state.columns]))
    return state.filter("_up is null and not _lost").drop("_up", "_lost")


def paths(nodes: DataFrame, key: str, parent: str, name: str, separator: str = "/") -> DataFrame:
    """HIER-03: every node that a root reaches, with root, depth and the path from the root."""
    start = nodes.select(F.col(key).alias("_node"), F.col(parent).alias("_up"), F.col(key).alias("root"), F.col(parent).isNotNull().cast("int").alias("depth"), F.col(name).alias("path"))
    found = climbed(start, {"root": lambda own, far: far("root"), "depth": lambda own, far: own("depth") + far("depth"), "path": lambda own, far: F.concat(far("path"), F.lit(separator), own("path"))})
    return found.select(F.col("_node").alias(key), "root", "depth", "path")


def unreachable(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """HIER-02: nodes of a cycle, or below one or below a missing parent."""
    reached = climbed(nodes.select(F.col(key).alias("_node"), F.col(parent).alias("_up")), {})
    return nodes.join(reached.select(F.col("_node").alias(key)), key, "left_anti")


def children(nodes: DataFrame, key: str, parent: str, seq: str) -> DataFrame:
    """HIER-01: each parent's children in order."""
    return nodes.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(key).alias("child")))), lambda x: x["child"]).alias("children"))


def closure(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(ancestor, node) pairs, each node with itself; as many as the depths add up to."""
    own = nodes.select(F.col(key).alias("ancestor"), F.col(key).alias("node"))
    up = nodes.filter(F.col(parent).isNotNull()).select(F.col(key).alias("_key"), F.col(parent).alias("_parent"))
    step = lambda level: level.join(up, level["ancestor"] == up["_key"]).select(F.col("_parent").alias("ancestor"), "node")
    return _levels(own, step)


def subtree_or(nodes: DataFrame, key: str, parent: str, flag: Column, name: str) -> DataFrame:
    """AGG-11, HIER-05: whether a flag holds anywhere in a node's subtree.

    Flags go up a level at a time; a node is reached once, whatever the number of flags below it."""
    up = written(nodes.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"), F.coalesce(flag, F.lit(False)).alias("_flag")))
    known = level = up.filter("_flag").select("_key")
    for _ in range(MAXIMUM_DEPTH):
        above = level.join(up, "_key").filter("_parent is not null").select(F.col("_parent").alias("_key")).distinct()
        level = written(above.join(known, "_key", "left_anti"))
        if level.isEmpty():
            return up.join(known.withColumn("_has", F.lit(True)), "_key", "left").select(F.col("_key").alias(key), F.coalesce("_has", F.lit(False)).alias(name))
        known = known.unionByName(level)
    raise HierarchyError(f"deeper than {MAXIMUM_DEPTH} levels")


def nearest_ancestor(nodes: DataFrame, key: str, parent: str, mark: Column, name: str) -> DataFrame:
    """JOIN-20: the nearest strict ancestor that is marked, of every node that a root reaches."""
    kind = nodes.schema[key].dataType
    start = nodes.select(F.col(key).alias("_node"), F.col(parent).alias("_up"), F.coalesce(mark, F.lit(False)).alias("_mark"), F.lit(None).cast(kind).alias("_near"))
    found = climbed(start, {"_near": lambda own, far: F.coalesce(own("_near"), F.when(far("_mark"), own("_up")).otherwise(far("_near")))})
    return found.select(F.col("_node").alias(key), F.col("_near").alias(name))


def branch(nodes: DataFrame, key: str, parent: str, node) -> DataFrame:
    """HIER-04: a node's ancestors, root first (role `ancestor`), and its subtree (role `subtree`), with distance."""
    down = nodes.filter(F.col(key) == node).select(key, F.lit(0).alias("distance"))
    if down.isEmpty():
        raise KeyError(f"no node {node}")
    child = written(nodes.select(F.col(key).alias("_key"), F.col(parent).alias("_parent")))
    lower = _levels(down, lambda level: level.join(child, level[key] == child["_parent"]).select(F.col("_key").alias(key), (F.col("distance") + 1).alias("distance")))
    upper = _levels(down, lambda level: level.join(child, level[key] == child["_key"]).filter("_parent is not null").select(F.col("_parent").alias(key), (F.col("distance") - 1).alias("distance")))
    return lower.withColumn("role", F.lit("subtree")).unionByName(upper.filter("distance < 0").withColumn("role", F.lit("ancestor")))


def matrix(position: Column, rotation: Column, scale: Column) -> Column:
    """The 16 numbers, row by row, of a local transform: scale, then rotation (a unit quaternion), then position."""
    x, y, z, w = (rotation[i].cast("double") for i in range(4))
    s, p = [scale[i].cast("double") for i in range(3)], [position[i].cast("double") for i in range(3)]
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )
    cells = [c for r, t in zip(rows, p) for c in (*(v * k for v, k in zip(r, s)), t)]
    return F.array(*cells, *[F.lit(float(v)) for v in (0, 0, 0, 1)])


def multiply(a: Column, b: Column) -> Column:
    """NUM-12: the product of two matrices of 16 numbers."""
    cell = lambda i, j: sum((F.get(a, F.lit(4 * i + k)) * F.get(b, F.lit(4 * k + j)) for k in range(1, 4)), F.get(a, F.lit(4 * i)) * F.get(b, F.lit(j)))
    return F.array(*[cell(i, j) for i in range(4) for j in range(4)])


def inverse(m: Column) -> Column:
    """NUM-12: the inverse of an affine matrix of 16 numbers (last row 0 0 0 1); null if there is none."""
    at = lambda i, j: F.get(m, F.lit(4 * i + j))
    minor = lambda i, j, k, l: at(i, j) * at(k, l) - at(i, l) * at(k, j)  # noqa: E731, E741
    cofactors = [[minor((j + 1) % 3, (i + 1) % 3, (j + 2) % 3, (i + 2) % 3) for j in range(3)] for i in range(3)]
    size = sum((at(0, k) * cofactors[k][0] for k in (1, 2)), at(0, 0) * cofactors[0][0])
    cells = [[c / size for c in row] for row in cofactors]
    shift = [-(sum((cells[i][k] * at(k, 3) for k in (1, 2)), cells[i][0] * at(0, 3))) for i in range(3)]
    flat = [x for row, t in zip(cells, shift) for x in (*row, t)]
    return F.when(size != 0, F.array(*flat, *[F.lit(float(v)) for v in (0, 0, 0, 1)]))


def global_matrices(nodes: DataFrame, key: str, parent: str, local: str) -> DataFrame:
    """HIER-06: (key, matrix): the product of a node's local matrices from its root down."""
    start = nodes.select(F.col(key).alias("_node"), F.col(parent).alias("_up"), F.col(local).alias("matrix"))
    found = climbed(start, {"matrix": lambda own, far: multiply(far("matrix"), own("matrix"))})
    return found.select(F.col("_node").alias(key), "matrix")


def outline(found: DataFrame, path: str = "path", depth: str = "depth") -> DataFrame:
    """HIER-07: one line for each node, indented by its depth, in the order of the paths."""
    name = F.substring_index(path, "/", -1)
    return found.orderBy(path).select(F.concat(F.repeat(F.lit("  "), F.col(depth)), name).alias("line"))
