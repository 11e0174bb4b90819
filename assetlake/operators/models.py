"""Meshes (ANI-08, ANI-10, ANI-12, SNK-04): channels, triangles, and OBJ and MTL text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.functions.managed import number_text
from assetlake.sources.binary import InvalidData, Unsupported

#: Vertex component formats by number: numpy type and what a whole number is divided by.
FORMATS = {0: ("<f4", None), 1: ("<f2", None), 2: ("u1", 255), 3: ("i1", 127), 4: ("<u2", 65535), 5: ("<i2", 32767), 6: ("u1", 1), 7: ("i1", 1), 8: ("<u2", 1), 9: ("<i2", 1), 10: ("<u4", 1), 11: ("<i4", 1)}
#: Material properties and what they are in a material file.
COLOURS = {"_Color": "Kd", "_BaseColor": "Kd", "_SpecColor": "Ks", "_EmissionColor": "Ke", "_ReflectColor": "Kr"}
MAPS = {"_MainTex": "map_Kd", "_BaseMap": "map_Kd", "_BumpMap": "map_bump", "_NormalMap": "map_bump", "_SpecGlossMap": "map_Ks", "_EmissionMap": "map_Ke"}


def channel(data: bytes, vertices: int, stride: int, offset: int, number: int, dimension: int) -> np.ndarray:
    """ANI-08: (vertices, dimension) floats of a channel in a stream of vertices."""
    if number not in FORMATS:
        raise Unsupported(f"vertex format {number}")
    kind, whole = FORMATS[number]
    width = np.dtype(kind).itemsize * dimension
    if vertices and (offset + width > stride or len(data) < stride * vertices):
        raise InvalidData("a vertex channel lies outside its stream")
    raw = np.frombuffer(data, np.uint8)[: stride * vertices].reshape(vertices, stride)[:, offset : offset + width]
    values = np.ascontiguousarray(raw).view(kind).astype(np.float32)
    return values if whole in (None, 1) else np.maximum(values / np.float32(whole), np.float32(-1))


def triangles(indices: list[int], topology: int) -> list[tuple[int, int, int]]:
    """ANI-10: lists (0), strips (1) and quads (2) as triangles, without those of equal corners in strips."""
    if topology == 0:
        return [tuple(indices[i : i + 3]) for i in range(0, len(indices) - 2, 3)]
    if topology == 1:
        windows = ((i, indices[i : i + 3]) for i in range(len(indices) - 2))
        return [(b, a, c) if i % 2 else (a, b, c) for i, (a, b, c) in windows if a != b and b != c and a != c]
    if topology == 2:
        return [t for i in range(0, len(indices) - 3, 4) for a, b, c, d in [indices[i : i + 4]] for t in ((a, b, c), (a, c, d))]
    raise Unsupported(f"topology {topology}")


def _numbers(values) -> str:
    return " ".join("0" if v != v else number_text(v, single=True) for v in values)


def obj_text(name: str, vertices, normals, uvs, faces: list[list[tuple[int, int, int]]]) -> str:
    """SNK-04: one mesh in the other handedness: x is turned, and so is each face."""
    lines = [f"g {name}"]
    lines += [f"v {_numbers((-v[0], v[1], v[2]))}" for v in vertices]
    lines += [f"vt {_numbers(t[:2])}" for t in uvs or []]
    lines += [f"vn {_numbers((-n[0], n[1], n[2]))}" for n in normals or []]
    corner = lambda i: f"{i + 1}/{i + 1 if uvs else ''}/{i + 1 if normals else ''}".rstrip("/")
    for k, part in enumerate(faces):
        lines.append(f"g {name}_{k}")
        for face in part:
            if max(face) >= len(vertices):
                raise InvalidData(f"a face has corner {max(face)} of {len(vertices)}")
            lines.append("f " + " ".join(corner(i) for i in (face[2], face[1], face[0])))
    return "\r\n".join(lines) + "\r\n"


def obj(mesh: Column) -> Column:
    """OBJ text of a column of meshes: name, vertices, normals and uvs as lists of lists, faces by submesh."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if m is None else obj_text(m["name"], m["vertices"], m["normals"], m["uvs"], m["faces"]) for m in values.to_pylist()], pa.string())

    return run(mesh)


def material_lines(properties: DataFrame, material: str, name: str, colour: str, texture: str) -> DataFrame:
    """ANI-12: (material, text): colours and maps of each material, the first property of a kind alone.

    properties: a row for each property, with its colour (an array) or its texture's name.
    """
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    kind = F.coalesce(F.when(F.col(colour).isNotNull(), F.element_at(lookup(COLOURS), F.col(name))), F.when(F.col(texture).isNotNull(), F.element_at(lookup(MAPS), F.col(name))))
    shown = F.coalesce(F.col(texture), F.array_join(F.transform(F.slice(colour, 1, 3), lambda c: F.format_number(c, 4)), " "))
    lines = properties.select(material, kind.alias("_kind"), F.concat_ws(" ", kind, shown).alias("_line"), F.col(name).alias("_name")).filter("_kind is not null")
    first = lines.groupBy(material, "_kind").agg(F.min_by("_line", "_name").alias("_line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_kind", "_line"))), lambda x: x["_line"]), "\r\n")
    return first.groupBy(material).agg(F.concat(F.lit("newmtl "), F.col(material), F.lit("\r\n"), text).alias("text"))


def influences(weights: DataFrame, vertex: str, pairs: str) -> DataFrame:
    """AGG-08, FLT-07: from each vertex's (bone, weight) pairs to each bone's (vertex, weight) list."""
    rows = weights.select(vertex, F.inline(pairs)).filter("weight > 0 and bone is not null")
    return rows.groupBy("bone").agg(F.array_sort(F.collect_list(F.struct(vertex, "weight"))).alias("influences"))
