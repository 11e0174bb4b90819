"""Textures, sounds and meshes of a catalog as files (PRJ-09, PRJ-15, PRJ-16, JOIN-03, SNK-04, SNK-07)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.functions import text
from assetlake.media import audio, images
from assetlake.operators.models import FORMATS, channel, obj_text, triangles
from assetlake.sources.binary import AssetError, InvalidData, Unsupported
from assetlake.sources.catalog import Catalog

TEXTURE, MESH, AUDIO = 28, 43, 83
OUTCOME = "struct<content: binary, family: string, message: string>"
_OUTCOME = pa.struct([("content", pa.binary()), ("family", pa.string()), ("message", pa.string())])


def attempted(make: Callable[..., bytes], *columns: Column) -> Column:
    """ERR-01: what a function makes of each row, or the family and message of its error."""

    @arrow_udf(OUTCOME)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            out = []
            for row in zip(*(a.to_pylist() for a in (arrays if isinstance(arrays, tuple) else (arrays,)))):
                try:
                    out.append({"content": make(*row), "family": None, "message": None})
                except AssetError as e:
                    out.append({"content": None, "family": e.family, "message": str(e)})
            yield pa.array(out, _OUTCOME)

    return run(*columns)


def payloads(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """JOIN-03: rows (file, source, offset, size, inline, ...) with `data`: the inline bytes, or a range of
    the resource that the source names, by its normalised path or by its portable name; the earliest wins.

    The ranges that are asked of a resource go to it, and are cut there; its content isn't moved.
    """
    items = catalog.items.filter("kind = 'resource'").select(F.struct("root", "seq").alias("at"), "file", "content")
    names = items.select("at", text.ascii_lower(text.portable_name(F.col("file"))).alias("key")).groupBy("key").agg(F.min("at").alias("at"))
    paths = items.select("at", text.resource_path(F.col("file")).alias("key")).groupBy("key").agg(F.min("at").alias("at"))
    asked = rows.withColumn("_path", text.resource_path(F.col("source"))).withColumn("_name", text.ascii_lower(text.portable_name(F.col("source"))))
    a, b = paths.select(F.col("key").alias("_path"), F.col("at").alias("_a")), names.select(F.col("key").alias("_name"), F.col("at").alias("_b"))
    found = asked.join(a, "_path", "left").join(b, "_name", "left").withColumn("_at", F.when(F.col("source") != "", F.least("_a", "_b")))
    ranges = found.filter("_at is not null and offset >= 0 and size >= 0").groupBy("_at").agg(F.collect_set(F.struct(F.col("offset").cast("long").alias("o"), F.col("size").cast("long").alias("n"))).alias("_ranges"))
    held = items.select(F.col("at").alias("_at"), "content").join(ranges, "_at")
    inside = held.select("_at", "content", F.explode(F.filter("_ranges", lambda r: r["o"] + r["n"] <= F.octet_length("content"))).alias("_r"))
    pieces = inside.select("_at", F.col("_r.o").alias("_o"), F.col("_r.n").alias("_n"), F.expr("substring(content, cast(_r.o + 1 as int), cast(_r.n as int))").alias("_piece"))
    joined = found.withColumn("_o", F.col("offset").cast("long")).withColumn("_n", F.col("size").cast("long")).join(pieces, ["_at", "_o", "_n"], "left")
    data = F.when(F.coalesce(F.col("source"), F.lit("")) == "", F.col("inline")).otherwise(F.col("_piece"))
    return joined.withColumn("data", data).drop("_path", "_name", "_a", "_b", "_at", "_o", "_n", "_piece")


def _bytes(column: Column) -> Column:
    """A list of numbers, as JSON has bytes, as a binary."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if v is None else bytes(x & 255 for x in v) for v in values.to_pylist()], pa.binary())

    return run(column)


def textures(catalog: Catalog, kind: str = "png") -> DataFrame:
    """(file, path_id, name, content, family, message) of Texture2D objects with a type tree, upright."""
    shape = "m_Width int, m_Height int, m_TextureFormat int, `image data` array<int>, m_StreamData struct<offset: long, size: long, path: string>"
    rows = catalog.values([TEXTURE]).filter("value is not null").select("file", "path_id", "name", F.from_json("value", shape).alias("v"))
    rows = rows.select("file", "path_id", "name", F.col("v.m_Width").alias("w"), F.col("v.m_Height").alias("h"), F.col("v.m_TextureFormat").alias("f"), _bytes(F.col("v.image data")).alias("inline"), F.coalesce("v.m_StreamData.path", F.lit("")).alias("source"), F.col("v.m_StreamData.offset").alias("offset"), F.col("v.m_StreamData.size").alias("size"))

    def make(f, data, w, h) -> bytes:
        if data is None:
            raise InvalidData("the texture's data isn't there")
        if not w or not h or w < 0 or h < 0:
            raise InvalidData(f"a texture of {w} x {h}")
        return images.encode(np.ascontiguousarray(images.decode(f, data, w, h)[::-1]), kind)

    return payloads(catalog, rows).select("file", "path_id", "name", attempted(make, F.col("f"), F.col("data"), F.col("w"), F.col("h")).alias("r")).select("file", "path_id", "name", "r.*")


def sounds(catalog: Catalog) -> DataFrame:
    """(file, path_id, name, content, family, message) of AudioClip objects with a type tree, as WAV."""
    shape = "m_Resource struct<m_Source: string, m_Offset: long, m_Size: long>, m_AudioData array<int>"
    rows = catalog.values([AUDIO]).filter("value is not null").select("file", "path_id", "name", F.from_json("value", shape).alias("v"))
    rows = rows.select("file", "path_id", "name", _bytes(F.col("v.m_AudioData")).alias("inline"), F.coalesce("v.m_Resource.m_Source", F.lit("")).alias("source"), F.col("v.m_Resource.m_Offset").alias("offset"), F.col("v.m_Resource.m_Size").alias("size"))

    def make(data) -> bytes:
        if data is None:
            raise InvalidData("the clip's data isn't there")
        return audio.to_wav(data)

    return payloads(catalog, rows).select("file", "path_id", "name", attempted(make, F.col("data")).alias("r")).select("file", "path_id", "name", "r.*")


#: The places of vertex channels.
POSITION, NORMAL, UV0 = 0, 1, 4


def mesh_of(value: dict) -> tuple:
    """PRJ-15: (name, vertices, normals, uvs, faces by submesh) of a decoded mesh."""
    if value.get("m_MeshCompression"):
        raise Unsupported("a compressed mesh")
    vertex, count = value["m_VertexData"], value["m_VertexData"]["m_VertexCount"]
    data, channels = bytes(vertex["m_DataSize"]), vertex["m_Channels"]
    strides: dict[int, int] = {}
    for c in channels:
        dimension = c["dimension"] & 15
        if dimension:
            if c["format"] not in FORMATS:
                raise Unsupported(f"vertex format {c['format']}")
            strides[c["stream"]] = max(strides.get(c["stream"], 0), c["offset"] + dimension * np.dtype(FORMATS[c["format"]][0]).itemsize)
    starts, at = {}, 0
    for stream in range(max(strides, default=-1) + 1):
        strides[stream] = -(-strides.get(stream, 0) // 4) * 4
        starts[stream] = at
        at += -(-count * strides[stream] // 16) * 16

    def read(place: int):
        if place >= len(channels) or not channels[place]["dimension"] & 15:
            return None
        c = channels[place]
        return channel(data[starts[c["stream"]] :], count, strides[c["stream"]], c["offset"], c["format"], c["dimension"] & 15).tolist()

    vertices = read(POSITION)
    if vertices is None:
        raise InvalidData("a mesh without positions")
    wide = bool(value.get("m_IndexFormat"))
    raw, faces = bytes(value["m_IndexBuffer"]), []
    for part in value["m_SubMeshes"]:
        size = part["indexCount"] * (4 if wide else 2)
        if part["firstByte"] + size > len(raw):
            raise InvalidData("a submesh reaches beyond the indices")
        indices = np.frombuffer(raw, "<u4" if wide else "<u2", part["indexCount"], part["firstByte"]).astype(np.int64) + part.get("baseVertex", 0)
        faces.append(triangles(indices.tolist(), part["topology"]))
    return value.get("m_Name") or "mesh", vertices, read(NORMAL), read(UV0), faces


def meshes(catalog: Catalog) -> DataFrame:
    """(file, path_id, name, content, family, message) of Mesh objects with a type tree, as OBJ."""

    def make(value) -> bytes:
        try:
            return obj_text(*mesh_of(json.loads(value))).encode()
        except (KeyError, TypeError, ValueError) as e:
            raise InvalidData(f"a mesh: {e!r}") from e

    rows = catalog.values([MESH]).filter("value is not null")
    return rows.select("file", "path_id", "name", attempted(make, F.col("value")).alias("r")).select("file", "path_id", "name", "r.*")
