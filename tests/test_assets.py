"""Textures, sounds and meshes out of a catalog."""

import struct

import numpy as np

import asset_bytes as make
from assetlake.media import audio, images
from assetlake.operators import assets, sinks
from assetlake.sources import catalog


def leaf(level, kind, name, size=4, meta=0):
    return [(level, kind, name, size, 0, meta)]


def array(level, kind, name, element, meta=0):
    return [(level, kind, name, -1, 0, 0), (level + 1, "Array", "Array", -1, 1, meta), (level + 2, "int", "size", 4, 0, 0), *element]


STRING = lambda level, name: array(level, "string", name, leaf(level + 2, "char", "data", 1), 0x4000)
TEXTURE = leaf(0, "Texture2D", "Base", -1) + STRING(1, "m_Name") + leaf(1, "int", "m_Width") + leaf(1, "int", "m_Height") + leaf(1, "int", "m_TextureFormat") + [(1, "TypelessData", "image data", -1, 0, 0x4000), (2, "int", "size", 4, 0, 0), (2, "UInt8", "data", 1, 0, 0)] + leaf(1, "StreamingInfo", "m_StreamData", -1) + leaf(2, "UInt64", "offset", 8) + leaf(2, "unsigned int", "size") + STRING(2, "path")
AUDIO = leaf(0, "AudioClip", "Base", -1) + STRING(1, "m_Name") + leaf(1, "StreamedResource", "m_Resource", -1) + STRING(2, "m_Source") + leaf(2, "FileSize", "m_Offset", 8) + leaf(2, "FileSize", "m_Size", 8)
MESH = leaf(0, "Mesh", "Base", -1) + STRING(1, "m_Name") + array(1, "vector", "m_SubMeshes", leaf(3, "SubMesh", "data", -1) + leaf(4, "unsigned int", "firstByte") + leaf(4, "unsigned int", "indexCount") + leaf(4, "int", "topology")) + array(1, "vector", "m_IndexBuffer", leaf(3, "UInt8", "data", 1), 0x4000) + leaf(1, "VertexData", "m_VertexData", -1) + leaf(2, "unsigned int", "m_VertexCount") + array(2, "vector", "m_Channels", leaf(4, "ChannelInfo", "data", -1) + [n for k in ("stream", "offset", "format", "dimension") for n in leaf(5, "UInt8", k, 1)]) + [(2, "TypelessData", "m_DataSize", -1, 0, 0x4000), (3, "int", "size", 4, 0, 0), (3, "UInt8", "data", 1, 0, 0)]


def pad(data):
    return data + b"\0" * (-len(data) % 4)


def texture(name, width, height, number, inline=b"", stream=(0, 0, "")):
    return make.text(name) + struct.pack("<iii", width, height, number) + pad(struct.pack("<i", len(inline)) + inline) + struct.pack("<QI", *stream[:2]) + make.text(stream[2])


def clip(name, source, offset, size):
    return make.text(name) + make.text(source) + struct.pack("<QQ", offset, size)


def mesh(name, positions, indices, topology=0):
    channels = [(0, 0, 0, 3)]
    data = b"".join(struct.pack("<3f", *p) for p in positions)
    buffer = struct.pack(f"<{len(indices)}H", *indices)
    return make.text(name) + struct.pack("<i", 1) + struct.pack("<IIi", 0, len(indices), topology) + pad(struct.pack("<i", len(buffer)) + buffer) + struct.pack("<Ii", len(positions), len(channels)) + b"".join(bytes(c) for c in channels) + pad(struct.pack("<i", len(data)) + data)


def test_files_of_a_catalog(spark, tmp_path):
    pixels = np.arange(2 * 3 * 4, dtype=np.uint8).tobytes()
    resource = b"head" + pixels + audio.wav(b"abcd", 1, 8000, 8)
    objects = [
        (1, 28, texture("in", 3, 2, 4, pixels)), (2, 28, texture("out", 3, 2, 4, stream=(4, 24, "archive:/CAB-x/Data.resS"))), (3, 28, texture("lost", 3, 2, 4, stream=(0, 4, "no.resS"))),
        (4, 28, texture("odd", 3, 2, 9999, pixels)), (5, 28, texture("far", 3, 2, 4, stream=(10, 1 << 20, "data.resS"))), (6, 83, clip("ding", "archive:/CAB-x/data.ress", 28, len(resource) - 28)),
        (7, 43, mesh("tri", [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [0, 1, 2])), (8, 43, mesh("bad", [(0, 0, 0)], [0, 1, 2])), (9, 43, mesh("lines", [(0, 0, 0)], [0, 0], 3)),
    ]
    data = make.serialized(objects, trees={28: TEXTURE, 83: AUDIO, 43: MESH})
    cat = catalog.Catalog.of(catalog.in_memory(spark, [("b", make.unityfs([("CAB-x", data), ("data.resS", resource)]))]))
    assert cat.diagnostics.count() == 0
    got = {r["name"]: r for r in assets.textures(cat, "bmp").collect()}
    wanted = images.bmp(np.frombuffer(pixels, np.uint8).reshape(2, 3, 4)[::-1])
    assert bytes(got["in"]["content"]) == wanted == bytes(got["out"]["content"])
    assert {n: got[n]["family"] for n in ("lost", "odd", "far")} == {"lost": "invalid_data", "odd": "unsupported", "far": "invalid_data"}
    assert [bytes(r["content"]) for r in assets.sounds(cat).collect()] == [audio.wav(b"abcd", 1, 8000, 8)]
    made = {r["name"]: r for r in assets.meshes(cat).collect()}
    assert bytes(made["tri"]["content"]).decode().split("\r\n") == ["g tri", "v -0 0 0", "v -1 0 0", "v -0 1 0", "g tri_0", "f 3 2 1", ""]
    assert made["bad"]["family"] == "invalid_data" and made["lines"]["family"] == "unsupported"
    report = {(r["outcome"], r["files"]) for r in sinks.report(sinks.export(cat, str(tmp_path), "png")).collect()}
    assert report == {("exported", 2), ("failed", 2), ("unsupported", 1)}
    assert sorted(p.name for p in (tmp_path / "class_28").iterdir()) == ["in.png", "out.png"]
