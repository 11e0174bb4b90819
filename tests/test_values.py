"""Functions, media and operators on small values."""

import io
import math
import random
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.functions import managed, numeric, packed, text
from assetlake.media import audio, images
from assetlake.operators import naming, references
from assetlake.sources.binary import InvalidData, Unsupported
from assetlake.sources.serialized import Node


def test_numbers_as_managed_text():
    cases = {0.1: "0.1", 1e-4: "0.0001", 9.9e-5: "9.9E-05", 1e8: "100000000", 1.5e9: "1.5E+09", -2.5e-10: "-2.5E-10", 12345.679: "12345.679", 0.0: "0", math.inf: "Infinity", 1298351.25: "1298351.2"}
    assert {v: managed.number_text(v, single=True) for v in cases} == cases
    assert managed.number_text(-0.0) == "-0" and managed.number_text(0.1) == "0.1" and managed.number_text(1e17) == "1E+17" and managed.number_text(math.nan) == "NaN"
    assert managed.three_decimals(1.5) == "1.5" and managed.three_decimals(2.0) == "2"
    r = random.Random(0)
    for _ in range(500):
        bits = r.getrandbits(32)
        v = struct.unpack("<f", struct.pack("<I", bits))[0]
        if math.isfinite(v):
            assert np.float32(float(managed.number_text(v, single=True))) == np.float32(v)


def test_dump():
    nodes = [Node(0, "Base", "Base", -1, 0, 0, 1, 0), Node(1, "float", "x", 4, 0, 0, 1, 0), Node(1, "vector", "v", -1, 0, 0, 1, 0), Node(2, "Array", "Array", -1, 0, 1, 1, 0), Node(3, "int", "size", 4, 0, 0, 1, 0), Node(3, "int", "data", 4, 0, 0, 1, 0)]
    assert managed.dump([("x", 0.5), ("v", [7])], nodes) == ["Base Base", "\tfloat x = 0.5", "\tvector v", "\t\tArray Array", "\t\tint size = 1", "\t\t\t[0]", "\t\t\tint data = 7"]


@pytest.mark.parametrize("width", [1, 3, 8, 13, 31, 32])
def test_packed_integers(spark, width):
    r = random.Random(width)
    values = [r.getrandbits(width) for _ in range(50)]
    data = packed.pack_bits(values, width)
    assert packed.unpack_bits(data, 50, width).tolist() == values
    row = spark.createDataFrame([(bytearray(data), 50, width)], "d binary, n int, w int")
    assert row.select(packed.integers("d", "n", "w")).first()[0] == values
    assert row.select(numeric.bit_field(F.col("d"), F.lit(7), width)).first()[0] == values[7]
    with pytest.raises(ValueError):
        packed.unpack_bits(data, 50 + 8, width)


def test_packed_floats_and_quaternions(spark):
    got = packed.unpack_floats(packed.pack_bits([0, 128, 255], 8), 3, 8, 2.0, -1.0)
    assert got.dtype == np.float32 and got[0] == -1 and got[2] == pytest.approx(1)
    assert packed.unpack_floats(b"", 2, 0, 1.0, 3.0).tolist() == [3, 3]
    row = spark.createDataFrame([(bytearray(packed.pack_bits([0, 255], 8)), 2, 8, 2.0, -1.0)], "d binary, n int, w int, r float, s float")
    assert row.select(packed.floats("d", "n", "w", "r", "s")).first()[0] == [-1.0, 1.0]
    bits = 3 | 4  # the last component is left out, and negative
    value, at = bits, 3
    for width, x in ((9, 255), (10, 511), (10, 511)):
        value |= x << at
        at += width
    q = packed.unpack_quaternions(struct.pack("<I", value), 1)[0]
    assert np.linalg.norm(q) == pytest.approx(1) and q[3] < -0.99
    assert packed.rgb9e5(struct.pack("<I", 256 | 24 << 27)).tolist() == [[256.0, 0.0, 0.0]]
    n = packed.octahedral_normals(np.array([[0.6, 0.0], [3.0, 4.0]]), np.array([True, False]))
    assert n[0].tolist() == pytest.approx([0.6, 0, -0.8]) and n[1].tolist() == pytest.approx([0.6, 0.8, 0])


def test_linear_formats():
    assert images.linear("ARGB32", bytes([1, 2, 3, 4])).tolist() == [[2, 3, 4, 1]]
    assert images.linear("RGB565", struct.pack("<H", 0xF800)).tolist() == [[255, 0, 0, 255]]
    assert images.linear("RGBA4444", struct.pack("<H", 0x1234)).tolist() == [[17, 34, 51, 68]]
    assert images.linear("RGBAFloat", struct.pack("<4f", 0, 1, 2, math.nan)).tolist() == [[0, 255, 255, 0]]
    assert images.linear("RHalf", np.array([0.5], "<f2").tobytes()).tolist() == [[128, 0, 0, 255]]
    assert images.linear("R16", struct.pack("<2H", 65535, 257)).tolist() == [[255, 0, 0, 255], [1, 0, 0, 255]]
    assert images.linear("YUY2", bytes([16, 128, 235, 128])).tolist() == [[0, 0, 0, 255], [255, 255, 255, 255]]
    with pytest.raises(InvalidData):
        images.decode(4, b"123", 1, 1)
    with pytest.raises(Unsupported):
        images.decode(9999, b"", 1, 1)


def test_blocks():
    data = struct.pack("<HHI", 0xF800, 0x001F, 0b11_10_01_00)
    row = images.decode(10, data, 4, 4)[0].tolist()
    assert row == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    clear = images.decode(10, struct.pack("<HHI", 0, 1, 3), 3, 2)
    assert clear.shape == (2, 3, 4) and clear[0, 0].tolist() == [0, 0, 0, 0]
    alpha = bytes([255, 0]) + (2).to_bytes(6, "little")
    assert images.decode(12, alpha + data, 4, 4)[0, :2, 3].tolist() == [(6 * 255) // 7, 255]
    assert images.decode(26, alpha, 4, 4)[0, 0].tolist() == [218, 0, 0, 255]
    assert images.mips(10, 8, 8, 4) == [(0, 32, 8, 8), (32, 8, 4, 4), (40, 8, 2, 2), (48, 8, 1, 1)]


def unfilter(body, width, height):
    rows, above, at = [], [0] * (width * 4), 0
    for _ in range(height):
        kind, raw = body[at], body[at + 1 : at + 1 + width * 4]
        at += 1 + width * 4
        row = []
        for i, x in enumerate(raw):
            a, b, c = (row[i - 4] if i >= 4 else 0), above[i], (above[i - 4] if i >= 4 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((x + (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        rows.append(row)
        above = row
    return np.array(rows, np.uint8).reshape(height, width, 4)


def read_qoi(data):
    width, height = struct.unpack(">II", data[4:12])
    seen, p, out, at = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), [], 14
    while len(out) < width * height:
        b = data[at]
        at += 1
        if b == 0xFE:
            p, at = (*data[at : at + 3], p[3]), at + 3
        elif b == 0xFF:
            p, at = tuple(data[at : at + 4]), at + 4
        elif b >> 6 == 0:
            p = seen[b]
        elif b >> 6 == 1:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        elif b >> 6 == 2:
            g, c = (b & 63) - 32, data[at]
            at += 1
            p = ((p[0] + g + (c >> 4) - 8) & 255, (p[1] + g) & 255, (p[2] + g + (c & 15) - 8) & 255, p[3])
        else:
            out += [p] * (b & 63)
        seen[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out.append(p)
    assert data[at:] == b"\0" * 7 + b"\1"
    return np.array(out, np.uint8).reshape(height, width, 4)


@pytest.mark.parametrize("kind", ["noise", "flat", "ramp"])
def test_image_files(kind):
    r = np.random.default_rng(1)
    image = {"noise": r.integers(0, 256, (9, 13, 4)), "flat": np.full((9, 130, 4), 7), "ramp": np.add.outer(np.arange(9), np.arange(13))[:, :, None] + np.array([0, 1, 2, 200])}[kind].astype(np.uint8)
    height, width = image.shape[:2]
    body = images.png(image)
    assert (unfilter(zlib.decompress(body[41 : 41 + struct.unpack(">I", body[33:37])[0]]), width, height) == image).all()
    assert (read_qoi(images.qoi(image)) == image).all()
    assert images.bmp(image)[54:58] == bytes(image[-1, 0, [2, 1, 0, 3]]) and images.tga(image)[18:22] == bytes(image[0, 0, [2, 1, 0, 3]])
    with pytest.raises(Unsupported):
        images.encode(image, "webp")


def test_sprites_and_alpha():
    page = np.arange(4 * 5 * 4).reshape(4, 5, 4).astype(np.uint8)
    assert (images.sprite(page, 1, 0, 2, 1) == page[3:4, 1:3]).all() and (images.sprite(page, 0, 0, 5, 4, "rotate_180") == page[::-1, ::-1]).all()
    with pytest.raises(InvalidData):
        images.sprite(page, 4, 0, 2, 1)
    one = np.array([[[200, 100, 0, 128]]], np.uint8)
    assert images.composite(one, (0, 0, 255)).tolist() == [[[100, 50, 127, 255]]]
    assert images.merge_alpha(one, np.array([[[10, 20, 31, 0]]], np.uint8))[0, 0, 3] == 20


def bank(mode, samples, version=1):
    heads = b"".join(struct.pack("<Q", 8 << 1 | (channels - 1) << 5 | offset // 32 << 7 | frames << 34) for channels, frames, offset, _ in samples)
    data = bytearray()
    for _, _, offset, body in samples:
        data += b"\0" * (offset - len(data)) + body
    head = b"FSB5" + struct.pack("<6I", version, len(samples), len(heads), 0, len(data), mode)
    return head.ljust(0x3C if version else 0x40, b"\0") + heads + bytes(data)


def test_banks():
    pcm = np.arange(-20, 20, dtype="<i2").tobytes()
    out = wave.open(io.BytesIO(audio.to_wav(bank(2, [(2, 20, 0, pcm), (1, 4, 96, b"12345678")]))))
    assert (out.getnchannels(), out.getframerate(), out.readframes(99)) == (2, 44100, pcm)
    silent = struct.pack("<hBB", 1000, 0, 0) + b"\0" * 32
    decoded = wave.open(io.BytesIO(audio.to_wav(bank(7, [(1, 64, 0, silent)], version=0))))
    assert decoded.getnframes() == 64 and struct.unpack("<h", decoded.readframes(1))[0] == 1000
    assert audio.to_wav(audio.wav(b"ab", 1, 8000, 8)) == audio.wav(b"ab", 1, 8000, 8)
    with pytest.raises(Unsupported):
        audio.to_wav(bank(15, [(1, 1, 0, b"x")]))
    good = bank(2, [(2, 20, 0, pcm)])
    for cut in range(0, len(good) - 1, 5):
        with pytest.raises(InvalidData):
            audio.to_wav(good[:cut])
    assert audio.float_to_pcm16(np.array([2.0, -2.0, math.nan, 0.5])).tolist() == [32767, -32767, 0, 16384]


def test_text_functions(spark):
    rows = [("a::b/c\\D.txt",), ("archive:/archive:\\X\\Y",), (" ..CON.txt. ",), ("a:b",), ("",), ("É.x",), ("../up",)]
    df = spark.createDataFrame(rows, "s string")
    s = F.col("s")
    got = {r["s"]: r for r in df.select("s", text.portable_name(s).alias("p"), text.exported_name(s).alias("e"), text.resource_path(s).alias("r"), text.sanitize(s).alias("n"), text.is_unsafe(s).alias("u"), text.ascii_lower(s).alias("l"), text.before_extension(s, F.lit("_1")).alias("b"), text.with_extension(s).alias("x"), text.join_path(F.lit(""), s).alias("j"), text.without_suffix(s, ".txt").alias("w")).collect()}
    assert got["a::b/c\\D.txt"]["p"] == "D.txt" and got["a:b"]["e"] == "b" and got["archive:/archive:\\X\\Y"]["r"] == "x/y"
    assert got[" ..CON.txt. "]["n"] == "_CON.txt" and got[""]["n"] == "unnamed" and got["a:b"]["n"] == "a_b"
    assert got["../up"]["u"] and not got["É.x"]["u"] and got["É.x"]["l"] == "É.x" and got["É.x"]["b"] == "É_1.x"
    assert got["a:b"]["x"] == "a:b.txt" and got["a:b"]["j"] == "/a:b" and got["a::b/c\\D.txt"]["w"] == "a::b/c\\D"


def test_versions(spark):
    df = spark.createDataFrame([("2022.3.62f2",), ("5.0",), ("x",), (None,), ("2019.4.1",)], "v string").select("v", text.version(F.col("v")).alias("p"))
    got = {r["v"]: (r["p"], r["g"]) for r in df.select("v", "p", text.version_gate(F.col("p"), (2019, 0, 0), (2022, 3, 62)).alias("g")).collect()}
    assert tuple(got["2022.3.62f2"][0]) == (2022, 3, 62, "f", 2) and got["2022.3.62f2"][1] == "verified"
    assert got["5.0"][1] == "unsupported" and got["x"] == (None, "unsupported") and got[None][1] == "unsupported"


def test_names_may_collide_again(spark):
    rows = [("d", "a.png", 1), ("d", "A.png", 2), ("d", "a (2).png", 3), ("d", "a.png", 4), ("e", "a.png", 5)]
    got = naming.claim_all(spark.createDataFrame(rows, "folder string, name string, seq int"), "name", "seq", "folder").collect()
    assert {r["seq"]: r["claimed"] for r in got} == {1: "a.png", 2: "A (2).png", 3: "a (2) (2).png", 4: "a (3).png", 5: "a.png"}


def test_hashes_of_path_suffixes(spark):
    nodes = spark.createDataFrame([(1, "root/hip/leg"), (2, "root/arm/leg")], "seq int, path string")
    rows = spark.createDataFrame([(zlib.crc32(b"leg"),), (zlib.crc32(b"hip/leg"),), (5,)], "hash long")
    got = {r["hash"]: r["node"] for r in references.hash_match(rows, nodes, "hash", "path", "seq").collect()}
    assert got == {zlib.crc32(b"leg"): 2, zlib.crc32(b"hip/leg"): 1, 5: None}
