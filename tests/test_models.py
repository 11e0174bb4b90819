"""Clips, meshes, motions and incremental ingest."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import asset_bytes as make
from assetlake.operators import animation, models, motion
from assetlake.sources.binary import InvalidData, Unsupported
from assetlake.streaming import ingest


def frame(time, *keys):
    return struct.pack("<fi", time, len(keys)) + b"".join(struct.pack("<i4f", *k) for k in keys)


def test_streamed_clips(spark):
    data = frame(-math.inf, (0, 0, 0, 0, 1)) + frame(0.0, (0, 0, 0, 0, 1), (1, 0, 0, 2, 5)) + frame(1.0, (0, 0, 0, 1, 2), (1, 0, 0, 0, 7)) + frame(2.0, (0, 0, 0, 0, 4)) + frame(math.inf)
    df = spark.createDataFrame([(1, bytearray(data))], "clip int, data binary")
    rows = {(r["curve"], r["time"]): (r["value"], r["in_slope"], r["out_slope"]) for r in animation.streamed_tracks(df, "clip", "data").collect()}
    assert rows == {(0, 0.0): (1, 0, 0), (1, 0.0): (5, 0, 2), (0, 1.0): (2, math.inf, 1), (1, 1.0): (7, 2, 0), (0, 2.0): (4, 4, 0)}
    for cut in (3, 9, len(data) - 1):
        with pytest.raises(InvalidData):
            animation.streamed_keys(data[:cut])
    assert animation.muscle_matrix(np.arange(6), 3).tolist() == [[0, 1, 2], [3, 4, 5]]


def test_rotations(spark):
    s = math.sqrt(0.5)
    df = spark.createDataFrame([(0.0, (s, 0.0, 0.0, s))], "time double, q struct<x: double, y: double, z: double, w: double>")
    got = {r["axis"]: r["value"] for r in animation.rotation_tracks(df, []).collect()}
    assert got["angle_x"] == pytest.approx(90) and got["angle_y"] == pytest.approx(0) and got["angle_z"] == pytest.approx(0)


def test_meshes(spark):
    stream = struct.pack("<3f2B2x", 1, 2, 3, 255, 0) + struct.pack("<3f2B2x", 4, 5, 6, 0, 51)
    assert models.channel(stream, 2, 16, 0, 0, 3).tolist() == [[1, 2, 3], [4, 5, 6]]
    assert models.channel(stream, 2, 16, 12, 2, 2)[1, 1] == pytest.approx(0.2)
    with pytest.raises(InvalidData):
        models.channel(stream, 3, 16, 0, 0, 3)
    assert models.triangles([0, 1, 2, 2, 3, 4], 1) == [(0, 1, 2), (2, 3, 4)][:1] + [(3, 2, 4)]
    assert models.triangles([0, 1, 2, 3], 2) == [(0, 1, 2), (0, 2, 3)]
    with pytest.raises(Unsupported):
        models.triangles([0, 1], 3)
    mesh = [("m", [[1.0, 0.5, 0.0], [0.0, 1.0, math.nan], [0.0, 0.0, 1.0]], None, [[0.0, 1.0], [1.0, 1.0], [0.0, 0.0]], [[[0, 1, 2]]])]
    kind = "name string, vertices array<array<float>>, normals array<array<float>>, uvs array<array<float>>, faces array<array<array<int>>>"
    text = spark.createDataFrame(mesh, kind).select(models.obj(F.struct("*"))).first()[0]
    assert text.split("\r\n") == ["g m", "v -1 0.5 0", "v -0 1 0", "v -0 0 1", "vt 0 1", "vt 1 1", "vt 0 0", "g m_0", "f 3/3 2/2 1/1", ""]


def test_materials(spark):
    rows = [("a", "_Color", [1.0, 0.5, 0.0, 1.0], None), ("a", "_MainTex", None, "t.png"), ("a", "_Other", None, "o.png"), ("a", "_BaseColor", [0.0, 0.0, 0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "m string, name string, colour array<double>, texture string")
    assert [tuple(r) for r in models.material_lines(df, "m", "name", "colour", "texture").collect()] == [("a", "newmtl a\r\nKd 0.0000 0.0000 0.0000\r\nmap_Kd t.png")]


def test_influences(spark):
    df = spark.createDataFrame([(2, [(1, 0.5), (2, 0.0)]), (1, [(1, 0.25), (None, 1.0)])], "v int, p array<struct<bone: int, weight: double>>")
    assert [(r["bone"], [tuple(x) for x in r["influences"]]) for r in models.influences(df, "v", "p").collect()] == [(1, [(1, 0.25), (2, 0.5)])]


def test_motions():
    keys = [(0.0, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0), (2.0, 3.0, math.inf, 0.0), (2.01, 5.0, 0.0, 0.0), (3.0, 5.0, 0.0, 1.0), (6.0, 9.0, 2.0, 0.0)]
    numbers, count, points = motion.segments(keys)
    assert numbers == [0.0, 1.0, 0, 1.0, 1.0, 2, 2.0, 3.0, 3, 3.0, 5.0, 1, 4.0, 6.0, 5.0, 7.0, 6.0, 9.0] and (count, points) == (4, 7)
    with pytest.raises(InvalidData):
        motion.segments([(0.0, math.nan, 0.0, 0.0)])
    out = json.loads(motion.motion_json(6, 30, 1, 1, [{"Target": "Parameter", "Id": "P", "FadeInTime": -1, "FadeOutTime": -1, "keys": keys}], [(0.5, "hey")]))
    assert out["Meta"]["TotalSegmentCount"] == 4 and out["Meta"]["TotalUserDataSize"] == 3 and out["Curves"][0]["Segments"] == numbers
    assert json.loads(motion.expression_json(1, 1, [("P", 0.5, 1)]))["Parameters"] == [{"Id": "P", "Value": 0.5, "Blend": "Multiply"}]
    with pytest.raises(InvalidData):
        motion.expression_json(1, 1, [("P", 0.5, 7)])


def test_roles_and_targets(spark):
    df = spark.createDataFrame([("Opacity",), ("P1",), ("ARM",), ("xPARTy",), ("other",)], "id string")
    lists = [F.array(F.lit(x)) for x in ("P1", "ARM")]
    assert {r["id"]: r["t"] for r in df.select("id", motion.target(F.col("id"), *lists).alias("t")).collect()} == {"Opacity": "Model", "P1": "Parameter", "ARM": "PartOpacity", "xPARTy": "PartOpacity", "other": "Parameter"}
    names = spark.createDataFrame([("ParamEyeLOpen",), ("ParamMouthOpenY",), ("Hair",)], "n string")
    assert [r[0] for r in names.select(motion.fallback_group(F.col("n"))).collect()] == ["EyeBlink", "LipSync", None]
    scripts = spark.createDataFrame([(1, "CubismMoc"), (2, "Other")], "script int, class string")
    found = motion.roles(spark.createDataFrame([(10, 1), (11, 2)], "id int, script int"), scripts, "script", "class")
    assert [(r["id"], r["role"]) for r in found.collect()] == [(10, "Moc")]
    rows = spark.createDataFrame([("m", "a", 1), ("m", "b", 5), ("n", "c", 2)], "moc string, model string, seq int")
    assert sorted(tuple(r) for r in motion.packages(rows, "moc", "model", "seq").collect()) == [("m", 1, "b"), ("n", 2, "c")]
    poses = spark.createDataFrame([(0, 2, "y"), (0, 1, "x"), (1, 1, "z")], "g int, o int, p string")
    assert sorted((r["g"], r["parts"]) for r in motion.pose_groups(poses, "g", "o", "p").collect()) == [(0, ["x", "y"]), (1, ["z"])]


def test_ingest(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "one").write_bytes(make.serialized([(1, 49, make.text_asset("a", b"x"))]))
    ingest.ingest(spark, str(source), out, state).awaitTermination()
    (source / "two.zip").write_bytes(make.zipped([("f", make.serialized([(2, 49, make.text_asset("b", b"y"))]))]))
    (source / "bad").write_bytes(b"UnityFS\0junk")
    ingest.ingest(spark, str(source), out, state).awaitTermination()
    assert sorted(r["path_id"] for r in spark.read.parquet(f"{out}/objects").collect()) == [1, 2]
    assert spark.read.parquet(f"{out}/diagnostics").count() == 1
