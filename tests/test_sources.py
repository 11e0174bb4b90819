"""Containers, serialized files and the catalog on bytes made here."""

import io
import json
import struct

import pytest

import asset_bytes as make
from assetlake import __main__ as command
from assetlake.engine import Engine
from assetlake.operators.hierarchy import HierarchyError
from assetlake.sources import catalog, containers, schemas, serialized
from assetlake.sources.binary import InvalidData, Unsupported
from assetlake.sources.containers import Limits, detect, expand

NODES = [
    (0, "Custom", "Base", -1, 0, 0), (1, "string", "m_Name", -1, 0, 0x4000), (2, "Array", "Array", -1, 1, 0x4000), (3, "int", "size", 4, 0, 0), (3, "char", "data", 1, 0, 0),
    (1, "vector", "values", -1, 0, 0), (2, "Array", "Array", -1, 1, 0), (3, "int", "size", 4, 0, 0), (3, "SInt32", "data", 4, 0, 0),
    (1, "vector", "bytes", -1, 0, 0), (2, "Array", "Array", -1, 1, 0x4000), (3, "int", "size", 4, 0, 0), (3, "UInt8", "data", 1, 0, 0),
    (1, "map", "pairs", -1, 0, 0), (2, "Array", "Array", -1, 1, 0), (3, "int", "size", 4, 0, 0), (3, "pair", "data", -1, 0, 0), (4, "int", "first", 4, 0, 0), (4, "float", "second", 4, 0, 0),
    (1, "bool", "flag", 1, 0, 0x4000), (1, "double", "wide", 8, 0, 0),
]
CUSTOM = make.text("Thing") + struct.pack("<i3i", 3, 1, -2, 3) + struct.pack("<i", 3) + b"\1\2\3\0" + struct.pack("<iififif", 2, 7, 0.5, 7, 1.5, 0, 0.0)[:-8] + b"\1\0\0\0" + struct.pack("<d", 2.25)


def some_file(version=22, **options):
    return make.serialized([(1, 49, make.text_asset("hello", b"text\xff")), (2, 49, make.text_asset("", b"")), (5, 1, make.game_object([], "root"))], version, **options)


def test_detection_follows_its_order():
    assert detect(some_file()) == ("serialized", 0)
    assert detect(some_file(17)) == ("serialized", 0)
    assert detect(make.unityfs([("a", b"x")])) == ("bundle", 0)
    assert detect(b"junk" * 9 + make.unityfs([("a", b"x")])) == ("bundle", 36)
    assert detect(make.zipped([("a", b"x")])) == ("zip", 0) and detect(make.gzipped(b"x")) == ("gzip", 0)
    assert detect(make.webdata([("a", b"x")])) == ("web", 0) and detect(b"") == ("resource", 0)
    assert detect(b"x" * 32 + b"brotli")[0] == "brotli"


@pytest.mark.parametrize("codec", [0, 1, 2, 3])
@pytest.mark.parametrize("version,at_end", [(6, False), (7, False), (7, True), (8, False)])
def test_bundles(codec, version, at_end):
    entries = [("a/b.assets", b"a" * 100 + bytes(range(77))), ("empty", b""), ("c.resS", b"z" * 150)]
    bundle = containers.open_bundle(make.unityfs(entries, version, codec, at_end=at_end))
    assert [(e[0], bundle.entry(i)) for i, e in enumerate(bundle.entries)] == entries


def test_other_containers():
    entries = [("x.bin", b"12345" * 9), ("y", b"")]
    for data in (make.unityweb(entries), make.unityweb(entries, compressed=False)):
        bundle = containers.open_bundle(data)
        assert [(e[0], bundle.entry(i)) for i, e in enumerate(bundle.entries)] == entries
    assert list(containers.web_entries(make.webdata(entries, "TuanjieWebData1.0"))) == entries
    nested = make.zipped([("in/one.gz", make.gzipped(make.unityfs([("f.assets", some_file()), ("r.resource", b"abc")]))), ("two.txt", b"t")])
    assert [(x.label, x.kind, x.depth) for x in expand("z", nested)] == [("z::two.txt", "resource", 1), ("z::in/one.gz::f.assets", "serialized", 3), ("z::in/one.gz::r.resource", "resource", 3)]


def test_limits_are_exact():
    data = make.zipped([("a", b"12345"), ("b", b"678")])
    assert len(list(expand("z", data, Limits(bytes=8, entries=2, path_bytes=2)))) == 2
    for less in (Limits(bytes=7), Limits(entries=1), Limits(path_bytes=1), Limits(depth=0)):
        with pytest.raises(InvalidData):
            list(expand("z", data, less))


@pytest.mark.parametrize("version", [13, 14, 15, 16, 17, 19, 20, 21, 22])
def test_serialized_versions(version):
    f = serialized.parse(some_file(version, externals=("archive:/CAB-1/cab-1",)))
    assert [(o.path_id, o.class_id) for o in f.objects] == [(1, 49), (2, 49), (5, 1)]
    assert f.unity_version == "2022.3.62f2" and [e[3] for e in f.externals] == ["archive:/CAB-1/cab-1"] and f.version == version


def test_damaged_files_end_in_their_family():
    data = some_file(17, trees={49: NODES})
    for cut in range(0, len(data), 7):
        with pytest.raises(InvalidData):
            serialized.parse(data[:cut])
    for at in range(20, len(data), 3):
        broken = bytearray(data)
        broken[at] ^= 0x80
        try:
            serialized.parse(bytes(broken))
        except (InvalidData, Unsupported):
            pass
    bundle = make.unityfs([("a", b"q" * 90)], codec=2)
    for at in range(len(bundle)):
        broken = bytearray(bundle)
        broken[at] ^= 0x41
        try:
            list(expand("b", bytes(broken)))
        except (InvalidData, Unsupported):
            pass
    with pytest.raises(InvalidData):
        serialized.parse(make.serialized([(1, 49, b""), (1, 49, b"")]))


def test_type_trees_decode_values():
    data = make.serialized([(9, 123456, CUSTOM)], trees={123456: NODES})
    f = serialized.parse(data)
    o = f.objects[0]
    value = serialized.decode(data[o.start : o.start + o.size], f.big, f.types[o.type_index].nodes)
    assert value == [("m_Name", "Thing"), ("values", [1, -2, 3]), ("bytes", b"\1\2\3"), ("pairs", [[("first", 7), ("second", 0.5)], [("first", 7), ("second", 1.5)]]), ("flag", True), ("wide", 2.25)]
    assert serialized.root_field(data[o.start : o.start + o.size], f.big, f.types[0].nodes, "wide") == 2.25
    with pytest.raises(InvalidData):
        serialized.decode(data[o.start : o.start + o.size] + b"\0", f.big, f.types[0].nodes)


def scene_file():
    objects = [(10, 1, make.game_object([11], "root")), (11, 4, make.transform(10, 0, [21, 31])), (20, 1, make.game_object([21], "left")), (21, 4, make.transform(20, 11)), (30, 1, make.game_object([31], "right")), (31, 4, make.transform(30, 11)), (40, 1, make.game_object([], "alone"))]
    return make.serialized(objects)


def test_engine(spark, tmp_path):
    preload = [(0, 1), (0, 2), (1, 10)]
    first = make.serialized([(1, 49, make.text_asset("note", b"one")), (2, 49, make.text_asset("NOTE", b"two")), (3, 142, make.asset_bundle("ab", preload, [("k/one", 0, 2), ("k/two", 1, 2)])), (4, 999, b"??")], externals=("archive:/x/Scene.Assets",))
    bundle = make.unityfs([("first.assets", first), ("scene.assets", scene_file()), ("data.resS", b"123")], codec=1)
    engine = Engine.of(spark, [("b", make.zipped([("inner.bundle", bundle)])), ("bad", bundle[:70])])
    rows = engine.inspect().collect()
    assert [(r["file"], r["kind"]) for r in rows] == [("b::inner.bundle::first.assets", "serialized"), ("b::inner.bundle::scene.assets", "serialized"), ("b::inner.bundle::data.resS", "resource"), ("bad", "diagnostic")]
    assert {r["class_id"]: r["objects"] for r in engine.info().collect()} == {1: 4, 4: 3, 49: 2, 142: 1, 999: 1}
    assert [r["path_id"] for r in engine.list(1, 3).collect()] == [2, 3, 4]
    got = {r["path_id"]: r["container"] for r in engine.catalog.containers().collect()}
    assert got == {1: "k/one", 2: "k/two", 10: "k/two"}
    assert [(r["path_id"], r["depth"], r["path"]) for r in engine.scene().collect()] == [(40, 0, "alone"), (10, 0, "root"), (20, 1, "root/left"), (30, 1, "root/right")]
    names = {r["path_id"]: r["name"] for r in engine.catalog.names().collect()}
    assert names[1] == "note" and names[4] == "class_999" and names[11] == "class_4"
    report = engine.export(str(tmp_path / "out"), "text")
    done = {r["path"]: r["outcome"] for r in report.collect()}
    assert set(done.values()) == {"exported"} and len(done) == 2
    assert sorted(p.read_bytes() for p in (tmp_path / "out/class_49").iterdir()) == [b"one", b"two"]
    again = {r["outcome"] for r in engine.export(str(tmp_path / "out"), "text").collect()}
    assert again == {"kept"}
    everything = engine.export(str(tmp_path / "json")).collect()
    assert sum(r["outcome"] == "unsupported" for r in everything) == 1 and sum(r["outcome"] == "exported" for r in everything) == 10
    assert json.loads((tmp_path / "json/class_1/root.json").read_text())["m_Name"] == "root"
    assert {r["outcome"] for r in engine.extract(str(tmp_path / "tree")).collect()} == {"exported"}
    assert (tmp_path / "tree/b/inner.bundle/data.resS").read_bytes() == b"123"


def test_references_find_their_files(spark):
    one = make.serialized([(1, 49, make.text_asset("a", b""))], externals=("lib/TWO.assets", "none"))
    two = make.serialized([(7, 49, make.text_asset("b", b"")), (8, 1, make.game_object([], "g"))])
    cat = catalog.Catalog.of(catalog.in_memory(spark, [("one.assets", one), ("x/two.assets", two), ("y/two.assets", two)]))
    refs = spark.createDataFrame([("one.assets", 0, 1, "own"), ("one.assets", 1, 7, "other"), ("one.assets", 1, 9, "dangling"), ("one.assets", 2, 7, "no file"), ("one.assets", 0, 0, "null"), ("one.assets", -1, 1, "null file"), ("one.assets", 1, 8, "class")], "file string, file_id int, path_id long, what string")
    got = {r["what"]: (r["target_file"], r["target_class"]) for r in cat.resolve(refs).collect()}
    assert got == {"own": ("one.assets", 49), "other": ("x/two.assets", 49), "dangling": (None, None), "no file": (None, None), "null": (None, None), "null file": (None, None), "class": ("x/two.assets", 1)}
    assert {r["what"]: r["target_class"] for r in cat.resolve(refs, [1]).collect()}["other"] is None
    assert {r["bytes"] is not None for r in cat.raw().collect()} == {True}


def test_cycles_are_refused(spark):
    data = make.serialized([(1, 1, make.game_object([2], "a")), (2, 4, make.transform(1, 4)), (3, 1, make.game_object([4], "b")), (4, 4, make.transform(3, 2))])
    with pytest.raises(HierarchyError):
        Engine.of(spark, [("c", data)]).scene()


def test_split_files(spark, tmp_path):
    data = some_file()
    for i in range(3):
        (tmp_path / f"level.split{i}").write_bytes(data[i * 60 : (i + 1) * 60] if i < 2 else data[120:])
    (tmp_path / "other").write_bytes(data)
    (tmp_path / "other.split0").write_bytes(b"ignored")
    engine = Engine.open(spark, str(tmp_path))
    assert sorted((r["root"].rsplit("/", 1)[1], r["kind"]) for r in engine.inspect().collect()) == [("level", "serialized"), ("other", "serialized")]
    (tmp_path / "gap.split1").write_bytes(b"x")
    with pytest.raises(Exception, match="missing"):
        Engine.open(spark, str(tmp_path)).inspect().collect()


def test_failing_roots_can_end_the_job(spark):
    with pytest.raises(Exception, match="unsafe path"):
        Engine.of(spark, [("z", make.zipped([("../up", b"x")]))], skip=False).inspect().collect()


def test_matrices_follow_the_chain(spark):
    engine = Engine.of(spark, [("s", scene_file())])
    got = {r["path_id"]: r["matrix"] for r in engine.catalog.global_matrices().collect()}
    assert got[11][3::4] == [1, 2, 3, 1] and got[21][3::4] == [2, 4, 6, 1] and got[31][:3] == [1, 0, 0]


def test_schemas():
    nodes = [{"level": 0, "type": "Base", "name": "Base"}, {"level": 1, "type": "int", "name": "x", "byte_size": 4}]
    more = nodes + [{"level": 1, "type": "int", "name": "y"}]
    entries = [{"assembly": "Game.DLL", "namespace": "n", "class": "C", "nodes": nodes}, {"assembly": "game", "namespace": "n", "class": "C", "unity_version": "2022.1", "nodes": more}, {"assembly": "game", "namespace": "n", "class": "C", "nodes": more}]
    registry = schemas.Registry.from_json(json.dumps(entries))
    assert len(registry.find("GAME", "n", "C")) == 2 and len(registry.find("Game.dll", "n", "C", "2022.1")) == 3 and registry.find("game", "m", "C") is None
    assert serialized.decode(struct.pack("<i", 5), False, registry.find("game", "n", "C")) == [("x", 5)]
    for bad in ("{", "{}", '[{"class": 1}]', json.dumps([{**entries[0], "nodes": [{"level": 3, "type": "a", "name": "b"}]}])):
        with pytest.raises(InvalidData):
            schemas.Registry.from_json(bad)
    with pytest.raises(InvalidData):
        schemas.Registry.from_json(json.dumps(entries), schemas.Limits(nodes=7))
    schemas.Registry.from_json(json.dumps(entries), schemas.Limits(nodes=8))


def test_scripts_name_their_behaviours(spark):
    behaviour = make.pptr(0, 0) + b"\1\0\0\0" + make.pptr(0, 9) + make.text("")
    tree = [(0, "MonoScript", "Base", -1, 0, 0)] + [n for name in ("m_Name", "m_ClassName", "m_Namespace", "m_AssemblyName") for n in ((1, "string", name, -1, 0, 0x4000), (2, "Array", "Array", -1, 1, 0), (3, "int", "size", 4, 0, 0), (3, "char", "data", 1, 0, 0))]
    script = b"".join(make.text(x) for x in ("script", "Walker", "game", "Assembly-CSharp.dll"))
    mono = [(0, "MonoBehaviour", "Base", -1, 0, 0), *pptr_nodes("m_GameObject"), (1, "UInt8", "m_Enabled", 1, 0, 0x4000), *pptr_nodes("m_Script"), (1, "string", "m_Name", -1, 0, 0x4000), (2, "Array", "Array", -1, 1, 0), (3, "int", "size", 4, 0, 0), (3, "char", "data", 1, 0, 0)]
    data = make.serialized([(5, 114, behaviour), (9, 115, script)], trees={114: mono, 115: tree})
    got = Engine.of(spark, [("m", data)]).catalog.scripts().collect()
    assert [(r["path_id"], r["name"], r["class_name"], r["namespace"], r["assembly"]) for r in got] == [(5, "Walker", "Walker", "game", "Assembly-CSharp.dll")]


def pptr_nodes(name):
    return [(1, "PPtr<Object>", name, 12, 0, 0), (2, "int", "m_FileID", 4, 0, 0), (2, "SInt64", "m_PathID", 8, 0, 0)]


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.assets").write_bytes(scene_file())
    out = io.StringIO()
    assert command.run(spark, ["scene", str(tmp_path / "in")], out) == 0
    assert out.getvalue().splitlines() == ["alone", "root", "  left", "  right"]
    assert command.run(spark, ["export", str(tmp_path / "in"), str(tmp_path / "out"), "--class-id", "1"], out := io.StringIO()) == 0
    assert out.getvalue().startswith("exported\t4\t") and len(list((tmp_path / "out/class_1").iterdir())) == 4
    (tmp_path / "in" / "bad").write_bytes(b"UnityFS\0x")
    assert command.run(spark, ["info", str(tmp_path / "in")], io.StringIO()) == 3
