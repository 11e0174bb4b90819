"""Serialized files (SRC-16, SRC-20) and objects decoded by their type trees (PRJ-02 to PRJ-06)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from assetlake.sources.binary import InvalidData, Reader, Unsupported
from assetlake.sources.containers import serialized_header

#: Names that type trees share, in the order of their buffer, each ended by a zero byte.
COMMON = (
    "AABB", "AnimationClip", "AnimationCurve", "AnimationState", "Array", "Base", "BitField", "bitset", "bool", "char", "ColorRGBA", "Component", "data", "deque", "double",
    "dynamic_array", "FastPropertyName", "first", "float", "Font", "GameObject", "Generic Mono", "GradientNEW", "GUID", "GUIStyle", "int", "list", "long long", "map",
    "Matrix4x4f", "MdFour", "MonoBehaviour", "MonoScript", "m_ByteSize", "m_Curve", "m_EditorClassIdentifier", "m_EditorHideFlags", "m_Enabled", "m_ExtensionPtr",
    "m_GameObject", "m_Index", "m_IsArray", "m_IsStatic", "m_MetaFlag", "m_Name", "m_ObjectHideFlags", "m_PrefabInternal", "m_PrefabParentObject", "m_Script",
    "m_StaticEditorFlags", "m_Type", "m_Version", "Object", "pair", "PPtr<Component>", "PPtr<GameObject>", "PPtr<Material>", "PPtr<MonoBehaviour>", "PPtr<MonoScript>",
    "PPtr<Object>", "PPtr<Prefab>", "PPtr<Sprite>", "PPtr<TextAsset>", "PPtr<Texture>", "PPtr<Texture2D>", "PPtr<Transform>", "Prefab", "Quaternionf", "Rectf", "RectInt",
    "RectOffset", "second", "set", "short", "size", "SInt16", "SInt32", "SInt64", "SInt8", "staticvector", "string", "TextAsset", "TextMesh", "Texture", "Texture2D",
    "Transform", "TypelessData", "UInt16", "UInt32", "UInt64", "UInt8", "unsigned int", "unsigned long long", "unsigned short", "vector", "Vector2f", "Vector3f", "Vector4f",
    "m_ScriptingClassIdentifier", "Gradient", "Type*", "int2_storage", "int3_storage", "BoundsInt", "m_CorrespondingSourceObject", "m_PrefabInstance", "m_PrefabAsset",
    "FileSize", "Hash128", "RenderingLayerMask", "fixed_array", "EntityId",
)
COMMON_BYTES = "".join(f"{name}\0" for name in COMMON).encode()
#: Set where a string lies in the common buffer; set where a value is followed by padding.
IN_COMMON, ALIGN, IS_ARRAY = 0x80000000, 0x4000, 1


@dataclass
class Node:
    level: int
    type: str
    name: str
    byte_size: int
    index: int
    type_flags: int
    version: int
    meta_flags: int


@dataclass
class Type:
    class_id: int
    stripped: bool = False
    script_index: int = -1
    script_id: bytes | None = None
    hash: bytes | None = None
    nodes: list[Node] = field(default_factory=list)
    dependencies: list[int] = field(default_factory=list)
    name: tuple[str, str, str] | None = None  # class, namespace, assembly of a reference type


@dataclass
class Object:
    path_id: int
    start: int
    size: int
    type_id: int
    class_id: int
    type_index: int | None


@dataclass
class SerializedFile:
    version: int
    unity_version: str | None
    platform: int | None
    big: bool
    types: list[Type]
    objects: list[Object]
    scripts: list[tuple[int, int]]
    externals: list[tuple[str, bytes, int, str]]  # prefix, guid, kind, path
    reference_types: list[Type]
    user: str


def _blob(r: Reader, version: int) -> list[Node]:
    size = 32 if version >= 19 else 24
    n, strings = r.count(0, "nodes"), r.count(0, "string bytes")
    raw = Reader(r.take(n * size), big=r.big)
    buffer = r.take(strings)

    def text(offset: int) -> str:
        data, at = (COMMON_BYTES, offset & ~IN_COMMON) if offset & IN_COMMON else (buffer, offset)
        return Reader(data, at).cstring() if at < len(data) else f"<{at}>"

    nodes = []
    for _ in range(n):
        v, level, flags = raw.u16(), raw.u8(), raw.u8()
        kind, name = text(raw.u32()), text(raw.u32())
        nodes.append(Node(level, kind, name, raw.i32(), raw.i32(), flags, v, raw.i32()))
        if size == 32:
            raw.u64()
    _check_levels(nodes)
    return nodes


def _check_levels(nodes: list[Node]) -> None:
    if nodes and nodes[0].level or any(b.level == 0 or b.level > a.level + 1 for a, b in zip(nodes, nodes[1:])):
        raise InvalidData("a type tree's levels don't form a tree")


def _recursive(r: Reader, level: int, out: list[Node]) -> None:
    if level > 128:
        raise InvalidData("a type tree is too deep")
    kind, name, size, index, flags, version, meta = r.cstring(), r.cstring(), r.i32(), r.i32(), r.i32(), r.i32(), r.i32()
    out.append(Node(level, kind, name, size, index, flags, version, meta))
    for _ in range(r.count(26, "nodes")):
        _recursive(r, level + 1, out)


def _type(r: Reader, version: int, trees: bool, reference: bool) -> Type:
    t = Type(r.i32())
    if version >= 16:
        t.stripped = bool(r.u8())
    if version >= 17:
        t.script_index = r.i16()
    if version >= 13:
        if reference and t.script_index >= 0 or version < 16 and t.class_id < 0 or version >= 16 and t.class_id == 114:
            t.script_id = r.take(16)
        t.hash = r.take(16)
    if trees:
        if version >= 12 or version == 10:
            t.nodes = _blob(r, version)
        else:
            _recursive(r, 0, t.nodes)
        if version >= 21 and reference:
            t.name = (r.cstring(), r.cstring(), r.cstring())
        elif version >= 21:
            t.dependencies = [r.i32() for _ in range(r.count(4, "dependencies"))]
    return t


def parse(data: bytes, hint: str | None = None, override: str | None = None) -> SerializedFile:
    """Header, types, objects, scripts, externals and reference types.

    The version of the engine is the override, else a bundle's hint where the file can't state its
    own (before format 7, or stripped), else what the file declares.
    """
    header = serialized_header(data)
    if header is None:
        if len(data) >= 12 and 0 < int.from_bytes(data[8:12], "big") < 5:
            raise Unsupported("a format before 5")
        raise InvalidData("not a serialized file")
    version, metadata, size, offset, head = header
    base = head if version >= 9 else size - metadata
    big = bool(data[16] if version >= 9 else data[base])
    r = Reader(data, base + (version < 9), big, base + metadata)
    declared = r.cstring() if version >= 7 else None
    platform = r.i32() if version >= 8 else None
    trees = bool(r.u8()) if version >= 13 else True
    types = [_type(r, version, trees, False) for _ in range(r.count(4, "types"))]
    by_id = {}
    for i, t in enumerate(types):
        by_id.setdefault(t.class_id, i)
    wide = bool(r.i32()) if 7 <= version < 14 else False
    objects, seen = [], set()
    for _ in range(r.count(12, "objects")):
        if wide:
            path_id = r.i64()
        elif version < 14:
            path_id = r.i32()
        else:
            r.align(4, base)
            path_id = r.i64()
        start = offset + (r.i64() if version >= 22 else r.u32())
        length, type_id = r.u32(), r.i32()
        if version < 16:
            class_id, index = r.u16(), by_id.get(type_id)
        elif 0 <= type_id < len(types):
            class_id, index = types[type_id].class_id, type_id
        else:
            raise InvalidData(f"object type {type_id} of {len(types)}")
        if version < 11:
            r.u16()
        if 11 <= version < 17:
            r.i16()
        if version in (15, 16):
            r.u8()
        if not offset <= start <= start + length <= (size if version >= 9 else size - metadata):
            raise InvalidData(f"object {path_id} lies outside the data")
        if path_id in seen:
            raise InvalidData(f"object {path_id} is there twice")
        seen.add(path_id)
        objects.append(Object(path_id, start, length, type_id, class_id, index))
    scripts = []
    for _ in range(r.count(8, "scripts") if version >= 11 else 0):
        file_index = r.i32()
        if version >= 14:
            r.align(4, base)
        scripts.append((file_index, r.i64() if version >= 14 else r.i32()))
    externals = []
    for _ in range(r.count(21, "externals")):
        prefix = r.cstring() if version >= 6 else ""
        externals.append((prefix, r.take(16), r.i32(), r.cstring()))
    references = [_type(r, version, trees, True) for _ in range(r.count(4, "reference types"))] if version >= 20 else []
    user = r.cstring()
    stripped = declared is None or not re.match(r"\d+\.\d+", declared) or declared.startswith("0.0")
    return SerializedFile(version, override or (hint if stripped and hint else declared), platform, big, types, objects, scripts, externals, references, user)


# ---------------------------------------------------------------- values
#: The primitive types, by the reader that takes them.
PRIMITIVES = {
    "SInt8": lambda r: int.from_bytes(r.take(1), "big", signed=True), "UInt8": Reader.u8, "char": Reader.u8, "bool": lambda r: bool(r.u8()),
    "short": Reader.i16, "SInt16": Reader.i16, "UInt16": Reader.u16, "unsigned short": Reader.u16,
    "int": Reader.i32, "SInt32": Reader.i32, "UInt32": Reader.u32, "unsigned int": Reader.u32, "Type*": Reader.u32,
    "long long": Reader.i64, "SInt64": Reader.i64, "UInt64": Reader.u64, "unsigned long long": Reader.u64, "FileSize": Reader.u64,
    "float": Reader.f32, "double": Reader.f64,
}


class Tree:
    """A type tree with its nodes' children, to decode values."""

    def __init__(self, nodes: list[Node]):
        if not nodes:
            raise Unsupported("the file has no type tree of this object")
        self.nodes, self.children = nodes, [[] for _ in nodes]
        self._fixed: dict[int, int | None] = {}
        above: list[int] = []
        for i, n in enumerate(nodes):
            del above[n.level :]
            if above:
                self.children[above[-1]].append(i)
            above.append(i)

    def read(self, r: Reader, i: int = 0):
        """The value of a node: records are lists of (name, value), as names may repeat; maps lists of pairs."""
        node, below = self.nodes[i], self.children[i]
        if node.type in PRIMITIVES and not below:
            value = PRIMITIVES[node.type](r)
        elif node.type == "string":
            value = r.take(r.count(1, "string bytes")).decode("utf-8", "replace")
            if below and self.nodes[below[0]].meta_flags & ALIGN:
                r.align(4)
        elif node.type == "TypelessData":
            value = r.take(r.count(1, "bytes"))
        elif node.type_flags & IS_ARRAY or (len(below) == 1 and self.nodes[below[0]].type == "Array"):
            array = i if node.type_flags & IS_ARRAY else below[0]
            value = self._items(r, self.children[array][1])
            if array != i and self.nodes[array].meta_flags & ALIGN:
                r.align(4)
        else:
            value = [(self.nodes[k].name, self.read(r, k)) for k in below]
        if node.meta_flags & ALIGN:
            r.align(4)
        return value

    def fields(self, r: Reader, wanted: set[str]) -> list[tuple[str, object]]:
        """PRJ-04: the wanted fields of the root record; others are passed over without making their values, and
        what follows the last wanted one isn't read."""
        left, out = sum(self.nodes[k].name in wanted for k in self.children[0]), []
        for k in self.children[0]:
            if not left:
                break
            if self.nodes[k].name in wanted:
                out.append((self.nodes[k].name, self.read(r, k)))
                left -= 1
            else:
                self.skip(r, k)
        return out

    def fixed(self, i: int) -> int | None:
        """The bytes that a node always takes, if it does and nothing in it is followed by padding."""
        if i not in self._fixed:
            node, below = self.nodes[i], self.children[i]
            size = None
            if node.type in PRIMITIVES and not below and node.byte_size > 0:
                size = node.byte_size
            elif below and not node.type_flags & IS_ARRAY and node.type not in ("string", "TypelessData") and self.nodes[below[0]].type != "Array":
                parts = [None if self.nodes[k].meta_flags & ALIGN else self.fixed(k) for k in below]
                size = None if None in parts else sum(parts)
            self._fixed[i] = size
        return self._fixed[i]

    def skip(self, r: Reader, i: int) -> None:
        """Pass over a node's value."""
        node, below = self.nodes[i], self.children[i]
        if (size := self.fixed(i)) is not None:
            r.take(size)
        elif node.type == "string":
            r.take(r.count(1, "string bytes"))
            if below and self.nodes[below[0]].meta_flags & ALIGN:
                r.align(4)
        elif node.type == "TypelessData":
            r.take(r.count(1, "bytes"))
        elif node.type_flags & IS_ARRAY or (len(below) == 1 and self.nodes[below[0]].type == "Array"):
            array = i if node.type_flags & IS_ARRAY else below[0]
            element = self.children[array][1]
            n, size = r.count(0, "elements"), self.fixed(element)
            if size is not None and not self.nodes[element].meta_flags & ALIGN:
                r.take(n * size)
            else:
                if n > r.end - r.at and self.nodes[element].byte_size != 0:
                    raise InvalidData(f"{n} elements don't fit")
                for _ in range(n):
                    self.skip(r, element)
            if array != i and self.nodes[array].meta_flags & ALIGN:
                r.align(4)
        elif node.type in PRIMITIVES and not below:
            PRIMITIVES[node.type](r)
        else:
            for k in below:
                self.skip(r, k)
        if node.meta_flags & ALIGN:
            r.align(4)

    def _items(self, r: Reader, element: int):
        n, kind = r.count(0, "elements"), self.nodes[element]
        if kind.type in ("UInt8", "SInt8", "char") and not self.children[element]:
            return r.take(n)
        if n > r.end - r.at and kind.byte_size != 0:
            raise InvalidData(f"{n} elements don't fit")
        return [self.read(r, element) for _ in range(n)]


def decode(data: bytes, big: bool, nodes: list[Node]):
    """PRJ-03: an object's value; all its bytes must be used."""
    r = Reader(data, big=big)
    value = Tree(nodes).read(r)
    if r.at != len(data):
        raise InvalidData(f"{len(data) - r.at} bytes of the object are left")
    return value


def root_field(data: bytes, big: bool, nodes: list[Node], name: str):
    """PRJ-04: one field of the root record."""
    return next((v for _, v in decode_fields(data, big, nodes, {name})), None)


def decode_fields(data: bytes, big: bool, nodes: list[Node], wanted: set[str]) -> list[tuple[str, object]]:
    """PRJ-04: some fields of the root record."""
    return Tree(nodes).fields(Reader(data, big=big), wanted)


def jsonable(value):
    """Records as objects, or as lists of pairs where a name repeats; pairs as key and value."""
    if isinstance(value, list) and value and all(isinstance(x, tuple) for x in value):
        if len({k for k, _ in value}) == len(value):
            return {k: jsonable(v) for k, v in value}
        return [{"name": k, "value": jsonable(v)} for k, v in value]
    if isinstance(value, list):
        return [jsonable(v) for v in value]
    if isinstance(value, bytes):
        return list(value)
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
    return value
