"""Objects of files without type trees: the fixed layouts of common classes (PRJ-07, PRJ-09, PRJ-11, PRJ-12)."""

from __future__ import annotations

from assetlake.sources.binary import Reader, Unsupported

#: Class numbers.
GAME_OBJECT, TRANSFORM, MATERIAL, TEXT_ASSET, MONO_BEHAVIOUR, MONO_SCRIPT, ASSET_BUNDLE, RECT_TRANSFORM = 1, 4, 21, 49, 114, 115, 142, 224
#: Classes whose first field is their name.
NAMED = (21, 28, 43, 48, 49, 74, 83, 90, 91, 128, 142, 150, 152, 187, 213, 221, 329)
CLASS_NAMES = {
    1: "GameObject", 4: "Transform", 21: "Material", 23: "MeshRenderer", 28: "Texture2D", 33: "MeshFilter", 43: "Mesh", 48: "Shader", 49: "TextAsset", 74: "AnimationClip", 83: "AudioClip",
    90: "Avatar", 91: "AnimatorController", 95: "Animator", 111: "Animation", 114: "MonoBehaviour", 115: "MonoScript", 128: "Font", 129: "PlayerSettings", 137: "SkinnedMeshRenderer",
    141: "BuildSettings", 142: "AssetBundle", 147: "ResourceManager", 150: "PreloadData", 152: "MovieTexture", 187: "Texture2DArray", 213: "Sprite", 221: "AnimatorOverrideController",
    224: "RectTransform", 329: "VideoClip", 687078895: "SpriteAtlas",
}


def pptr(r: Reader, version: int) -> list[tuple[str, int]]:
    """A reference: file and path number, the latter of four bytes before format 14."""
    return [("m_FileID", r.i32()), ("m_PathID", r.i64() if version >= 14 else r.i32())]


def _vector(r: Reader, names: str) -> list[tuple[str, float]]:
    return [(n, r.f32()) for n in names]


def _game_object(r: Reader, v: int):
    parts = [[("component", pptr(r, v))] for _ in range(r.count(8, "components"))]
    return [("m_Component", parts), ("m_Layer", r.u32()), ("m_Name", r.string())]


def _transform(r: Reader, v: int):
    head = [("m_GameObject", pptr(r, v)), ("m_LocalRotation", _vector(r, "xyzw")), ("m_LocalPosition", _vector(r, "xyz")), ("m_LocalScale", _vector(r, "xyz"))]
    return [*head, ("m_Children", [pptr(r, v) for _ in range(r.count(8, "children"))]), ("m_Father", pptr(r, v))]


def _text_asset(r: Reader, v: int):
    return [("m_Name", r.string()), ("m_Script", r.take(r.count(1, "script bytes")))]


def _mono_behaviour(r: Reader, v: int):
    owner, enabled = pptr(r, v), r.u8()
    r.align(4)
    return [("m_GameObject", owner), ("m_Enabled", enabled), ("m_Script", pptr(r, v)), ("m_Name", r.string())]


def _asset_bundle(r: Reader, v: int):
    name = r.string()
    preload = [pptr(r, v) for _ in range(r.count(8, "preload references"))]
    container = []
    for _ in range(r.count(16, "container entries")):
        key = r.string()
        container.append([("first", key), ("second", [("preloadIndex", r.i32()), ("preloadSize", r.i32()), ("asset", pptr(r, v))])])
    return [("m_Name", name), ("m_PreloadTable", preload), ("m_Container", container)]


READERS = {GAME_OBJECT: _game_object, TRANSFORM: _transform, RECT_TRANSFORM: _transform, TEXT_ASSET: _text_asset, MONO_BEHAVIOUR: _mono_behaviour, ASSET_BUNDLE: _asset_bundle}


def read(class_id: int, data: bytes, big: bool, version: int):
    """The fields that the class's fixed layout starts with."""
    r = Reader(data, big=big)
    if class_id in READERS:
        return READERS[class_id](r, version)
    if class_id in NAMED:
        return [("m_Name", r.string())]
    raise Unsupported(f"class {class_id} has no type tree and no fixed layout")


def name_of(class_id: int, value) -> str | None:
    """The object's own name, if it has one."""
    fields = dict(value) if isinstance(value, list) and all(isinstance(x, tuple) for x in value) else {}
    name = fields.get("m_Name")
    return name if isinstance(name, str) else None
