"""Bytes of containers, serialized files and objects, from values: what the readers read back."""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import zipfile

import pyarrow as pa


# ---------------------------------------------------------------- objects
def text(s: str) -> bytes:
    data = s.encode()
    return struct.pack("<i", len(data)) + data + b"\0" * (-len(data) % 4)


def pptr(file_id: int, path_id: int) -> bytes:
    return struct.pack("<iq", file_id, path_id)


def text_asset(name: str, script: bytes) -> bytes:
    return text(name) + struct.pack("<i", len(script)) + script


def game_object(components: list[int], name: str, layer: int = 0) -> bytes:
    return struct.pack("<i", len(components)) + b"".join(pptr(0, c) for c in components) + struct.pack("<I", layer) + text(name)


def transform(owner: int, father: int = 0, children: list[int] = ()) -> bytes:
    place = struct.pack("<10f", 0, 0, 0, 1, 0, 0, 0, 1, 1, 1)
    return pptr(0, owner) + place + struct.pack("<i", len(children)) + b"".join(pptr(0, c) for c in children) + pptr(0, father)


def asset_bundle(name: str, preload: list[tuple[int, int]], container: list[tuple[str, int, int]]) -> bytes:
    out = text(name) + struct.pack("<i", len(preload)) + b"".join(pptr(*p) for p in preload) + struct.pack("<i", len(container))
    return out + b"".join(text(key) + struct.pack("<ii", first, size) + pptr(0, 0) for key, first, size in container)


# ---------------------------------------------------------------- serialized files
def tree_blob(nodes: list[tuple[int, str, str, int, int, int]]) -> bytes:
    """A type tree in the layout of format 19 and later; nodes: level, type, name, byte size, type flags, meta flags."""
    at: dict[str, int] = {}
    strings, body = b"", b""
    for level, kind, name, size, flags, meta in nodes:
        for s in (kind, name):
            if s not in at:
                at[s] = len(strings)
                strings += s.encode() + b"\0"
        body += struct.pack("<HBBIIiii", 1, level, flags, at[kind], at[name], size, 0, meta) + b"\0" * 8
    return struct.pack("<ii", len(nodes), len(strings)) + body + strings


def serialized(objects: list[tuple[int, int, bytes]], unity: str = "2022.3.62f2", externals: list[str] = (), trees: dict[int, list] | None = None) -> bytes:
    """A file of format 22; objects: path number, class, bytes; trees: nodes by class."""
    classes, trees = list(dict.fromkeys(c for _, c, _ in objects)), trees or {}
    types = b""
    for c in classes:
        types += struct.pack("<ibh", c, 0, -1) + (b"s" * 16 if c == 114 else b"") + b"h" * 16
        if trees:
            types += tree_blob(trees.get(c, [(0, "Base", "Base", -1, 0, 0)])) + struct.pack("<i", 0)
    data, rows = io.BytesIO(), []
    for path_id, c, body in objects:
        data.write(b"\0" * (-data.tell() % 8))
        rows.append(struct.pack("<qqIi", path_id, data.tell(), len(body), classes.index(c)))
        data.write(body)
    meta = unity.encode() + b"\0" + struct.pack("<ibi", 5, bool(trees), len(classes)) + types + struct.pack("<i", len(objects))
    meta += b"\0" * (-len(meta) % 4) + b"".join(rows)
    meta += struct.pack("<ii", 0, len(externals)) + b"".join(b"\0" + b"g" * 16 + struct.pack("<i", 0) + e.encode() + b"\0" for e in externals)
    meta += struct.pack("<i", 0) + b"\0"
    start = (48 + len(meta) + 15) // 16 * 16
    size = start + data.tell()
    header = struct.pack(">IIII", 0, 0, 22, 0) + b"\0" * 4 + struct.pack(">IQQQ", len(meta), size, start, 0)
    return header + meta + b"\0" * (start - 48 - len(meta)) + data.getvalue()


# ---------------------------------------------------------------- containers
def lzma_raw(data: bytes) -> bytes:
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
    return bytes([2 * 45 + 3]) + struct.pack("<I", 1 << 16) + packed


def lz4(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def bundle(entries: list[tuple[str, bytes]], version: int = 7, codec: int = 3, block: int = 1 << 17) -> bytes:
    """A bundle of the newer layout; codec 0: stored, 1: LZMA, 2 and 3: LZ4."""
    pack = {0: bytes, 1: lzma_raw, 2: lz4, 3: lz4}[codec]
    data = b"".join(d for _, d in entries)
    blocks = [(len(part), pack(part)) for part in (data[i : i + block] for i in range(0, len(data), block))]
    info = b"\0" * 16 + struct.pack(">i", len(blocks)) + b"".join(struct.pack(">IIH", n, len(p), codec) for n, p in blocks) + struct.pack(">i", len(entries))
    at = 0
    for path, d in entries:
        info += struct.pack(">qqI", at, len(d), 4) + path.encode() + b"\0"
        at += len(d)
    packed = pack(info)
    head = b"UnityFS\0" + struct.pack(">I", version) + b"5.x.x\0" + b"2022.3.62f2\0"
    pad = b"\0" * (-(len(head) + 20) % 16) if version >= 7 else b""
    body = packed + b"".join(p for _, p in blocks)
    return head + struct.pack(">qIII", len(head) + 20 + len(pad) + len(body), len(packed), len(info), codec | 0x40) + pad + body


def old_bundle(entries: list[tuple[str, bytes]], compressed: bool = True) -> bytes:
    """A bundle of the older layout, as one LZMA stream or stored."""
    at = 4 + sum(len(p.encode()) + 9 for p, _ in entries)
    directory = struct.pack(">i", len(entries))
    for path, d in entries:
        directory += path.encode() + b"\0" + struct.pack(">II", at, len(d))
        at += len(d)
    payload = stored = directory + b"".join(d for _, d in entries)
    if compressed:
        raw = lzma_raw(payload)
        stored = raw[:5] + struct.pack("<Q", len(payload)) + raw[5:]
    head = (b"UnityWeb\0" if compressed else b"UnityRaw\0") + struct.pack(">I", 3) + b"3.x\0" + b"4.7.2f1\0"
    size = len(head) + 32
    return head + struct.pack(">IIIiIIII", 0, size, 1, 1, len(stored), len(payload), size + len(stored), 0) + stored


def web(entries: list[tuple[str, bytes]], signature: str = "UnityWebData1.0") -> bytes:
    head = signature.encode() + b"\0"
    at = size = len(head) + 4 + sum(12 + len(p.encode()) for p, _ in entries)
    out = head + struct.pack("<i", size)
    for path, d in entries:
        out += struct.pack("<iii", at, len(d), len(path.encode())) + path.encode()
        at += len(d)
    return out + b"".join(d for _, d in entries)


def zipped(entries: list[tuple[str, bytes]], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for path, d in entries:
            z.writestr(zipfile.ZipInfo(path), d, method)
    return out.getvalue()


def gzipped(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


def sound_bank(samples: list[tuple[int, int, bytes]], codec: int = 2) -> bytes:
    """An FSB5 bank; samples: rate number, channels (1 or 2), data; frames of two bytes a channel."""
    heads, body = b"", b""
    for rate, channels, data in samples:
        body += b"\0" * (-len(body) % 32)
        frames = len(data) // (2 * channels)
        heads += struct.pack("<Q", rate << 1 | (channels - 1) << 5 | (len(body) // 32) << 7 | frames << 34)
        body += data
    return b"FSB5" + struct.pack("<6I", 1, len(samples), len(heads), 0, len(body), codec) + b"\0" * 32 + heads + body
