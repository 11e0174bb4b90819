"""Builders of container and serialized-file bytes for the tests."""

import gzip
import io
import lzma
import struct
import zipfile


def text(s, big=False):
    data = s.encode()
    return struct.pack(">i" if big else "<i", len(data)) + data + b"\0" * (-len(data) % 4)


def pptr(file_id, path_id):
    return struct.pack("<iq", file_id, path_id)


def text_asset(name, script):
    return text(name) + struct.pack("<i", len(script)) + script


def game_object(components, name, layer=0):
    return struct.pack("<i", len(components)) + b"".join(pptr(0, c) for c in components) + struct.pack("<I", layer) + text(name)


def transform(owner, father=0, children=()):
    return pptr(0, owner) + struct.pack("<10f", 0, 0, 0, 1, 1, 2, 3, 1, 1, 1) + struct.pack("<i", len(children)) + b"".join(pptr(0, c) for c in children) + pptr(0, father)


def asset_bundle(name, preload, container):
    out = text(name) + struct.pack("<i", len(preload)) + b"".join(pptr(*p) for p in preload) + struct.pack("<i", len(container))
    return out + b"".join(text(key) + struct.pack("<ii", first, size) + pptr(0, 0) for key, first, size in container)


def tree_blob(nodes, version):
    """nodes: (level, type, name, byte size, type flags, meta flags)."""
    names, strings, body = {}, b"", b""
    for level, kind, name, size, flags, meta in nodes:
        offsets = []
        for s in (kind, name):
            if s not in names:
                names[s] = len(strings)
                strings += s.encode() + b"\0"
            offsets.append(names[s])
        body += struct.pack("<HBBIIiii", 1, level, flags, *offsets, size, 0, meta) + (b"\0" * 8 if version >= 19 else b"")
    return struct.pack("<ii", len(nodes), len(strings)) + body + strings


def serialized(objects, version=22, unity="2022.3.62f2", externals=(), trees=None):
    """objects: (path_id, class_id, bytes); trees: nodes by class."""
    classes = list(dict.fromkeys(c for _, c, _ in objects))
    trees = trees or {}
    meta = unity.encode() + b"\0" + struct.pack("<i", 5)
    meta += bytes([bool(trees)]) + struct.pack("<i", len(classes))
    for c in classes:
        meta += struct.pack("<i", c)
        if version >= 16:
            meta += b"\0"
        if version >= 17:
            meta += struct.pack("<h", -1)
        meta += (b"s" * 16 if c == 114 and version >= 16 else b"") + b"h" * 16
        if trees:
            meta += tree_blob(trees.get(c, [(0, "Base", "Base", -1, 0, 0)]), version) + (struct.pack("<i", 0) if version >= 21 else b"")
    if version < 14:
        meta += struct.pack("<i", 0)
    meta += struct.pack("<i", len(objects))
    data, places = b"", []
    for _, _, body in objects:
        data += b"\0" * (-len(data) % 8)
        places.append(len(data))
        data += body
    for (path_id, c, body), at in zip(objects, places):
        if version >= 14:
            meta += b"\0" * (-len(meta) % 4) + struct.pack("<q", path_id)
        else:
            meta += struct.pack("<i", path_id)
        meta += struct.pack("<q" if version >= 22 else "<I", at) + struct.pack("<I", len(body))
        meta += struct.pack("<i", classes.index(c) if version >= 16 else c) + (struct.pack("<H", c) if version < 16 else b"")
        meta += (struct.pack("<h", -1) if 11 <= version < 17 else b"") + (b"\0" if version in (15, 16) else b"")
    meta += struct.pack("<i", 0) + struct.pack("<i", len(externals))
    meta += b"".join(b"\0" + b"g" * 16 + struct.pack("<i", 0) + e.encode() + b"\0" for e in externals)
    if version >= 20:
        meta += struct.pack("<i", 0)
    meta += b"\0"
    head = 48 if version >= 22 else 20
    start = (head + len(meta) + 15) // 16 * 16
    size = start + len(data)
    if version >= 22:
        header = struct.pack(">IIII", 0, 0, version, 0) + b"\0" * 4 + struct.pack(">IQQQ", len(meta), size, start, 0)
    else:
        header = struct.pack(">IIII", len(meta), size, version, start) + b"\0" * 4
    return header + meta + b"\0" * (start - head - len(meta)) + data


def _length(n):
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def lz4(data):
    """An LZ4 block: a run of one byte at the start becomes a match over itself, the rest literals."""
    out, run = b"", len(data) - len(data.lstrip(data[:1])) if data else 0
    if run >= 6 and len(data) - run >= 12:
        match = run - 1 - 4
        out, data = bytes([1 << 4 | min(15, match)]) + data[:1] + b"\1\0" + _length(match), data[run:]
    return out + bytes([min(15, len(data)) << 4]) + _length(len(data)) + data


def lzma_raw(data):
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
    return bytes([2 * 45 + 3]) + struct.pack("<I", 1 << 16) + packed


def unityfs(entries, version=6, codec=0, block=64, at_end=False):
    """entries: (path, bytes); the data is cut in blocks."""
    data = b"".join(d for _, d in entries)
    pack = {0: lambda d: d, 1: lzma_raw, 2: lz4, 3: lz4}[codec]
    blocks = [(len(data[i : i + block]), pack(data[i : i + block])) for i in range(0, len(data), block)]
    info = b"\0" * 16 + struct.pack(">i", len(blocks)) + b"".join(struct.pack(">IIH", n, len(p), codec) for n, p in blocks) + struct.pack(">i", len(entries))
    at = 0
    for path, d in entries:
        info += struct.pack(">qqI", at, len(d), 4) + path.encode() + b"\0"
        at += len(d)
    packed = pack(info)
    head = b"UnityFS\0" + struct.pack(">I", version) + b"5.x.x\0" + b"2022.3.62f2\0"
    flags = codec | 0x40 | (0x80 if at_end else 0)
    length = len(head) + 20
    pad = b"\0" * (-length % 16) if version >= 7 else b""
    stored = b"".join(p for _, p in blocks)
    body = stored + packed if at_end else packed + stored
    return head + struct.pack(">qIII", length + len(pad) + len(body), len(packed), len(info), flags) + pad + body


def unityweb(entries, compressed=True, version=3):
    directory = struct.pack(">i", len(entries))
    at = len(directory) + sum(len(p.encode()) + 9 for p, _ in entries)
    for path, d in entries:
        directory += path.encode() + b"\0" + struct.pack(">II", at, len(d))
        at += len(d)
    payload = directory + b"".join(d for _, d in entries)
    stored = payload
    if compressed:
        raw = lzma_raw(payload)
        stored = raw[:5] + struct.pack("<Q", len(payload)) + raw[5:]
    head = (b"UnityWeb\0" if compressed else b"UnityRaw\0") + struct.pack(">I", version) + b"3.x\0" + b"4.7.2f1\0"
    size = len(head) + 4 * 3 + 4 + 8 + 4 + 4
    return head + struct.pack(">III", 0, size, 1) + struct.pack(">iII", 1, len(stored), len(payload)) + struct.pack(">II", size + len(stored), 0) + stored


def webdata(entries, signature="UnityWebData1.0"):
    head = signature.encode() + b"\0"
    size = len(head) + 4 + sum(12 + len(p.encode()) for p, _ in entries)
    out, at = head + struct.pack("<i", size), size
    for path, d in entries:
        out += struct.pack("<iii", at, len(d), len(path.encode())) + path.encode()
        at += len(d)
    return out + b"".join(d for _, d in entries)


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for path, d in entries:
            z.writestr(path, d)
    return out.getvalue()


def gzipped(data):
    return gzip.compress(data, mtime=0)
