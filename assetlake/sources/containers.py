"""Containers (SRC-05 to SRC-15): detection, block codecs and expansion into entries."""

from __future__ import annotations

import gzip
import io
import lzma
import re
import struct
import zipfile
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from assetlake.sources.binary import Budget, InvalidData, Reader, Unsupported

#: What starts a file of each kind.
BUNDLE_SIGNATURES = ("UnityWeb", "UnityRaw", "UnityArchive", "UnityFS")
WEB_SIGNATURES = ("UnityWebData1.0", "TuanjieWebData1.0")
GZIP, ZIPS, BROTLI = b"\x1f\x8b", (b"PK\x03\x04", b"PK\x07\x08"), b"\x62\x72\x6f\x74\x6c\x69"


@dataclass(frozen=True)
class Limits:
    """Budgets of one expansion."""

    depth: int = 32
    entries: int = 1_000_000
    bytes: int = 16 << 30
    path_bytes: int = 64 << 20


def serialized_header(data: bytes) -> tuple[int, int, int, int, int] | None:
    """(version, metadata size, file size, data offset, header size) if the bytes are a plausible serialized file."""
    if len(data) < 20:
        return None
    metadata, size, version, offset = struct.unpack_from(">IIII", data)
    header = 20
    if version < 9:
        header = 16
    if version >= 22:
        if len(data) < 48:
            return None
        metadata, size, offset = struct.unpack_from(">IQQ", data, 20)
        header = 48
    if not 5 <= version <= 100 or size != len(data) or metadata > size or not header <= offset <= size:
        return None
    if (version >= 9 and header + metadata > offset) or (version < 9 and not max(header, offset) <= size - metadata):
        return None
    return version, metadata, size, offset, header


def embedded_bundle(data: bytes, scan: int = 4096) -> int | None:
    """Where a bundle starts inside other bytes, if it is one by its header."""
    at = data.find(b"UnityFS\0", 1, scan)
    while at > 0:
        try:
            r = Reader(data, at + 8)
            version = r.u32()
            r.cstring()
            r.cstring()
            size = r.i64()
            if version in (6, 7) and r.at + 12 - at <= size <= len(data) - at:
                return at
        except InvalidData:
            pass
        at = data.find(b"UnityFS\0", at + 1, scan)
    return None


def detect(data: bytes) -> tuple[str, int]:
    """SRC-07: (kind, offset) in the order of priority."""
    name = data[:20].split(b"\0")[0].decode("utf-8", "replace")
    if name in BUNDLE_SIGNATURES:
        return "bundle", 0
    if name in WEB_SIGNATURES:
        return "web", 0
    if data.startswith(GZIP):
        return "gzip", 0
    if data[32:38] == BROTLI:
        return "brotli", 0
    if serialized_header(data):
        return "serialized", 0
    if data.startswith(ZIPS):
        return "zip", 0
    at = embedded_bundle(data)
    return ("bundle", at) if at is not None else ("resource", 0)


# ---------------------------------------------------------------- block codecs
def lz4_block(data: bytes, size: int) -> bytes:
    """An LZ4 block of a known decoded size."""
    if not size:
        if data not in (b"", b"\0"):
            raise InvalidData("an LZ4 block gave more than no bytes")
        return b""
    try:
        out = pa.Codec("lz4_raw").decompress(data, size, asbytes=True)
    except (OSError, ValueError) as e:
        raise InvalidData(f"LZ4: {e}") from e
    if len(out) != size:
        raise InvalidData(f"an LZ4 block gave {len(out)} bytes, not {size}")
    return out


def lzma_block(data: bytes, size: int) -> bytes:
    """LZMA with its five property bytes and without a length."""
    if len(data) < 5:
        raise InvalidData("LZMA properties are cut off")
    rest, dictionary = data[0], struct.unpack_from("<I", data, 1)[0]
    if rest >= 9 * 5 * 5:
        raise InvalidData("LZMA properties are out of range")
    options = {"id": lzma.FILTER_LZMA1, "dict_size": max(dictionary, 4096), "lc": rest % 9, "lp": rest // 9 % 5, "pb": rest // 45}
    try:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[options]).decompress(data[5:], size)
    except lzma.LZMAError as e:
        raise InvalidData(f"LZMA: {e}") from e
    if len(out) != size:
        raise InvalidData(f"an LZMA block gave {len(out)} bytes, not {size}")
    return out


def zstd_block(data: bytes, size: int) -> bytes:
    import zstandard

    try:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    except zstandard.ZstdError as e:
        raise InvalidData(f"zstd: {e}") from e
    if len(out) != size:
        raise InvalidData(f"a zstd block gave {len(out)} bytes, not {size}")
    return out


def decode_block(kind: int, data: bytes, size: int, oodle: Callable[[bytes, int], bytes] | None = None) -> bytes:
    """A storage block by its codec number; other decoders can be given (UDF-01)."""
    if kind == 0:
        if len(data) != size:
            raise InvalidData("a stored block has another size")
        return data
    if kind == 1:
        return lzma_block(data, size)
    if kind in (2, 3):
        return lz4_block(data, size)
    if kind == 5:
        return zstd_block(data, size)
    if kind == 6 and oodle:
        out = oodle(data, size)
        if len(out) != size:
            raise InvalidData("the decoder gave another size")
        return out
    raise Unsupported(f"block codec {kind}")


# ---------------------------------------------------------------- containers
@dataclass
class Bundle:
    """A bundle's header, its blocks and where its entries lie in the decoded data."""

    version: int
    revision: str
    blocks: list[tuple[int, int, int]]  # decoded size, stored size, flags
    entries: list[tuple[str, int, int, int]]  # path, offset, size, flags
    data: bytes  # stored blocks
    oodle: Callable | None = None
    last: tuple[int, bytes] = field(default=(-1, b""), repr=False)  # the block decoded last: entries follow each other

    def block(self, number: int, start: int) -> bytes:
        if self.last[0] != number:
            decoded, packed, flags = self.blocks[number]
            self.last = number, decode_block(flags & 0x3F, self.data[start : start + packed], decoded, self.oodle)
        return self.last[1]

    def entry(self, index: int) -> bytes:
        """SRC-09: only the blocks that overlap the entry are decoded."""
        _, offset, size, _ = self.entries[index]
        out, raw, stored = [], 0, 0
        for number, (decoded, packed, _) in enumerate(self.blocks):
            if raw < offset + size and raw + decoded > offset:
                out.append(self.block(number, stored)[max(0, offset - raw) : offset + size - raw])
            raw, stored = raw + decoded, stored + packed
        content = b"".join(out)
        if len(content) != size:
            raise InvalidData(f"entry {index} reaches beyond the blocks")
        return content


def open_bundle(data: bytes, oodle: Callable | None = None) -> Bundle:
    """SRC-08, SRC-10: bundles of both layouts."""
    r = Reader(data)
    signature, version = r.cstring(20), r.u32()
    r.cstring()
    revision = r.cstring()
    if signature in ("UnityWeb", "UnityRaw") and version < 6:
        return _legacy_bundle(data, r, signature, version, revision)
    if signature == "UnityArchive" or version not in (6, 7, 8):
        raise Unsupported(f"{signature} version {version}")
    size, stored_info, info_size, flags = r.i64(), r.u32(), r.u32(), r.u32()
    if size > len(data):
        raise InvalidData("the bundle is cut off")
    if version >= 7:
        r.align(16)
    if flags & 0x80:  # the directory stands at the end
        info = data[size - stored_info : size]
    else:
        info = r.take(stored_info)
    if flags & 0x200:
        r.align(16)
    i = Reader(decode_block(flags & 0x3F, info, info_size, oodle))
    i.take(16)
    blocks = [(i.u32(), i.u32(), i.u16()) for _ in range(i.count(10, "blocks"))]
    entries = []
    for _ in range(i.count(21, "entries")):
        offset, length, mark = i.i64(), i.i64(), i.u32()
        entries.append((i.cstring(), offset, length, mark))
    total = sum(b[0] for b in blocks)
    if any(o < 0 or n < 0 or o + n > total for _, o, n, _ in entries):
        raise InvalidData("an entry lies outside the data")
    return Bundle(version, revision, blocks, entries, data[r.at : size], oodle)


def _legacy_bundle(data: bytes, r: Reader, signature: str, version: int, revision: str) -> Bundle:
    if version >= 4:
        r.take(20)
    r.u32()
    header = r.u32()
    r.u32()
    levels = [(r.u32(), r.u32()) for _ in range(r.count(8, "levels"))]
    if not levels or header > len(data):
        raise InvalidData("a bundle without levels")
    packed, size = levels[-1]
    payload = data[header : header + packed]
    if signature == "UnityWeb":
        if len(payload) < 13:
            raise InvalidData("the bundle is cut off")
        payload = lzma_block(payload[:5] + payload[13:], size)  # the length of the stream format is left out
    d = Reader(payload)
    entries = []
    for _ in range(d.count(9, "entries")):
        name = d.cstring()
        entries.append((name, d.u32(), d.u32(), 0))
    if any(o + n > len(payload) for _, o, n, _ in entries):
        raise InvalidData("an entry lies outside the data")
    return Bundle(version, revision, [(len(payload), len(payload), 0)], entries, payload)


def web_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """SRC-11: a directory of names and ranges, in little-endian order."""
    r = Reader(data, big=False)
    r.cstring(20)
    end = r.i32()
    while r.at < end:
        offset, size = r.i32(), r.i32()
        name = r.take(r.count(1, "name bytes")).decode("utf-8", "replace")
        if offset < 0 or size < 0 or offset + size > len(data):
            raise InvalidData("an entry lies outside the file")
        yield name, data[offset : offset + size]


def gunzip(data: bytes, most: int) -> bytes:
    """SRC-12: one whole stream of bounded size."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read(most + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise InvalidData(f"gzip: {e}") from e
    if len(out) > most:
        raise InvalidData(f"gzip: more than {most} bytes")
    return out


def unbrotli(data: bytes, most: int) -> bytes:
    """SRC-13: one whole stream of bounded size."""
    try:
        with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as f:
            out = f.read(most + 1)
    except (OSError, ValueError) as e:
        raise InvalidData(f"brotli: {e}") from e
    if len(out) > most:
        raise InvalidData(f"brotli: more than {most} bytes")
    return out


def zip_entries(data: bytes, most: int) -> Iterator[tuple[str, bytes]]:
    """SRC-14: stored and deflated files; unsafe paths are invalid, encryption and links unsupported."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise InvalidData(f"zip: {e}") from e
    ranges = []
    for info in archive.infolist():
        if info.is_dir():
            continue
        name = info.filename.replace("\\", "/")
        if name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
            raise InvalidData(f"zip: unsafe path {name}")
        if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or (info.external_attr >> 28) == 0xA:
            raise Unsupported(f"zip: {name} is encrypted, a link or of another method")
        ranges.append((info.header_offset, info.header_offset + 30 + info.compress_size))
        if info.file_size > most:
            raise InvalidData(f"zip: {name} is larger than {most} bytes")
    ranges.sort()
    if any(b[0] < a[1] for a, b in zip(ranges, ranges[1:])):
        raise InvalidData("zip: records overlap")
    for info in archive.infolist():
        if not info.is_dir():
            try:
                content = archive.read(info)
            except (zipfile.BadZipFile, zlib.error, EOFError) as e:
                raise InvalidData(f"zip: {e}") from e
            yield info.filename.replace("\\", "/"), content


@dataclass
class Item:
    """What an expansion finds: serialized files and resources, in breadth-first order."""

    label: str
    kind: str
    content: bytes
    depth: int
    revision: str | None


def expand(label: str, content: bytes, limits: Limits = Limits(), oodle: Callable | None = None) -> Iterator[Item]:
    """SRC-15: detect, expand and go on with the children, first come first served."""
    entries, size, names = Budget("entries", limits.entries), Budget("decoded bytes", limits.bytes), Budget("path bytes", limits.path_bytes)
    queue = deque([(label, content, 0, None)])
    while queue:
        label, content, depth, revision = queue.popleft()
        if depth > limits.depth:
            raise InvalidData(f"deeper than {limits.depth} containers")
        kind, at = detect(content)
        children: list[tuple[str, bytes, str | None]] = []
        if kind == "bundle":
            bundle = open_bundle(content[at:], oodle)
            children = [(e[0], bundle.entry(i), bundle.revision) for i, e in enumerate(bundle.entries)]
        elif kind == "web":
            children = [(name, data, revision) for name, data in web_entries(content)]
        elif kind == "zip":
            children = [(name, data, revision) for name, data in zip_entries(content, limits.bytes - size.used)]
        elif kind == "gzip":
            children = [("", gunzip(content, limits.bytes - size.used), revision)]
        elif kind == "brotli":
            children = [("", unbrotli(content, limits.bytes - size.used), revision)]
        else:
            yield Item(label, kind, content, depth, revision)
        for name, data, rev in children:
            name = name.replace("\\", "/")
            entries.charge(1)
            size.charge(len(data))
            names.charge(len(name.encode()))
            queue.append((f"{label}::{name}" if name else label, data, depth + 1, rev))
