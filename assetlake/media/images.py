"""Images (MED-01, MED-02, MED-06 to MED-10): pixel formats and blocks to RGBA, and image files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from assetlake.functions.packed import half, rgb9e5
from assetlake.sources.binary import InvalidData, Unsupported

#: Linear formats by number: name and bytes a pixel.
LINEAR = {
    1: ("Alpha8", 1), 2: ("ARGB4444", 2), 3: ("RGB24", 3), 4: ("RGBA32", 4), 5: ("ARGB32", 4), 7: ("RGB565", 2), 9: ("R16", 2), 13: ("RGBA4444", 2), 14: ("BGRA32", 4), 15: ("RHalf", 2), 16: ("RGHalf", 4),
    17: ("RGBAHalf", 8), 18: ("RFloat", 4), 19: ("RGFloat", 8), 20: ("RGBAFloat", 16), 21: ("YUY2", 2), 22: ("RGB9e5Float", 4), 62: ("RG16", 2), 63: ("R8", 1), 72: ("RG32", 4), 73: ("RGB48", 6), 74: ("RGBA64", 8),
}
#: Block formats by number: name and bytes a block of 4 x 4.
BLOCKS = {10: ("DXT1", 8), 12: ("DXT5", 16), 26: ("BC4", 8), 27: ("BC5", 16), 11: ("DXT3", 16)}


def _byte(x: np.ndarray) -> np.ndarray:
    """Floats in 0 to 1 as bytes; what isn't a number is 0."""
    return np.floor(np.clip(np.nan_to_num(x, nan=0.0), 0, 1) * 255 + 0.5).astype(np.uint8)


def _rgba(r, g=None, b=None, a=None) -> np.ndarray:
    zero, full = np.zeros(len(r), np.uint8), np.full(len(r), 255, np.uint8)
    return np.stack([r, zero if g is None else g, zero if b is None else b, full if a is None else a], axis=1).astype(np.uint8)


def _widen(v: np.ndarray, bits: int) -> np.ndarray:
    return (v.astype(np.uint32) << (8 - bits)) | (v.astype(np.uint32) >> (2 * bits - 8))


def linear(kind: str, data: bytes) -> np.ndarray:
    """MED-01: (pixels, 4) bytes."""
    u8 = lambda n: np.frombuffer(data, np.uint8).reshape(-1, n)
    u16 = lambda n: np.frombuffer(data, "<u2").reshape(-1, n)
    if kind == "Alpha8":
        v = u8(1)[:, 0]
        full = np.full(len(v), 255, np.uint8)
        return _rgba(full, full, full, v)
    if kind == "R8":
        return _rgba(u8(1)[:, 0])
    if kind == "RGB24":
        return _rgba(*u8(3).T)
    if kind == "RGBA32":
        return u8(4).copy()
    if kind == "ARGB32":
        return u8(4)[:, [1, 2, 3, 0]]
    if kind == "BGRA32":
        return u8(4)[:, [2, 1, 0, 3]]
    if kind == "RG16":
        return _rgba(*u8(2).T)
    if kind in ("ARGB4444", "RGBA4444"):
        v = u16(1)[:, 0]
        parts = [_widen((v >> s) & 15, 4) for s in (12, 8, 4, 0)]
        return _rgba(*(parts[1:] + parts[:1] if kind == "ARGB4444" else parts))
    if kind == "RGB565":
        v = u16(1)[:, 0]
        return _rgba(_widen(v >> 11, 5), _widen((v >> 5) & 63, 6), _widen(v & 31, 5))
    if kind in ("R16", "RG32", "RGB48", "RGBA64"):
        v = (u16({"R16": 1, "RG32": 2, "RGB48": 3, "RGBA64": 4}[kind]).astype(np.uint32) * 255 + 32895) >> 16
        return _rgba(*v.T)
    if kind in ("RHalf", "RGHalf", "RGBAHalf"):
        return _rgba(*_byte(half(data).reshape(-1, {"RHalf": 1, "RGHalf": 2, "RGBAHalf": 4}[kind])).T)
    if kind in ("RFloat", "RGFloat", "RGBAFloat"):
        return _rgba(*_byte(np.frombuffer(data, "<f4").reshape(-1, {"RFloat": 1, "RGFloat": 2, "RGBAFloat": 4}[kind])).T)
    if kind == "RGB9e5Float":
        return _rgba(*_byte(rgb9e5(data)).T)
    if kind == "YUY2":
        v = u8(4).astype(np.int32)
        y, u, w = v[:, [0, 2]].reshape(-1) - 16, np.repeat(v[:, 1], 2) - 128, np.repeat(v[:, 3], 2) - 128
        parts = ((298 * y + 409 * w + 128) >> 8, (298 * y - 100 * u - 208 * w + 128) >> 8, (298 * y + 516 * u + 128) >> 8)
        return _rgba(*(np.clip(p, 0, 255) for p in parts))
    raise Unsupported(f"pixel format {kind}")


def _colors(words: np.ndarray, opaque: bool) -> np.ndarray:
    """Sixteen colours of each DXT1 block: (blocks, 16, 4)."""
    c = words[:, :2].astype(np.int32)
    ends = np.stack([_widen(c >> 11, 5), _widen((c >> 5) & 63, 6), _widen(c & 31, 5)], axis=2).astype(np.int32)
    a, b = ends[:, 0], ends[:, 1]
    four = (c[:, 0] > c[:, 1])[:, None] | opaque
    third, fourth = np.where(four, (2 * a + b) // 3, (a + b) // 2), np.where(four, (a + 2 * b) // 3, 0)
    palette = np.concatenate([np.stack([a, b, third, fourth], axis=1), np.full((len(words), 4, 1), 255)], axis=2)
    palette[:, 3, 3] = np.where(four[:, 0], 255, 0)
    bits = words[:, 2].astype(np.uint32) | words[:, 3].astype(np.uint32) << 16
    index = (bits[:, None] >> (2 * np.arange(16, dtype=np.uint32))) & 3
    return np.take_along_axis(palette, index[:, :, None].astype(np.int64), axis=1).astype(np.uint8)


def _ramp(block: np.ndarray) -> np.ndarray:
    """Sixteen values of each eight-byte ramp block: (blocks, 16)."""
    a, b = block[:, 0].astype(np.int32), block[:, 1].astype(np.int32)
    eight = a > b
    steps = [np.where(eight, ((7 - i) * a + i * b) // 7, ((5 - i) * a + i * b) // 5 if i < 5 else (0 if i == 5 else 255)) for i in range(1, 7)]
    palette = np.stack([a, b, *steps], axis=1)
    bits = sum(block[:, 2 + i].astype(np.uint64) << np.uint64(8 * i) for i in range(6))
    index = (bits[:, None] >> (3 * np.arange(16, dtype=np.uint64))) & np.uint64(7)
    return np.take_along_axis(palette, index.astype(np.int64), axis=1).astype(np.uint8)


def blocks(kind: str, data: bytes, width: int, height: int) -> np.ndarray:
    """MED-02: (height, width, 4) bytes of 4 x 4 blocks."""
    across, down = (width + 3) // 4, (height + 3) // 4
    size = next(n for name, n in BLOCKS.values() if name == kind)
    raw = np.frombuffer(data, np.uint8)[: across * down * size].reshape(-1, size)
    words = lambda part: np.ascontiguousarray(part).view("<u2")
    if kind == "DXT1":
        pixels = _colors(words(raw), False)
    elif kind in ("DXT3", "DXT5"):
        pixels = _colors(words(raw[:, 8:]), True)
        nibbles = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], axis=2).reshape(-1, 16)
        pixels[:, :, 3] = _ramp(raw[:, :8]) if kind == "DXT5" else nibbles * 17
    else:
        pixels = np.zeros((len(raw), 16, 4), np.uint8)
        pixels[:, :, 3] = 255
        for k in range(size // 8):
            pixels[:, :, k] = _ramp(raw[:, 8 * k : 8 * k + 8])
    grid = pixels.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
    return grid[:height, :width]


def decode(number: int, data: bytes, width: int, height: int) -> np.ndarray:
    """(height, width, 4) bytes of a texture's first level, as it is stored (bottom row first)."""
    if number in LINEAR:
        kind, size = LINEAR[number]
        if len(data) < width * height * size:
            raise InvalidData(f"{kind}: {width * height * size} bytes wanted, {len(data)} given")
        return linear(kind, data[: width * height * size]).reshape(height, width, 4)
    if number in BLOCKS:
        kind, size = BLOCKS[number]
        need = ((width + 3) // 4) * ((height + 3) // 4) * size
        if len(data) < need:
            raise InvalidData(f"{kind}: {need} bytes wanted, {len(data)} given")
        return blocks(kind, data, width, height)
    raise Unsupported(f"texture format {number}")


def mips(number: int, width: int, height: int, levels: int) -> list[tuple[int, int, int, int]]:
    """MED-07: (offset, bytes, width, height) of each level."""
    out, at = [], 0
    for _ in range(levels):
        if number in LINEAR:
            size = width * height * LINEAR[number][1]
        elif number in BLOCKS:
            size = ((width + 3) // 4) * ((height + 3) // 4) * BLOCKS[number][1]
        else:
            raise Unsupported(f"texture format {number}")
        out.append((at, size, width, height))
        at, width, height = at + size, max(1, width // 2), max(1, height // 2)
    return out


def swap_pairs(data: bytes) -> bytes:
    """MED-06: bytes of 16-bit words exchanged."""
    return np.frombuffer(data, "<u2").byteswap().tobytes()


def sprite(page: np.ndarray, x: int, y: int, width: int, height: int, turn: str = "none") -> np.ndarray:
    """MED-08: a sprite's rectangle, counted from the page's lower left, put upright."""
    if x < 0 or y < 0 or x + width > page.shape[1] or y + height > page.shape[0]:
        raise InvalidData("a sprite reaches beyond its page")
    part = page[page.shape[0] - y - height : page.shape[0] - y, x : x + width]
    turns = {"none": lambda p: p, "flip_horizontal": lambda p: p[:, ::-1], "flip_vertical": lambda p: p[::-1], "rotate_180": lambda p: p[::-1, ::-1], "rotate_90": lambda p: np.rot90(p, 1)}
    if turn not in turns:
        raise Unsupported(f"turn {turn}")
    return np.ascontiguousarray(turns[turn](part))


def merge_alpha(image: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """MED-08: alpha from the mean of another image's colours."""
    out = image.copy()
    out[..., 3] = alpha[..., :3].astype(np.uint16).sum(axis=-1) // 3
    return out


def composite(image: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """MED-10: over a background, rounded."""
    c, a = image[..., :3].astype(np.uint32), image[..., 3:].astype(np.uint32)
    out = (c * a + np.array(background, np.uint32) * (255 - a) + 127) // 255
    return np.concatenate([out.astype(np.uint8), np.full_like(image[..., 3:], 255)], axis=-1)


# ---------------------------------------------------------------- files
def png(image: np.ndarray, level: int = 6) -> bytes:
    """MED-09, WIN-07: each row by the filter whose bytes have the least sum, the first of equal ones."""
    height, width = image.shape[:2]
    rows = image.reshape(height, width * 4)
    above = np.zeros(width * 4, np.uint8)
    out = bytearray()
    for row in rows:
        left, corner = np.r_[np.zeros(4, np.uint8), row[:-4]], np.r_[np.zeros(4, np.uint8), above[:-4]]
        a, b, c = (v.astype(np.int16) for v in (left, above, corner))
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        tried = [row, row - left, row - above, (row - ((a + b) >> 1)).astype(np.uint8), (row - paeth).astype(np.uint8)]
        sums = [int(np.abs(t.view(np.int8).astype(np.int16)).sum()) for t in tried]
        best = sums.index(min(sums))
        out += bytes([best]) + tried[best].tobytes()
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(out), level)) + chunk(b"IEND", b"")


def bmp(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    pixels = image[::-1, :, [2, 1, 0, 3]].tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 32, 0, len(pixels), 2835, 2835, 0, 0) + pixels


def tga(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, width, height, 32, 0x28) + image[:, :, [2, 1, 0, 3]].tobytes()


def qoi(image: np.ndarray) -> bytes:
    """The Quite OK Image format."""
    height, width = image.shape[:2]
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", width, height, 4, 0)), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    flat = list(map(tuple, image.reshape(-1, 4).tolist()))
    for i, p in enumerate(flat):
        if p == last:
            run += 1
            if run == 62 or i == len(flat) - 1:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        if seen[slot] == p:
            out.append(slot)
        else:
            seen[slot] = p
            r, g, b = ((x - y + 128) % 256 - 128 for x, y in zip(p[:3], last[:3]))
            if p[3] != last[3]:
                out += bytes((0xFF, *p))
            elif -2 <= r <= 1 and -2 <= g <= 1 and -2 <= b <= 1:
                out.append(0x40 | r + 2 << 4 | g + 2 << 2 | b + 2)
            elif -32 <= g <= 31 and -8 <= r - g <= 7 and -8 <= b - g <= 7:
                out += bytes((0x80 | g + 32, r - g + 8 << 4 | b - g + 8))
            else:
                out += bytes((0xFE, *p[:3]))
        last = p
    return bytes(out + b"\0" * 7 + b"\1")


ENCODERS = {"png": png, "bmp": bmp, "tga": tga, "qoi": qoi, "raw": lambda image: image.tobytes()}


def encode(image: np.ndarray, kind: str) -> bytes:
    if kind not in ENCODERS:
        raise Unsupported(f"image files of kind {kind}")
    return ENCODERS[kind](image)
