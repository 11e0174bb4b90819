"""Sound banks (MED-11, MED-12, MED-15, NUM-16, WIN-08): parsing, PCM and IMA ADPCM to WAV."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from assetlake.sources.binary import InvalidData, Unsupported

#: Rates by number, and codecs by number.
RATES = {1: 8000, 2: 11000, 3: 11025, 4: 16000, 5: 22050, 6: 24000, 7: 32000, 8: 44100, 9: 48000}
CODECS = {1: "pcm8", 2: "pcm16", 3: "pcm24", 4: "pcm32", 5: "float", 6: "dsp", 7: "ima", 8: "vag", 9: "hevag", 10: "xma", 11: "mpeg", 12: "celt", 13: "at9", 14: "xwma", 15: "vorbis", 16: "fadpcm", 17: "opus"}
CHANNELS = {0: 1, 1: 2, 2: 6, 3: 8}
#: The step sizes and index changes of IMA ADPCM.
STEPS = np.array((
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658,
    724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500,
    20350, 22385, 24623, 27086, 29794, 32767,
))
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


@dataclass
class Sample:
    codec: str
    rate: int
    channels: int
    frames: int
    data: bytes


def parse_bank(data: bytes) -> list[Sample]:
    """The samples of an FSB5 bank."""
    if len(data) < 60 or data[:4] != b"FSB5":
        raise InvalidData("not an FSB5 bank")
    version, count, heads, names, size, mode = struct.unpack_from("<6I", data, 4)
    at = 0x40 if version == 0 else 0x3C
    if mode not in CODECS or at + heads + names + size > len(data) or heads < 8 * count:
        raise InvalidData("an FSB5 header is out of bounds")
    base, found = at + heads + names, []
    for _ in range(count):
        if at + 8 > base:
            raise InvalidData("an FSB5 sample header is cut off")
        bits = struct.unpack_from("<Q", data, at)[0]
        at += 8
        more, rate, channels, offset, frames = bits & 1, RATES.get(bits >> 1 & 15), CHANNELS[bits >> 5 & 3], (bits >> 7 & (1 << 27) - 1) * 32, bits >> 34
        while more:
            if at + 4 > base:
                raise InvalidData("an FSB5 chunk is cut off")
            chunk = struct.unpack_from("<I", data, at)[0]
            at += 4
            more, length, kind = chunk & 1, chunk >> 1 & (1 << 24) - 1, chunk >> 25
            if at + length > base:
                raise InvalidData("an FSB5 chunk is out of bounds")
            if kind == 1:
                channels = data[at]
            elif kind == 2:
                rate = struct.unpack_from("<I", data, at)[0]
            at += length
        if not rate or not channels:
            raise InvalidData("an FSB5 sample without rate or channels")
        found.append((rate, channels, offset, frames))
    out = []
    for i, (rate, channels, offset, frames) in enumerate(found):
        end = found[i + 1][2] if i + 1 < len(found) else size
        if not offset <= end <= size:
            raise InvalidData("an FSB5 sample lies outside the bank")
        out.append(Sample(CODECS[mode], rate, channels, frames, data[base + offset : base + end]))
    return out


def ima(data: bytes, channels: int, frames: int) -> np.ndarray:
    """(frames, channels) of blocks of 36 bytes a channel: a start value, its step, 64 nibbles.

    Channels are interleaved in words of four bytes; a sample depends on the one before.
    """
    blocks = -(-frames // 64)
    if len(data) < blocks * 36 * channels:
        raise InvalidData("IMA data is cut off")
    out = np.zeros((blocks * 64, channels), np.int16)
    for b in range(blocks):
        block = data[b * 36 * channels : (b + 1) * 36 * channels]
        for c in range(channels):
            value, index = struct.unpack_from("<hB", block, 4 * c)
            index = min(index, 88)
            for k in range(64):
                byte = block[4 * channels + (k // 8) * 4 * channels + 4 * c + (k % 8) // 2]
                nibble = byte >> 4 if k % 2 else byte & 15
                step = int(STEPS[index])
                change = (step >> 3) + (step >> 2 if nibble & 1 else 0) + (step >> 1 if nibble & 2 else 0) + (step if nibble & 4 else 0)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + CHANGES[nibble & 7]))
                out[b * 64 + k, c] = value
    return out[:frames]


def float_to_pcm16(x: np.ndarray) -> np.ndarray:
    """NUM-16: clamped and rounded; what isn't a number is 0."""
    return np.rint(np.clip(np.nan_to_num(x, nan=0.0), -1, 1) * 32767).astype(np.int16)


def wav(pcm: bytes, channels: int, rate: int, bits: int, floats: bool = False) -> bytes:
    frame = channels * bits // 8
    head = struct.pack("<HHIIHH", 3 if floats else 1, channels, rate, rate * frame, frame, bits)
    pad = b"\0" * (len(pcm) % 2)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(head) + 8 + len(pcm) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(pcm)) + pcm + pad


def to_wav(data: bytes) -> bytes:
    """MED-15: a WAV as it is; the first sample of a bank decoded."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return data
    sample = parse_bank(data)[0]
    widths = {"pcm8": 8, "pcm16": 16, "pcm24": 24, "pcm32": 32, "float": 32}
    if sample.codec in widths:
        bits = widths[sample.codec]
        need = sample.frames * sample.channels * bits // 8
        if need > len(sample.data):
            raise InvalidData("PCM data is cut off")
        return wav(sample.data[:need], sample.channels, sample.rate, bits, sample.codec == "float")
    if sample.codec == "ima":
        return wav(ima(sample.data, sample.channels, sample.frames).tobytes(), sample.channels, sample.rate, 16)
    raise Unsupported(f"sound codec {sample.codec}")
