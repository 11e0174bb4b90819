"""Reading binary values, budgets and the three families of errors (SRC-19, ERR-01, ERR-03)."""

from __future__ import annotations

import struct


class AssetError(Exception):
    """An error with a family: io, invalid_data or unsupported."""

    family = "io"


class InvalidData(AssetError):
    family = "invalid_data"


class Unsupported(AssetError):
    family = "unsupported"


class Budget:
    """A running total with a limit: reaching it passes, one more fails."""

    def __init__(self, name: str, limit: int):
        self.name, self.limit, self.used = name, limit, 0

    def charge(self, amount: int) -> None:
        if self.used + amount > self.limit:
            raise InvalidData(f"{self.name}: {self.used + amount} is above the limit of {self.limit}")
        self.used += amount


class Reader:
    """A cursor over bytes with a byte order."""

    def __init__(self, data: bytes, at: int = 0, big: bool = True, end: int | None = None):
        self.data, self.at, self.big, self.end = data, at, big, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise InvalidData(f"{n} bytes wanted at {self.at}, {self.end - self.at} remain")
        self.at += n
        return self.data[self.at - n : self.at]

    def _unpack(self, code: str, n: int):
        return struct.unpack((">" if self.big else "<") + code, self.take(n))[0]

    def u8(self) -> int:
        return self.take(1)[0]

    def i16(self) -> int:
        return self._unpack("h", 2)

    def u16(self) -> int:
        return self._unpack("H", 2)

    def i32(self) -> int:
        return self._unpack("i", 4)

    def u32(self) -> int:
        return self._unpack("I", 4)

    def i64(self) -> int:
        return self._unpack("q", 8)

    def u64(self) -> int:
        return self._unpack("Q", 8)

    def f32(self) -> float:
        return self._unpack("f", 4)

    def f64(self) -> float:
        return self._unpack("d", 8)

    def cstring(self, most: int = 1 << 16) -> str:
        stop = self.data.find(b"\0", self.at, min(self.end, self.at + most + 1))
        if stop < 0:
            raise InvalidData(f"a string at {self.at} doesn't end")
        text = self.data[self.at : stop].decode("utf-8", "replace")
        self.at = stop + 1
        return text

    def count(self, least_size: int, what: str) -> int:
        """A count that the remaining bytes can hold."""
        n = self.i32()
        if n < 0 or n * least_size > self.end - self.at:
            raise InvalidData(f"{n} {what} don't fit in {self.end - self.at} bytes")
        return n

    def string(self) -> str:
        """A counted string, followed by padding to four bytes."""
        text = self.take(self.count(1, "string bytes")).decode("utf-8", "replace")
        self.align(4)
        return text

    def align(self, to: int, base: int = 0) -> None:
        self.take(-(self.at - base) % to)
