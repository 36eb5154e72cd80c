"""Reading scalars from bytes, and how a decoder says no."""

from __future__ import annotations

import struct
from dataclasses import dataclass


@dataclass
class Reject(Exception):
    """Why an input is refused: a status, and where known the field, row and byte offset."""

    status: str
    field: str | None = None
    row: int | None = None
    offset: int | None = None

    def __post_init__(self) -> None:
        super().__init__(f"{self.status} at {self.field or '-'} row {self.row} offset {self.offset}")


class Cursor:
    """A position in ``data`` that never passes ``end``; offsets count from ``data``'s start."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, big: bool = True, short: str = "truncated"):
        self.data, self.at, self.end, self.short = data, at, len(data) if end is None else end, short
        self.order = ">" if big else "<"
        self.field: str | None = None
        self.row: int | None = None

    def fail(self, status: str, offset: int | None = None) -> Reject:
        return Reject(status, self.field, self.row, self.at if offset is None else offset)

    @property
    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n > self.end - self.at:
            raise self.fail(self.short, self.end)
        self.at += n
        return self.data[self.at - n: self.at]

    def _scalar(self, kind: str, n: int):
        return struct.unpack(self.order + kind, self.take(n))[0]

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return self._scalar("H", 2)

    def u32(self) -> int:
        return self._scalar("I", 4)

    def u64(self) -> int:
        return self._scalar("Q", 8)

    def i32(self) -> int:
        return self._scalar("i", 4)

    def i64(self) -> int:
        return self._scalar("q", 8)

    def count(self) -> int:
        """A 32-bit count, which must not be negative."""
        start, n = self.at, self.i32()
        if n < 0:
            raise self.fail("negative-count", start)
        return n

    def text(self) -> bytes:
        """Bytes up to a NUL, which is consumed."""
        stop = self.data.find(b"\0", self.at, self.end)
        if stop < 0:
            raise self.fail("unterminated-string", self.at)
        found = self.data[self.at: stop]
        self.at = stop + 1
        return found

    def align(self, width: int, origin: int = 0) -> bytes:
        """Skip to a multiple of ``width`` counted from ``origin``; gives the bytes skipped."""
        return self.take(-(self.at - origin) % width)
