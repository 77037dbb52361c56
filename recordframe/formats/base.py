"""What all decoders share: their result, errors, and a cursor over bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


class RecordFormatError(ValueError):
    """A file that does not follow its format: what, at which byte, in which record."""

    def __init__(self, message: str, byte: int | None = None, record: int | None = None, path: str | None = None):
        self.message, self.byte, self.record, self.path = message, byte, record, path
        where = [f"{n} {v}" for n, v in (("byte", byte), ("record", record), ("in", path)) if v is not None]
        super().__init__(message + (f" ({', '.join(where)})" if where else ""))

    def __reduce__(self):
        return RecordFormatError, (self.message, self.byte, self.record, self.path)


@dataclass
class Decoded:
    """The columns of a file in order, and its metadata."""

    columns: dict[str, pa.Array]
    metadata: dict[str, object] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return len(next(iter(self.columns.values()))) if self.columns else 0


def floats(**columns) -> dict[str, pa.Array]:
    """Columns of doubles."""
    return {n: pa.array(np.ascontiguousarray(c, np.float64)) for n, c in columns.items()}


class Cursor:
    """A place in a file that moves as values are read."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise RecordFormatError("File ended early", self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    skip = take

    def read(self, form: str):
        """One value, or a tuple of them, by the codes of ``struct``."""
        found = struct.unpack(form, self.take(struct.calcsize(form)))
        return found[0] if len(found) == 1 else found

    def array(self, dtype: str, n: int) -> np.ndarray:
        return np.frombuffer(self.take(n * np.dtype(dtype).itemsize), dtype)

    def seek(self, pattern: bytes) -> bool:
        """To the next place where the pattern begins."""
        found = self.data.find(pattern, self.at)
        if found >= 0:
            self.at = found
        return found >= 0


def pascal(data: bytes, at: int, most: int | None = None) -> str:
    """A string after its length in a byte."""
    n = data[at]
    if most is not None and n > most:
        raise RecordFormatError("Invalid string length", at)
    return data[at + 1 : at + 1 + n].decode("utf-8", "replace").strip()


def pascal_utf16(data: bytes, at: int) -> str:
    return data[at + 1 : at + 1 + 2 * data[at]].decode("utf-16-le", "replace")


def restarting_sum(steps: np.ndarray, resets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums of steps that begin anew at ``resets`` with ``values``."""
    steps = steps.astype(np.int64)
    steps[resets] = 0
    total = np.cumsum(steps)
    if not len(resets):
        return total
    base = np.zeros(len(steps), np.int64)
    base[resets] = values - total[resets]
    last = np.zeros(len(steps), np.int64)
    last[resets] = resets
    np.maximum.accumulate(last, out=last)
    begun = np.arange(len(steps)) >= resets[0]
    return total + np.where(begun, base[last], 0)
