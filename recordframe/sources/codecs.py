"""Compression, told by magic bytes; one layer is taken off."""

from __future__ import annotations

import bz2
import lzma
import zlib

from recordframe.formats.base import RecordFormatError


def _gzip(data: bytes) -> bytes:
    """All members, as in blocked gzip."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
        if not data.startswith((b"\x1f\x8b", b"\x0f\x8b")):
            break
    return b"".join(out)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()


# What compressed files begin with.
CODECS = (
    (b"\x1f\x8b", "gzip", _gzip),
    (b"\x0f\x8b", "gzip", _gzip),
    (b"BZ", "bzip", bz2.decompress),
    (b"\xfd7", "lzma", lzma.decompress),
    (b"\x28\xb5\x2f\xfd", "zstd", _zstd),
)


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """The content without one layer of compression, and its codec, or None."""
    for magic, name, decode in CODECS:
        if data.startswith(magic):
            try:
                return decode(data), name
            except Exception as e:
                raise RecordFormatError(f"Broken {name} data: {e}", 0) from None
    return data, None
