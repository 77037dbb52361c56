"""PNG images: a row for each pixel."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from recordframe.formats.base import Cursor, Decoded, RecordFormatError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: channels by colour type


def _wavefront(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """All filters at once, one anti-diagonal of pixels after the other: those on one depend on earlier ones only."""
    rows, width = lines.shape
    w = -(-width // step)
    v = np.zeros((rows, w * step), np.int32)
    v[:, :width] = lines
    v = v.reshape(rows, w, step)
    out = np.zeros((rows + 1, w + 1, step), np.int32)
    for d in range(w + rows - 1):
        y = np.arange(max(0, d - w + 1), min(rows - 1, d) + 1)
        x = d - y
        a, b, c, k = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        near_a, near_b, near_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c))
        guess = np.where(k == 4, paeth, np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))
        out[y + 1, x + 1] = (v[y, x] + guess) & 255
    return out[1:, 1:].reshape(rows, w * step)[:, :width].astype(np.uint8)


def _unfilter(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """raw: a filter byte and ``width`` bytes for each row; step: bytes of a pixel."""
    lines = raw.reshape(rows, width + 1)
    kinds = lines[:, 0]
    if rows and kinds.max() > 4:
        raise RecordFormatError(f"Unknown filter {kinds.max()}")
    if rows > 16 and width > 16 and (kinds > 2).any():
        return _wavefront(lines[:, 1:], kinds, step)
    out = np.zeros((rows + 1, width), np.uint8)
    for y in range(rows):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for k in range(step):
                out[y + 1, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            now = [0] * step + [0] * width
            up = [0] * step + above.tolist()
            for x, v in enumerate(line.tolist()):
                a, b, c = now[x], up[x + step], up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[x + step] = (v + guess) & 255
            out[y + 1] = now[step:]
    return out[1:]


def png(data: bytes) -> Decoded:
    """x, y, and red, green, blue and alpha on a scale to 65535."""
    c = Cursor(data)
    if c.take(8) != SIGNATURE:
        raise RecordFormatError("Invalid PNG magic", 0)
    size, kind = c.read(">I4s")
    if kind != b"IHDR" or size != 13:
        raise RecordFormatError("IHDR must be the first chunk", 8)
    w, h, depth, colour, compression, filters, interlace = c.read(">IIBBBBB")
    c.skip(4)
    if compression or filters or interlace:
        raise RecordFormatError("Interlaced or unknown PNGs are not supported", 24)
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise RecordFormatError("Unknown colour type or depth", 24)
    palette, packed = None, []
    while c.at < len(data):
        size, kind = c.read(">I4s")
        body = c.take(size)
        c.skip(4)
        if kind == b"PLTE":
            palette = np.frombuffer(body[: size // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64) * 257
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    channels = CHANNELS[colour]
    width = (w * channels * depth + 7) // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise RecordFormatError(f"Image data is broken: {e}") from None
    if len(raw) < h * (width + 1):
        raise RecordFormatError("Image data is too short")
    flat = _unfilter(raw[: h * (width + 1)], h, width, max(1, channels * depth // 8))
    if depth == 16:
        v = flat.reshape(h, -1, 2).astype(np.int64)
        v = v[..., 0] << 8 | v[..., 1]
    elif depth == 8:
        v = flat.astype(np.int64)
    else:  # the leftmost pixel is in the highest bits
        v = np.unpackbits(flat, axis=1).reshape(h, -1, depth)
        v = (v.astype(np.int64) << np.arange(depth - 1, -1, -1)).sum(2)
    v = v[:, : w * channels].reshape(h * w, channels)
    full = np.full(h * w, 65535, np.int64)
    if colour == 3:
        if palette is None or len(v) and int(v.max()) >= len(palette):
            raise RecordFormatError("Palette index is out of range")
        rgba = [*palette[v[:, 0]].T, full]
    else:
        v = v * 65535 // ((1 << depth) - 1)
        grey = colour in (0, 4)
        rgba = [*(v[:, 0] if grey else v[:, k] for k in range(3)), v[:, -1] if colour in (4, 6) else full]
    y, x = np.divmod(np.arange(h * w), w) if w else (full, full)
    return Decoded({n: pa.array(np.ascontiguousarray(a, np.int64)) for n, a in zip(("x", "y", "red", "green", "blue", "alpha"), (x, y, *rgba))}, {"height": h, "width": w})
