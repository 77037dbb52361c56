"""The inverse of each decoder: what writes the files of tests and of round-trip queries.

Laid out after the formats' descriptions, independently of the decoders.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

from recordframe.formats.sequences import BASES, CIGAR, bgzf


def fasta(ids: Sequence[str], sequences: Sequence[str], width: int = 60) -> bytes:
    lines = []
    for i, s in zip(ids, sequences):
        lines.append(f">{i}\n")
        lines += [s[k : k + width] + "\n" for k in range(0, len(s), width)]
    return "".join(lines).encode()


def fastq(ids: Sequence[str], sequences: Sequence[str], qualities: Sequence[str]) -> bytes:
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in zip(ids, sequences, qualities)).encode()


def delimited(names: Sequence[str], rows: Sequence[Sequence], delimiter: str = "\t", quote: str = '"') -> bytes:
    def cell(v) -> str:
        s = str(v)
        return quote + s.replace(quote, quote * 2) + quote if delimiter in s or s.startswith(quote) else s

    return "".join(delimiter.join(map(cell, r)) + "\n" for r in [names, *rows]).encode()


def sam(rows: Sequence[tuple], head: str = "@HD\tVN:1.6\n") -> bytes:
    """rows: the columns of an alignment as the decoder gives them."""
    star = lambda s: s or "*"
    return (head + "".join(
        "\t".join(map(str, (q, f, star(r), 0 if p is None else p + 1, 255 if m is None else m, star(c), star(n), 0 if o is None else o + 1, t, star(s), star(u), *(e.split("|") if e else ()))))
        + "\n" for q, f, r, p, m, c, n, o, t, s, u, e in rows
    )).encode()


def bam(rows: Sequence[tuple], references: Sequence[str]) -> bytes:
    """Tags must be integers (i) or text (Z)."""
    import re

    index = {n: i for i, n in enumerate(references)} | {"": -1}
    out = [b"BAM\1", struct.pack("<I", 0), struct.pack("<I", len(references))]
    for n in references:
        out.append(struct.pack("<I", len(n) + 1) + n.encode() + b"\0" + struct.pack("<I", 1 << 28))
    for q, f, r, p, m, c, n, o, t, s, u, e in rows:
        name = q.encode() + b"\0"
        ops = [(int(k) << 4) | CIGAR.index(x) for k, x in re.findall(r"(\d+)(.)", c)]
        codes = [BASES.index(x) for x in s] + [0] * (len(s) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        quality = bytes(ord(x) - 33 for x in u) if u else b"\xff" * len(s)
        tags = b""
        for tag in e.split("|") if e else ():
            key, kind, value = tag.split(":", 2)
            tags += key.encode() + (b"i" + struct.pack("<i", int(value)) if kind == "i" else b"Z" + value.encode() + b"\0")
        body = struct.pack("<iiBBHHHIiii", index[r], -1 if p is None else p, len(name), 255 if m is None else m, 0, len(ops), f, len(s), index[n], -1 if o is None else o, t)
        body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + quality + tags
        out.append(struct.pack("<I", len(body)) + body)
    return bgzf(b"".join(out))


def flow(columns: dict[str, np.ndarray], kind: str = "F", bits: int = 32, big: bool = True, ranges: dict[str, int] | None = None, extra: dict[str, str] | None = None, following: bytes | None = None) -> bytes:
    """One data set; ``following`` is a further one behind it."""
    n = len(next(iter(columns.values()))) if columns else 0
    size = {"D": 8, "F": 4, "I": bits // 8, "A": 12}[kind]
    order = ">" if big else "<"
    cells = []
    for v in columns.values():
        if kind == "A":
            cells.append(np.array([f"{x:>12}".encode() for x in v], "S12").view(np.uint8).reshape(n, 12))
        elif kind == "I":
            raw = np.asarray(v, np.uint64).astype(order + "u8").view(np.uint8).reshape(n, 8)
            cells.append(raw[:, 8 - size :] if big else raw[:, :size])
        else:
            cells.append(np.asarray(v).astype(f"{order}f{size}").view(np.uint8).reshape(n, size))
    data = np.concatenate(cells, 1).tobytes() if n else b""
    keys = {"$DATATYPE": kind, "$MODE": "L", "$BYTEORD": "4,3,2,1" if big else "1,2,3,4", "$PAR": str(len(columns)), "$TOT": str(n), "$NEXTDATA": "{next:08d}", **(extra or {})}
    for i, name in enumerate(columns, 1):
        keys |= {f"$P{i}N": name, f"$P{i}B": str(12 if kind == "A" else 8 * size), f"$P{i}R": str((ranges or {}).get(name, 0)), f"$P{i}E": "0,0"}
    text = "/" + "/".join(f"{k}/{v}" for k, v in keys.items()) + "/"
    length = len(text.format(next=0).encode())
    begin = 58 + length
    text = text.format(next=begin + len(data) if following else 0).encode()
    head = b"FCS3.1    " + b"".join(f"{x:>8}".encode() for x in (58, begin - 1, begin, begin + len(data) - 1 if data else begin, 0, 0))
    return head + text + data + (following or b"")


def png(samples: np.ndarray, colour: int, depth: int = 8, palette: np.ndarray | None = None, filters: Sequence[int] = (0,)) -> bytes:
    """samples: height x width x channels; filters are taken in turn, row by row."""
    h, w, channels = samples.shape
    step = max(1, channels * depth // 8)
    lines, above = [], None
    for y in range(h):
        flat = samples[y].reshape(-1)
        if depth == 16:
            line = flat.astype(">u2").view(np.uint8).astype(np.int64)
        elif depth == 8:
            line = flat.astype(np.int64)
        else:
            bits = (flat[:, None] >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8).ravel()
            line = np.packbits(bits).astype(np.int64)
        above = np.zeros_like(line) if above is None else above
        left = np.concatenate((np.zeros(step, np.int64), line))[: len(line)]
        corner = np.concatenate((np.zeros(step, np.int64), above))[: len(line)]
        kind = filters[y % len(filters)]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        lines.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


_MAGIC = {2: b"\x02\x32\x00\x00", 30: b"\x0230\x00", 31: b"\x0231\x00", 81: b"\x0281\x00", 131: b"\x03131", 179: b"\x03179"}


def chemstation_header(version: int, size: int, scans: int = 0, start: float = 0, end: float = 0, signal: str = "", offset: float = 0.0, mult: float = 1.0, sample: str = "sample", run_date: str = "01-Jan-20, 10:00:00") -> bytearray:
    """The common header; start and end in milliseconds."""
    h = bytearray(size)
    h[:4] = b"\x01\x32\x00\x00" if version == 2 else _MAGIC[version]

    def put(at: int, form: str, *v) -> None:
        struct.pack_into(form, h, at, *v)

    def text(at: int, s: str, wide: bool) -> None:
        raw = s.encode("utf-16-le" if wide else "utf-8")
        h[at : at + 1 + len(raw)] = bytes([len(s)]) + raw

    put(248, ">I", version)
    put(252, ">HHH", 1, 2, 3)
    put(264, ">I", size // (2 if version == 2 else 512) + 1)
    put(278, ">I", scans)
    put(282, ">ff" if version == 179 else ">ii", start, end)
    wide = version > 102
    text(858 if wide else 24, sample, wide)
    text(1880 if wide else 148, "operator", wide)
    text(2391 if wide else 178, run_date, wide)
    text(2492 if wide else 208, "instrument", wide)
    text(2574 if wide else 228, "method", wide)
    if version in (30, 81):
        text(596, signal, False)
        put(636, ">dd", offset, mult)
    elif version == 131:
        put(3085, ">d", mult)
    elif version == 179:
        text(4213, signal, True)
        put(4732, ">d", mult)
    return h


def chemstation_fid(values: Sequence[int], **head) -> bytes:
    """Every value that the second differences cannot reach is written in full."""
    out, level, slope = [], 0, 0
    for v in values:
        step = v - level - slope
        if -32768 <= step < 32767:
            out.append(struct.pack(">h", step))
            slope = v - level
        else:
            out.append(struct.pack(">hiH", 32767, v // 65534, v % 65534))
            slope = 0
        level = v
    return bytes(chemstation_header(81, 1024, **head)) + b"".join(out)


def chemstation_ms(scans: Sequence[tuple[int, Sequence[tuple[int, int]]]]) -> bytes:
    """scans: milliseconds, and (20 x m/z, packed intensity) of each peak."""
    out = [bytes(chemstation_header(2, 1024, scans=len(scans)))]
    for ms, peaks in scans:
        out.append(struct.pack(">HI12x", 2 * len(peaks) + 14, ms) + b"".join(struct.pack(">HH", *p) for p in peaks) + b"\0" * 10)
    return b"".join(out)


def pack_intensity(v: int) -> int:
    """Fourteen bits and an exponent of eight."""
    e = 0
    while v >= 16384:
        v, e = v >> 3, e + 1
    return e << 14 | v


def chemstation_mwd(values: Sequence[int], block: int = 50, **head) -> bytes:
    out, level = [], 0
    for k in range(0, len(values), block):
        part = values[k : k + block]
        out.append(struct.pack(">H", 0x1000 | len(part)))
        for v in part:
            step = v - level
            out.append(struct.pack(">h", step) if -32768 < step < 32768 else struct.pack(">hi", -32768, v))
            level = v
    return bytes(chemstation_header(30, 1024, **head)) + b"".join(out) + b"\0\0"


def _scans(scans: Sequence[tuple[int, int, int, Sequence[int]]]) -> bytes:
    """scans: milliseconds, first wavelength and step (both 20 x nm), values."""
    out = []
    for ms, first, step, values in scans:
        body, level = [], 0
        for v in values:
            d = v - level
            body.append(struct.pack("<h", d) if -32768 < d < 32768 else struct.pack("<hi", -32768, v))
            level = v
        packed = b"".join(body)
        out.append(struct.pack("<HHIHHH8x", 67, len(packed) + 22, ms, first, first + step * (len(values) - 1), step) + packed)
    return b"".join(out)


def chemstation_dad(scans: Sequence[tuple], **head) -> bytes:
    return bytes(chemstation_header(31, 1024, scans=len(scans), **head)) + _scans(scans)


def chemstation_uv(scans: Sequence[tuple], **head) -> bytes:
    return bytes(chemstation_header(131, 4096, scans=len(scans), **head)) + _scans(scans)


def chemstation_array(values: Sequence[float], start: float, step: tuple[int, int], wide: bool = True, **head) -> bytes:
    """step: a fraction of seconds."""
    ms = step[0] / step[1] * 1000
    h = chemstation_header(179, 6144, start=start, end=start + ms * (len(values) - 1) + ms / 2, **head)
    if wide:
        h[348:352] = b"G\0C\0"
    struct.pack_into(">HH", h, 4122, *step)
    return bytes(h) + np.asarray(values, "<f8" if wide else "<f4").tobytes()


def masshunter_dad(scans: Sequence[tuple[float, float, float, Sequence[float]]]) -> tuple[bytes, bytes]:
    """scans: time, first wavelength, step, values.  Gives the .sp and the .sd file."""
    head = bytearray(164)
    head[:4] = b"\x02\x02\x00\x00"
    struct.pack_into("<Q", head, 80, len(scans))
    sd, sp = [bytes(head)], [b"\x03\x02\x00\x00" + b"\0" * 64]
    for t, first, step, values in scans:
        entry = bytearray(80)
        for at, form, v in ((4, "<d", t), (20, "<d", step), (44, "<I", len(values)), (48, "<d", first)):
            struct.pack_into(form, entry, at, v)
        sd.append(bytes(entry))
        sp.append(b"\0" * 16 + np.asarray(values, "<f8").tobytes())
    return b"".join(sp), b"".join(sd)


def inficon(segments: Sequence[Sequence[tuple[int, int, int]]], scans: Sequence[tuple[int, int, Sequence[float]]]) -> bytes:
    """segments: ranges (first, last, type) of 100 x m/z; scans: milliseconds, segment, intensities."""
    mark = b"\xff" * 4 + b"\0" * 32 + b"\xf6\xff\xff\xff" + b"\0" * 4
    out = [b"\4\3\2\1SPAH", b"\0" * 20, mark, b"\0" * (148 - len(mark)), struct.pack("<I", len(segments))]
    for s in segments:
        out.append(b"\0" * 96 + struct.pack("<I", len(s)) + b"".join(struct.pack("<II16xI4x", a, b, k) for a, b, k in s))
    body = b"".join(struct.pack("<IiHHHH", i + 1, ms, 1, len(v), 0xFFFF, k << 4 | 15) + np.asarray(v, "<f4").tobytes() for i, (ms, k, v) in enumerate(scans))
    start = b"\xff" * 4 + b"HapsGPIR"
    out += [start, b"\0" * (180 - len(start)), struct.pack("<I", len(body)), b"\0" * 8, b"HapsScan", b"\0" * 56, body]
    return b"".join(out)


def _wide(s: str) -> bytes:
    return b"\xff\xfe\xff" + bytes([len(s)]) + s.encode("utf-16-le")


def _isotope_scans(scans: Sequence[tuple[float, Sequence[float]]]) -> bytes:
    return b"".join(struct.pack("<f", t) + np.asarray(v, "<f8").tobytes() for t, v in scans)


def thermo_dxf(sections: Sequence[tuple[str, Sequence[tuple[float, Sequence[float]]]]]) -> bytes:
    """sections: gas, and scans of seconds and intensities."""
    out = [b"\xff\xff\x05\x00" + b"\0" * 100]
    for k, (gas, scans) in enumerate(sections):
        body = _isotope_scans(scans)
        out.append(b"CRawData\3\0\0\0\x2f\0" if k == 0 else b"\0" * 8 + b"\x82\x82\3\0\0\0\x2f\0")
        out.append(_wide(gas) + b"\0" * 16 + (b"\xff" + b"\0" * 20 if k == 0 else b"\x84" + b"\0" * 6) + struct.pack("<I", len(body)) + body)
    return b"".join(out)


def thermo_cf(sections: Sequence[tuple[str, Sequence[tuple[float, Sequence[float]]]]]) -> bytes:
    out = [b"\xff\xff\x06\x00" + b"\0" * 48 + "CIsoGC".encode("utf-16-le") + b"\0" * 40]
    mark = b"\xff\xfe\xff\0\xff\xfe\xff\x08" + "Raw Data".encode("utf-16-le")
    for k, (gas, scans) in enumerate(sections):
        body, n = _isotope_scans(scans), len(scans[0][1])
        out.append(mark + b"\0" * (36 - len(mark)) + (b"\xff" + b"\0" * 34 if k == 0 else b"\x3e" + b"\0" * 10) + _wide("Trace Data " + gas) + b"\0" * 20)
        out.append(struct.pack("<II", len(scans), n) + (b"\xff" + b"\0" * 28 if k == 0 else b"\x40" + b"\0" * 18) + body)
    return b"".join(out)


def thermo_raw(scans: Sequence[tuple[float, float, float, Sequence[tuple[int, Sequence[float]]]]], coefficients: Sequence[float] = (), version: int = 66, adjustment: float | None = None) -> bytes:
    """scans: time, first frequency, step, chunks of (offset, intensities); coefficients: 0, 4, 5 or 7 numbers."""
    head = bytearray(1420)
    head[:18] = b"\x01\xa1" + "Finnigan".encode("utf-16-le")
    struct.pack_into("<I", head, 36, version)
    n_strings = 31 if version >= 60 else 16
    names = b"".join(struct.pack("<I", 1) + "x".encode("utf-16-le") + (b"\0" * 4 if k == 15 else b"") for k in range(n_strings))
    gap = 52 + 4 + 16 + 4 if version < 64 else 836 + 8 + 8 + 8
    begin = len(head) + len(names) + gap
    body = []
    for _, first, step, chunks in scans:
        data = struct.pack("<ddII", first, step, len(chunks), 0)
        for offset, values in chunks:
            data += struct.pack("<II", offset, len(values)) + (struct.pack("<f", adjustment) if adjustment is not None else b"") + np.asarray(values, "<f4").tobytes()
        body.append(struct.pack("<I6I12x", 1, len(data) // 4, 1, adjustment is not None, 0, 0, 0) + data + b"\0" * 4)
    data = b"".join(body)
    trailer = begin + len(data)
    size = 592 + (6980 if version >= 64 else 6816)
    meta_size, fixed = 88 if version >= 66 else 80 if version >= 64 else 72, 140 if version >= 66 else 132 if version >= 63 else 124 if version >= 62 else 84
    meta = bytearray()
    for t, *_ in scans:
        entry = bytearray(meta_size)
        struct.pack_into("<d", entry, 24, t)
        meta += entry
    k = bytearray(4)
    for _ in scans:
        k += bytearray(fixed) + bytearray(20) + struct.pack("<I", len(coefficients)) + struct.pack(f"<{len(coefficients)}d", *coefficients) + bytearray(8 + (4 if version >= 66 else 0))
    t = bytearray(size)
    struct.pack_into("<I", t, 12, len(scans))
    at_meta, at_k = trailer + size, trailer + size + len(meta)
    if version >= 64:
        struct.pack_into("<Q", t, 7408, at_meta)
        struct.pack_into("<Q", t, 7448, at_k)
        places = b"\0" * 836 + struct.pack("<Q", begin) + b"\0" * 8 + struct.pack("<Q", trailer)
    else:
        struct.pack_into("<I", t, 28, at_meta)
        struct.pack_into("<I", t, 7368, at_k)
        places = b"\0" * 52 + struct.pack("<I", begin) + b"\0" * 16 + struct.pack("<I", trailer)
    return bytes(head) + names + places + data + bytes(t) + bytes(meta) + bytes(k)
