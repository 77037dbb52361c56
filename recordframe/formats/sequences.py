"""FASTA, FASTQ, SAM and BAM."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from recordframe.formats.base import Cursor, Decoded, RecordFormatError

ALIGNMENT = ("query_name", "flag", "ref_name", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "sequence", "quality", "extra")
_NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}
# Fixed values of the BAM format: letters of CIGAR operations and of bases, and widths of tag values.
CIGAR = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
_TAG = {"A": "c", "c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _text(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())  # checks that it is UTF-8
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def fasta(data: bytes) -> Decoded:
    """Records of a header line and sequence lines; the id is the whole line."""
    if data and not data.startswith(b">"):
        raise RecordFormatError("Valid FASTA records start with '>'", 0, 0)
    ids, sequences, at = [], [], 0
    records = data[1:].split(b"\n>") if data else []
    for i, record in enumerate(records):
        head, newline, rest = record.partition(b"\n")
        if not newline and i + 1 == len(records):  # elsewhere the line's end is that before the next '>'
            raise RecordFormatError("The last header line is not ended", at, i)
        if b">" in rest:
            raise RecordFormatError("A '>' stands within a record", at + record.index(b">", len(head)), i)
        ids.append(head.removesuffix(b"\r"))
        sequences.append(rest.translate(None, b"\r\n"))
        at += len(record) + 2
    return Decoded({"id": _text(ids), "sequence": _text(sequences)})


def fastq(data: bytes) -> Decoded:
    """Four-part records; a sequence of several lines keeps its inner line ends, and the quality is as long."""
    columns: tuple[list, list, list] = ([], [], [])
    at = n = 0
    while at < len(data):
        if data[at : at + 1] != b"@":
            raise RecordFormatError("No '@' where a record should begin", at, n)
        line = data.find(b"\n", at)
        plus = data.find(b"+", line + 1) if line >= 0 else -1
        if plus < 0:
            raise RecordFormatError("A record has no line of '+'", at, n)
        if data[plus - 1 : plus] != b"\n":
            raise RecordFormatError("A '+' stands within the sequence", plus, n)
        sequence = data[line + 1 : plus - 1].removesuffix(b"\r")
        second = data.find(b"\n", plus)
        if second < 0 or second + 1 + len(sequence) > len(data):
            raise RecordFormatError("The quality is shorter than the sequence", plus, n)
        end = second + 1 + len(sequence)
        for column, value in zip(columns, (data[at + 1 : line].removesuffix(b"\r"), sequence, data[second + 1 : end])):
            column.append(value)
        if data[end : end + 2] == b"\r\n":
            end += 2
        elif data[end : end + 1] == b"\n":
            end += 1
        elif end < len(data):
            raise RecordFormatError("Quality is longer than the sequence", end, n)
        at, n = end, n + 1
    return Decoded(dict(zip(("id", "sequence", "quality"), map(_text, columns))))


def _alignments(rows: list[tuple]) -> Decoded:
    columns = list(zip(*rows)) if rows else [()] * len(ALIGNMENT)
    return Decoded({n: pa.array(c, pa.int64() if n in _NUMBERS else pa.string()) for n, c in zip(ALIGNMENT, columns)})


def sam(data: bytes) -> Decoded:
    """Positions are from 0, and absent values null or empty; the tags are joined by a bar."""
    rows = []
    in_head, at = True, 0
    for line in data.decode("utf-8", "replace").split("\n"):
        size, at = at, at + len(line) + 1
        in_head = in_head and line.startswith("@")
        line = line.removesuffix("\r")
        if in_head or not line:
            continue
        f = line.split("\t")
        if len(f) < 11:
            raise RecordFormatError("An alignment has fewer than eleven fields", size, len(rows))
        some = lambda s: "" if s == "*" else s
        try:
            flag, pos, mapq, pnext, tlen = int(f[1]), int(f[3]), f[4], int(f[7]), int(f[8])
            if not 0 <= flag < 65536 or pos < 0 or pnext < 0:
                raise ValueError("out of range")
            quality = None if mapq == "255" else int(mapq)
        except ValueError as e:
            raise RecordFormatError(f"A field is no number in its range: {e}", size, len(rows)) from None
        rows.append((f[0], flag, some(f[2]), pos - 1 if pos else None, quality, some(f[5]), some(f[6]), pnext - 1 if pnext else None, tlen, some(f[9]), some(f[10]), "|".join(f[11:])))
    return _alignments(rows)


def _tags(c: Cursor, end: int) -> str:
    out = []
    while c.at < end:
        name, kind = c.take(2).decode("ascii", "replace"), chr(c.take(1)[0])
        if kind in "ZH":
            stop = c.data.find(b"\0", c.at, end)
            if stop < 0:
                raise RecordFormatError("Tag has no end", c.at)
            out.append(f"{name}:{kind}:{c.take(stop - c.at).decode('utf-8', 'replace')}")
            c.skip(1)
        elif kind == "B":
            sub = chr(c.take(1)[0])
            values = [c.read(_TAG[sub]) for _ in range(c.read("<I"))]
            out.append(f"{name}:B:{sub}" + "".join(f",{_number(v)}" for v in values))
        elif kind in _TAG:
            v = c.read(_TAG[kind])
            out.append(f"{name}:A:{v.decode()}" if kind == "A" else f"{name}:{'f' if kind == 'f' else 'i'}:{_number(v)}")
        else:
            raise RecordFormatError(f"Unknown tag type {kind}", c.at)
    return "|".join(out)


def _number(v) -> str:
    return np.format_float_positional(np.float32(v), trim="-") if isinstance(v, float) else str(v)


_NIBBLES = str.maketrans("0123456789abcdef", BASES)
_QUALITY = bytes(min(q + 33, 255) for q in range(256))
_HEAD = struct.Struct("<iiBBHHHIiii")


def _cigar(raw: bytes) -> str:
    return "".join(f"{x >> 4}{CIGAR[x & 15]}" for x in struct.unpack(f"<{len(raw) // 4}I", raw))


def bam(data: bytes) -> Decoded:
    """The inflated content of a BAM file; columns as SAM has them."""
    c = Cursor(data)
    if c.take(4) != b"BAM\1":
        raise RecordFormatError("Not a valid BAM file", 0)
    c.skip(c.read("<I"))
    names = []
    for _ in range(c.read("<I")):
        names.append(c.take(c.read("<I")).removesuffix(b"\0").decode("utf-8", "replace"))
        c.skip(4)

    def name(i: int) -> str:
        if i >= len(names):
            raise RecordFormatError("Invalid reference sequence id", at, len(rows))
        return names[i] if i >= 0 else ""

    rows: list[tuple] = []
    cigars: dict[bytes, str] = {}
    at, total = c.at, len(data)
    while at < total:
        if at + 4 > total:
            raise RecordFormatError("File ended early", at, len(rows))
        size = int.from_bytes(data[at : at + 4], "little")
        if size < 32:
            raise RecordFormatError("Record is unexpectedly short", at, len(rows))
        end = at + 4 + size
        if end > total:
            raise RecordFormatError("File ended early", at, len(rows))
        ref, pos, n_name, mapq, _, n_ops, flag, n, next_ref, pnext, tlen = _HEAD.unpack_from(data, at + 4)
        a = at + 36
        b = a + n_name
        o = b + 4 * n_ops
        q = o + (n + 1) // 2
        if q + n > end:
            raise RecordFormatError("Record is too short for its fields", at, len(rows))
        query = data[a:b].removesuffix(b"\0").decode("utf-8", "replace")
        raw = data[b:o]
        cigar = cigars.get(raw)
        if cigar is None:
            cigar = _cigar(raw)
            if len(cigars) < 100_000:
                cigars[raw] = cigar
        bases = data[o:q].hex().translate(_NIBBLES)[:n]
        quality = "" if not n or data[q] == 255 else data[q : q + n].translate(_QUALITY).decode("latin-1")
        if q + n < end:
            c.at = q + n
            extra = _tags(c, end)
        else:
            extra = ""
        rows.append((query, flag, name(ref), pos if pos >= 0 else None, mapq if mapq != 255 else None, cigar, name(next_ref), pnext if pnext >= 0 else None, tlen, bases, quality, extra))
        at = end
    return _alignments(rows)


def bgzf(data: bytes, block: int = 60_000) -> bytes:
    """Blocked gzip, as BAM files are written, with the empty block at the end."""
    import zlib

    out = []
    for i in [*range(0, len(data), block), None]:
        part = data[i : i + block] if i is not None else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)
