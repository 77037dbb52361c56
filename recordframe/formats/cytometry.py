"""Flow cytometry (FCS 2.0 to 3.1)."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pyarrow as pa

from recordframe.formats.base import Decoded, RecordFormatError

# Keywords that are shown as metadata, and the forms of dates.
KEYS = {"$SMNO": "specimen_number", "$SRC": "specimen_source", "$CELLS": "specimen", "$CYT": "instrument", "$OP": "operator", "$PROJ": "project"}
DATES = ("%d-%b-%y", "%d-%b-%Y", "%Y-%b-%d", "%d-%m-%Y")


def _offset(data: bytes, at: int) -> int:
    s = data[at : at + 8].strip()
    if s and not s.isdigit():
        raise RecordFormatError("Invalid offset in the header", at)
    return int(s or 0)


def _keywords(data: bytes, base: int) -> tuple[dict[str, str], int, int]:
    """The TEXT segment, and where DATA begins and ends."""
    head = data[base : base + 58]
    if len(head) < 58 or head[:3] != b"FCS":
        raise RecordFormatError("FCS header is invalid", base)
    start, end, begin, stop = (_offset(head, k) for k in (10, 18, 26, 34))
    if start < 58 or end < start:
        raise RecordFormatError("Bad TEXT segment", base + 10)
    text = data[base + start : base + end + 1]
    parts = text[1:].decode("utf-8", "replace").split(chr(text[0]))
    keys = {k.strip().upper(): v.strip() for k, v in zip(parts[::2], parts[1::2])}
    if begin == 0:
        begin = int(keys.get("$BEGINDATA", 0))
    if stop == 0:
        stop = int(keys.get("$ENDDATA", 0))
    return keys, base + begin, base + stop


def _integers(raw: np.ndarray, bits: int, big: bool) -> np.ndarray:
    """raw: rows of the bytes of one parameter."""
    order = raw if big else raw[:, ::-1]
    out = np.zeros(len(raw), np.uint64)
    for k in range(bits // 8):
        out = out << np.uint64(8) | order[:, k].astype(np.uint64)
    return out


def _date(keys: dict[str, str]) -> dt.datetime:
    day = dt.date(2000, 1, 1)
    for form in DATES:
        try:
            day = dt.datetime.strptime(keys.get("$DATE", ""), form).date()
            break
        except ValueError:
            pass
    clock = dt.time()
    parts = keys.get("$BTIM", "").split(":")
    if len(parts) >= 3:
        try:
            clock = dt.time(*(int(float(p)) for p in parts[:3]))
        except ValueError:
            pass
    return dt.datetime.combine(day, clock)


def flow(data: bytes) -> Decoded:
    """A column for each parameter by its short name; further data sets of the file follow as rows."""
    blocks: list[dict[str, np.ndarray]] = []
    base, metadata, names = 0, {}, []
    while True:
        keys, begin, stop = _keywords(data, base)
        if keys.get("$MODE", "L") != "L":
            raise RecordFormatError(f"Mode {keys['$MODE']} is not supported", base)
        kind, big = keys.get("$DATATYPE", "I"), keys.get("$BYTEORD", "").replace(" ", "") in ("4,3,2,1", "2,1")
        n_par = 0
        while f"$P{n_par + 1}B" in keys or f"$P{n_par + 1}N" in keys:
            n_par += 1
        if int(keys.get("$PAR", n_par)) < n_par:
            raise RecordFormatError("More parameters than $PAR says", base)
        n_par = int(keys.get("$PAR", n_par))
        own, bits, ranges = [], [], []
        for p in range(1, n_par + 1):
            name = keys.get(f"$P{p}N", f"P{p}")
            own.append(name if name not in own else f"{name}_{p}")  # parameters of one name stay apart
            b = keys.get(f"$P{p}B", "0")
            if b == "*":
                raise RecordFormatError("Delimited ASCII is not supported", base)
            bits.append(int(b))
            ranges.append(math.ceil(float(keys.get(f"$P{p}R", "0") or 0)))
        if kind not in "ADFI" or len(kind) != 1:
            raise RecordFormatError(f"Unknown data type {kind}", base)
        if kind == "D" and any(b != 64 for b in bits) or kind == "F" and any(b != 32 for b in bits):
            raise RecordFormatError("Wrong number of bits for the data type", base)
        if kind == "I" and any(b not in (8, 16, 24, 32, 64) for b in bits):
            raise RecordFormatError("Unsupported number of bits", base)
        sizes = bits if kind == "A" else [b // 8 for b in bits]
        total, n = sum(sizes), int(keys.get("$TOT", 0))
        if n < 0 or begin + n * total > len(data):
            raise RecordFormatError("Data segment ends early", begin)
        raw = np.frombuffer(data, np.uint8, n * total, begin).reshape(n, total) if n and total else np.zeros((0, max(total, 1)), np.uint8)
        columns, at = {}, 0
        for name, size, b, r in zip(own, sizes, bits, ranges):
            cell = np.ascontiguousarray(raw[:, at : at + size])
            at += size
            if kind in "DF":
                columns[name] = cell.view((">" if big else "<") + ("f8" if kind == "D" else "f4"))[:, 0].astype(np.float64) if n else np.zeros(0)
            elif kind == "A":
                try:
                    columns[name] = np.array([float(bytes(x)) for x in cell], np.float64)
                except ValueError:
                    raise RecordFormatError("Invalid number", begin) from None
            else:
                v = _integers(cell, b, big)
                if r > 0 and (v > np.uint64(r)).any():
                    if r & (r - 1):
                        raise RecordFormatError("Range is not a power of two", begin)
                    v = np.where(v > np.uint64(r), v & np.uint64(r - 1), v)
                columns[name] = np.minimum(v, np.uint64((1 << 63) - 1)).astype(np.int64)
        if not blocks:
            names = own
            metadata = {v: keys[k] for k, v in KEYS.items() if k in keys} | {"date": _date(keys)}
        elif own != names:
            raise RecordFormatError("Data sets have different parameters", base)
        blocks.append(columns)
        following = int(keys.get("$NEXTDATA", 0) or 0)
        if not following:
            break
        base += following
    return Decoded({k: pa.array(np.concatenate([b[k] for b in blocks])) for k in names}, metadata)
