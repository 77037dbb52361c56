"""Delimited text: dialects, types inferred from all cells, strict rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa

from recordframe.formats.base import Decoded, RecordFormatError

# Candidate delimiters in order of preference, and type masks (all cells of a column are ANDed).
DELIMITERS = "\t;:|~,^ "
STRING, BOOLEAN, FLOAT, INTEGER = 1, 2, 4, 8
TRUE = ("T", "t", "TRUE", "True", "true")
FALSE = ("F", "f", "FALSE", "False", "false")
_INT = re.compile(r"[0-9+\- ]*[0-9][0-9+\- ]*")
_FLOAT = re.compile(r"[0-9+\- .,]*[0-9][0-9+\- .,]*")


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    quote: str
    skip_lines: int


def split(line: str, delimiter: str, quote: str) -> list[str]:
    """Cells of a line; quotes must touch delimiters, and are doubled inside quotes."""
    if quote not in line:
        return line.split(delimiter)
    cells, at = [], 0
    while True:
        if line.startswith(quote, at):
            cell, at = [], at + 1
            while True:
                end = line.find(quote, at)
                if end < 0:
                    raise RecordFormatError("Quoted cell is not closed", at)
                cell.append(line[at:end])
                at = end + 1
                if not line.startswith(quote, at):
                    break
                cell.append(quote)
                at += 1
            if at < len(line) and not line.startswith(delimiter, at):
                raise RecordFormatError("Quotes are not next to a delimiter", at)
            cells.append("".join(cell))
        else:
            end = line.find(delimiter, at)
            end = len(line) if end < 0 else end
            cells.append(line[at:end])
            at = end
        if at >= len(line):
            return cells
        at += len(delimiter)


def sniff(sample: str) -> Dialect:
    """The delimiter whose count varies least over the lines, the commoner quote, and where regular lines begin."""
    lines = sample.split("\n")[:-1]
    quote = "'" if sample.count("'") > sample.count('"') else '"'
    best, least = ",", None
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        mean = sum(counts) / len(counts) if counts else 0.0
        if mean < (3 if d == " " else 1):
            continue
        spread = sum((x - mean) ** 2 for x in counts) / len(counts)
        if least is None or spread < least:
            best, least = d, spread
    counts = [x.count(best) for x in lines]
    mean = sum(counts) / len(counts) if counts else 0.0
    begin, run = 0, 0
    for i, n in enumerate(counts):
        if abs(n - mean) < 1:
            begin = i if not run else begin
            run += 1
            if run > 5:
                break
        else:
            run = 0
    return Dialect(best, quote, begin)


def cell_mask(cell: str) -> int:
    """The types a cell can have."""
    cell = cell.strip()
    if cell in TRUE or cell in FALSE:
        return STRING | BOOLEAN
    if _INT.fullmatch(cell):
        return STRING | INTEGER
    if _FLOAT.fullmatch(cell) and ("." in cell or "," in cell):
        return STRING | FLOAT
    return STRING


def column_type(mask: int) -> int:
    return next(t for t in (INTEGER, FLOAT, BOOLEAN, STRING) if mask & t or t == STRING)


def coerce(cells: list[str], kind: int) -> pa.Array:
    """A column of that type if every cell is of it, else the text as it was."""
    if kind == BOOLEAN:
        return pa.array([c.strip() in TRUE for c in cells], pa.bool_())
    if kind == STRING:
        return pa.array(cells, pa.string())
    try:
        return pa.array(cells, pa.string()).cast(pa.int64() if kind == INTEGER else pa.float64())
    except pa.ArrowInvalid:  # spaces, signs, and cells that are no numbers
        pass
    make = int if kind == INTEGER else float
    low, high = -(1 << 63), (1 << 63) - 1

    def one(c: str):
        try:
            v = make(c.strip())
            return v if kind == FLOAT or low <= v <= high else None
        except ValueError:
            return None

    found = [one(c) for c in cells]
    return pa.array(cells, pa.string()) if None in found else pa.array(found, pa.int64() if kind == INTEGER else pa.float64())


def table(data: bytes, delimiter: str | None = None, quote: str | None = None, skip_lines: int | None = None, infer_types: bool = True) -> Decoded:
    """The first line after those skipped has the names; every further line as many cells."""
    text = data.decode("utf-8", "replace")
    found = sniff(text if text.endswith("\n") else text + "\n")
    d, q = delimiter or found.delimiter, quote or found.quote
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines and not lines[-1]:
        lines.pop()
    lines = lines[found.skip_lines if skip_lines is None else skip_lines :]
    if not lines:
        return Decoded({})
    names = split(lines[0], d, q)
    rows = []
    for i, line in enumerate(lines[1:]):
        cells = split(line, d, q)
        if len(cells) != len(names):
            raise RecordFormatError(f"A row has {len(cells)} cells and not {len(names)}", None, i)
        rows.append(cells)
    columns = list(zip(*rows)) if rows else [()] * len(names)
    out = {}
    for name, cells in zip(names, columns):
        mask = INTEGER | FLOAT | BOOLEAN | STRING if cells and infer_types else STRING
        for c in set(cells) if infer_types else ():
            mask &= cell_mask(c)
            if mask == STRING:
                break
        out[name] = coerce(list(cells), column_type(mask))
    return Decoded(out)
