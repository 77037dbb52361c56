"""Quality rules by repetition coverage.

Each text is cut into words, words become 64-bit values, and rolling hashes of
2 to 10 words are updated from one length to the next in numpy
(``h[n][i] = h[n-1][i] * P + w[i+n-1]``).  A stable sort finds the windows that
occur before; the characters of their words, each counted once, are the
coverage.  All work is on one document at a time: there is no shuffle, and
memory is bounded by the largest text.

The share of repeated lines counts from ``Limits.min_lines`` lines on, a
parameter: one of two lines says little.  The share of characters in repeated
lines counts for every text.

Defined results: a null or empty text has no words, so it fails the base rule;
a null id stays null; repeated rows are judged each on its own; an empty table
gives an empty table; further columns are ignored by ``assess`` and kept by
``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.llm.common import id_and_text, map_rows, table

_P = np.uint64(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Published repetition thresholds: shares of a text's word characters, or of its lines."""

    min_words: int = 50
    repeat_words_pct: int = 50
    top: dict = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    dup: dict = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    dup_lines: float = 0.30
    min_lines: int = 5  #: below, a share of lines says little; the share of characters still counts
    dup_line_chars: float = 0.20
    symbols_per_word: float = 0.1


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x + _P) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _earlier(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows in sorted order, and whether each equals the one sorted before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.concatenate(([False], s[1:] == s[:-1]))


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge)[:-1] > 0


def measure(text: bytes, limits: Limits) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, top share, dup share, dup line share)."""
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, _SPACES + _INNER))
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line.translate(None, _SPACES + _INNER))
            else:
                seen.add(line)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    by_id = np.fromiter((len(x.translate(None, _INNER)) if not x.isascii() else len(x) for x in ids), np.int64, len(ids))
    chars = by_id[w] if n else np.zeros(0, np.int64)

    repeat = 0
    if n >= 4:
        v = len(ids)
        if v < 1 << 20:
            exact = (w[:-2] * v + w[1:-1]) * v + w[2:]
        else:
            pair = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]
            exact = pair[:-1] * v + w[2:]
        order, same = _earlier(exact)
        either = same | np.concatenate((same[1:], [False]))
        if either.any():
            repeat = int(_covered(order[either], 3, n).sum())

    top_over = dup_over = False
    worst_top = worst_dup = 0.0
    if n:
        values = _mix(w.astype(np.uint64))
        h = values
        for k in range(2, 11):
            if n <= k:
                break
            h = h[:-1] * _P + values[k - 1 :]
            order, same = _earlier(_mix(h))
            if not same.any():
                break  # longer windows repeat only where shorter ones do
            if k in limits.top:
                runs = np.flatnonzero(~same)
                size = np.diff(np.concatenate((runs, [len(same)])))
                best = int(size.argmax())
                first = order[runs[best]]
                share = int(size[best]) * int(chars[first : first + k].sum()) / word_chars if size[best] > 1 else 0.0
                worst_top = max(worst_top, share)
                top_over |= share > limits.top[k]
            if k in limits.dup:
                share = int(chars[_covered(order[same], k, n)].sum()) / word_chars
                worst_dup = max(worst_dup, share)
                dup_over |= share > limits.dup[k]
    line_share = dup_lines / lines if lines else 0.0
    line_over = lines >= limits.min_lines and line_share > limits.dup_lines or bool(word_chars) and dup_line_chars / word_chars > limits.dup_line_chars
    failed = n < limits.min_words or 100 * repeat > limits.repeat_words_pct * n
    kept = not (failed or top_over or dup_over or line_over or n_symbols > limits.symbols_per_word * n)
    return n, word_chars, n_symbols, dup_lines, repeat, failed, kept, worst_top, worst_dup, line_share


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, top_share double, dup_share double, dup_line_share double"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3


def assess(documents: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of measures and the verdict for every document."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [measure(t.as_py(), limits) for t in b.column(1)]
        cols = list(zip(*rows)) if rows else [()] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=["doc_id", *(x.split()[0] for x in _COLUMNS.split(", "))])

    return map_rows(id_and_text(documents, id_col, text_col), run, f"doc_id long, {_COLUMNS}")


def keep(documents: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The documents that pass, all their columns as they were."""

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t.as_py() or b"", limits)[6] for t in texts], pa.bool_())

    return documents.filter(passes(F.col(f"`{text_col}`").cast("string").cast("binary")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
