"""64-bit hashes of the words of a text, by prefix sums in numpy; A-Z count as a-z."""

from __future__ import annotations

import re

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_VALUE = mix(_LOWER)
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2 ** 64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


BLOCK = 1 << 17  #: bytes that are worked on at a time, at 40 bytes of memory each
_SPACE = re.compile(rb"[ \t-\r]")


def word_hashes(text: bytes) -> np.ndarray:
    """A value for each word, in order; words are runs of bytes other than space and 0x09-0x0D.

    A word's value does not depend on its place, so long texts are cut between words.
    """
    if len(text) <= BLOCK:
        return _hashes(text)
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        parts.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def _hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ~IS_SPACE[b], [False]))))
    if not len(edges):
        return np.zeros(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * power[: len(b)])))
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
