"""Offset-preserving SentencePiece (BPE) encoding, and decoding.

The model file is read once on the driver and broadcast (its size is fixed by
the vocabulary).  Normalisation walks the compiled character map, a
double-array trie, taking the longest rule at each place and noting for every
byte it writes the byte of the original where it came from.  The normalised
text falls apart at meta spaces, across which no piece of the vocabulary
reaches, so each stretch is merged on its own and remembered in a bounded
cache.  Every piece is projected through the alignment to a span of original
bytes; pieces tile the text, so their ends say it all.

Per row, no shuffle.  Defined results: a null text counts as empty and has no
pieces; null ids stay null; repeated rows are encoded each; an empty table
stays empty; further columns do not enter.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.llm.common import id_and_text, map_rows, slices, table

# Fixed values of the model format.
META = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 40_000  #: remembered stretches in each of two generations, some 200 bytes each; results do not depend on it
_META = META.encode()
_LONG = 48  #: characters up to which stretches are merged together
_NONE = np.iinfo(np.int32).max
_SCATTER = 0x9E3779B97F4A7C15

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = b[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, b[i : i + n]
            i += n


class CharMap:
    """The compiled character map: a double-array trie, and the replacements it points to."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | None = None
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.out = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest rule that starts at ``at``, and the bytes it takes."""
        units = self.units
        if units is None:
            return None

        def jump(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        found = None
        node = jump(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = self.out[start : self.out.index(b"\0", start)], i + 1 - at
        return found


class Model:
    def __init__(self, blob: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(blob):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with the meta space as a prefix are supported")
        self.map = CharMap(normalizer.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        if any(t == USER_DEFINED or t == UNUSED for _, _, t in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if not trainer.get(35, 0):
            raise ValueError("only models that fall back to bytes are supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        if META not in self.ids:
            raise ValueError("the meta space must be a piece")
        order = {x: k for k, x in enumerate(sorted({-self.pieces[i][1] for i in self.ids.values()}))}
        self.rank = {p: order[-self.pieces[i][1]] for p, i in self.ids.items()}  # equal scores share a rank: the left one goes first
        self.controls = {i for i, x in enumerate(self.pieces) if x[2] == CONTROL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.shown = [
            b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(META, " ").encode()
            for p, _, t in self.pieces
        ]
        written = [1 if t == BYTE else len(p.encode()) for p, _, t in self.pieces]
        self.written = np.array(written, np.int64)  # bytes of the normalised text that a piece stands for
        self.spaced = np.array([n - 2 * p.count(META) for n, (p, _, t) in zip(written, self.pieces)], np.int64)  # meta spaces as one byte
        loose = all(META not in p.lstrip(META) for p in self.ids)
        alone = r"\n" if not any("\n" in p for p in self.ids) else ""
        self.cut = re.compile(f"{META}*[^{META}{alone}]+|{META}+" + f"|{alone}" * bool(alone)) if loose else re.compile(r"[\s\S]+")
        self.new: dict[str, bytes] = {}  # ids as int32, a quarter of what tuples take
        self.old: dict[str, bytes] = {}
        self._pairs()

    def _pairs(self) -> None:
        """A hash table in numpy: a pair of symbols to the rank of what they merge to, and its id."""
        self.symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        self.base = base = len(self.pieces) + len(self.symbol) + 1  # higher ones: characters of no piece
        self.of_char = np.arange(base, base + 0x110000, dtype=np.int64)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        merges = {(self.symbol[p[:k]], self.symbol[p[k:]]): p for p in self.ids for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol}
        self.bits = max(4, len(merges) * 4).bit_length()
        mask = (1 << self.bits) - 1
        keys, self.table_rank, self.table_id = np.full(mask + 1, -1, np.int64), np.full(mask + 1, _NONE, np.int32), np.zeros(mask + 1, np.int64)
        for (a, b), p in merges.items():
            at = ((a << 32 | b) * _SCATTER & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while keys[at] >= 0:
                at = at + 1 & mask
            keys[at], self.table_rank[at], self.table_id[at] = a << 32 | b, self.rank[p], self.ids[p]
        self.keys = keys

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the table has each pair; the place of an empty slot where it has none."""
        key = left << 32 | right
        at = (key.view(np.uint64) * np.uint64(_SCATTER) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        miss = (there != key) & (there >= 0)
        while miss.any():
            at[miss] = at[miss] + 1 & len(self.keys) - 1
            there = self.keys[at]
            miss = (there != key) & (there >= 0)
        return at

    # -- normalisation -----------------------------------------------------

    def normalize(self, text: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte it came from."""
        out, align, at = bytearray(), [], 0
        if not text:
            return "", np.zeros(1, np.int64)

        def step() -> tuple[bytes, int]:
            if hit := self.map.longest(text, at):
                return hit
            n = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            return text[at : at + n], n

        space = META.encode() if self.escape else b" "
        if self.squeeze:
            while at < len(text):
                put, n = step()
                if put.strip(b" "):
                    break
                at += n
            if at == len(text):
                return "", np.zeros(1, np.int64) + len(text)
        if self.dummy:
            out += space
            align += [at] * len(space)
        after_space = self.squeeze
        while at < len(text):
            put, n = step()
            while after_space and put.startswith(b" "):
                put = put[1:]
            if put:
                plain = put.replace(b" ", space)
                out += plain
                align += [at] * len(plain)
                after_space = self.squeeze and put.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = align[len(out)]
                del align[len(out) :]
        return out.decode("utf-8", "replace"), np.array([*align, at], np.int64)

    # -- merging -----------------------------------------------------------

    def _merge_long(self, chars: str) -> list[int]:
        """One long stretch, by a heap of pairs."""
        rank = self.rank
        parts = list(chars)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(whole + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, whole + parts[k]))
            if (k := left[i]) >= 0 and (r := rank.get(parts[k] + whole)) is not None:
                heapq.heappush(heap, (r, k, parts[k] + whole))
        return [self.symbol.get(p, self.base + ord(p[0])) for p in parts if p]

    def _merge_all(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Many stretches of one length, a row each, merged in step: every row that is not done merges one pair a round.

        Yields (rows, their symbols) as they are done.
        """
        rows = np.arange(len(symbols))
        rank = self.table_rank[self._find(symbols[:, :-1], symbols[:, 1:])]
        while symbols.shape[1] > 1:
            at = rank.argmin(1)
            done = rank[np.arange(len(rows)), at] == _NONE
            if done.any():
                yield rows[done], symbols[done]
                go = ~done
                rows, symbols, rank, at = rows[go], symbols[go], rank[go], at[go]
                if not len(rows):
                    return
            every, k = np.arange(len(rows)), symbols.shape[1]
            merged = self.table_id[self._find(symbols[every, at], symbols[every, at + 1])]
            place = np.arange(k - 1)
            symbols = np.where(place > at[:, None], symbols[:, 1:], symbols[:, :-1])
            symbols[every, at] = merged
            rank = np.where(place[:-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            for there, which in ((at - 1, at > 0), (at, at < k - 2)):
                r, c = every[which], there[which]
                rank[r, c] = self.table_rank[self._find(symbols[r, c], symbols[r, c + 1])]
        yield rows, symbols

    def _spell(self, symbols: list[int]) -> bytes:
        """Symbols that are no pieces of their own become the bytes of their character."""
        if max(symbols) < len(self.pieces):
            return np.array(symbols, np.int32).tobytes()
        out: list[int] = []
        for s in symbols:
            if s < len(self.pieces):
                out.append(s)
            else:
                c = chr(s - self.base) if s >= self.base else next(p for p, i in self.symbol.items() if i == s)
                out += [self.bytes[b] for b in c.encode()]
        return np.array(out, np.int32).tobytes()

    def _learn(self, stretches: set[str]) -> dict[str, bytes]:
        """The ids of stretches that the cache does not have."""
        found: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for s in stretches:
            if (hit := self.old.get(s)) is not None:
                found[s] = hit
            elif len(s) > _LONG:
                found[s] = self._spell(self._merge_long(s))
            else:
                by_length.setdefault(len(s), []).append(s)
        for n, group in by_length.items():
            chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            for rows, symbols in self._merge_all(self.of_char[chars]):
                plain = symbols.max(1) < len(self.pieces)
                packed, size = symbols.astype(np.int32).tobytes(), 4 * symbols.shape[1]
                for k, (r, ok) in enumerate(zip(rows.tolist(), plain.tolist())):
                    found[group[r]] = packed[k * size : k * size + size] if ok else self._spell(symbols[k].tolist())
        if len(self.new) + len(found) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update(islice(((s, i) for s, i in found.items() if len(s) <= _LONG), CACHE))
        return found

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the end of each piece as a byte of the original; a piece begins where the one before ends."""
        straight = self.map.units is None and self.dummy and self.escape and not self.squeeze
        cut, aligned = [], []
        for text in texts:
            if straight and _META not in text:
                whole, align = META + text.decode("utf-8", "replace").replace(" ", META) if text else "", None
            else:
                whole, align = self.normalize(text)
            cut.append(self.cut.findall(whole))
            aligned.append(align)
        known = self.new
        learned = self._learn({s for x in cut for s in x if s not in known})
        out = []
        for x, align in zip(cut, aligned):
            ids = np.frombuffer(b"".join([known.get(s) or learned[s] for s in x]), np.int32)
            out.append((ids, np.cumsum(self.spaced[ids]) - 1 if align is None else align[np.cumsum(self.written[ids])]))  # less the space put before the text
        return out

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        out, run = "", []
        for i in [*ids, None] if not self.controls.isdisjoint(ids) else ():  # bytes on either side of a control piece don't join
            if i is None or i in self.controls:
                out += b"".join(map(self.shown.__getitem__, run)).decode("utf-8", "one_by_one")
                run = []
            else:
                run.append(i)
        out = out or b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "one_by_one")
        if self.dummy or self.squeeze:
            first = next((i for i in ids if i not in self.controls), None)
            if first is not None and self.pieces[first][2] == NORMAL and self.pieces[first][0].startswith(META):
                out = out.lstrip(" ") if self.squeeze else out[1:]
        return out


_models: dict[int, Model] = {}


def _model(blob: bytes) -> Model:
    key = hash(blob)
    if key not in _models:
        _models[key] = Model(blob)
    return _models[key]


def encode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, ends (of each piece, in bytes of the text), decoded."""
    with open(model_path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for keys, texts in slices(b.column(0).to_pylist(), (t.as_py() for t in b.column(1))):
            coded = m.encode(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(i) for i, _ in coded], dtype=np.int64))).astype(np.int32))
            ids = np.concatenate([i for i, _ in coded])
            ends = np.concatenate([e for _, e in coded]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(ends)), pa.array([m.decode(i.tolist()) for i, _ in coded], pa.string())],
                names=["doc_id", "ids", "ends", "decoded"],
            )

    return map_rows(id_and_text(documents, id_col, text_col), run, "doc_id long, ids array<int>, ends array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of what encode() returned; spans_hash is Spark's xxhash64 of the pieces' ends."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.xxhash64("ends").alias("spans_hash"),
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), default_model()))
