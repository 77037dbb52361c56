"""Mixing sources to target weights by iterative proportional fitting.

1. Topics: a few centroids of hashed word frequencies, fitted on all documents
   of ``LEAST`` words or more (on all with a word, if there are none): words are
   hashed once, and each round of the fit is a pass over what was counted.
   Every document takes the nearest.  Frequencies and centroids are multiples of
   1 / ``UNIT``, so that sums and distances are exact, whatever the order and the
   partitions.
2. Words are counted by source, language and topic over all documents; every
   source and language is a category of its own.
3. Raking scales the cells to the target marginals in turn until all hold: on
   the driver up to ``CELLS`` cells, by grouped sums of a table beyond that.
4. A document is wanted as often as its cell's raked weight over the words there
   are, scaled so that ``fraction`` of all words is expected; that is
   ``probability``, and may exceed 1.  It stays that often, rounded up or down by
   a hash of its id, so reruns agree and what is kept has the target weights.

Defined results: a null text has no words and
falls in the first topic; null sources and languages are a category of their
own (empty name); rows with equal ids are kept or dropped together, rows
without an id by their text; an empty table gives an empty result; other
columns are not read by ``assign`` and are kept by ``sample``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.llm.common import map_rows, materialize, table, tidy
from recordframe.llm.hashing import U, mix, word_hashes

TOPICS, WIDTH = 6, 128
LEAST = 20  #: shorter texts say nothing of topics
UNIT = 1 << 20
CELLS = 50_000


def words(text: bytes) -> tuple[int, np.ndarray]:
    """How many words, and how many of each remainder of their hashes."""
    h = word_hashes(text)
    return len(h), np.bincount((h % U(WIDTH)).astype(np.int64), minlength=WIDTH)


def features(counts: np.ndarray) -> np.ndarray:
    """A line each: the roots of the shares, a unit vector but for rounding; zeros without words."""
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))
    return np.rint(np.sqrt(share) * UNIT) / UNIT


def distances(centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared, of each line of x to each centroid; exact, as all are multiples of 1 / UNIT up to 1."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


def topics(centroids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return distances(centroids, features(counts)).argmin(1)


def _counts(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of COUNTED, some at a time, with their counts as lines."""
    for at in range(0, b.num_rows, 1_024):
        some = b.slice(at, 1_024)
        yield some, np.frombuffer(b"".join(some.column("f").to_pylist()), np.int32).reshape(-1, WIDTH)


COUNTED = "source string, lang string, h long, n long, f binary"


def _draw(centroids: np.ndarray | None):
    """Of a task: the row that wins a race in which the squared distance to the nearest centroid is the speed."""
    turn = U(0 if centroids is None else len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for some, counts in _counts(b):
                h = some.column("h").to_numpy(zero_copy_only=False)
                far = np.ones(len(counts)) if centroids is None else distances(centroids, features(counts)).min(1)
                u = ((mix(h.view(np.uint64) + turn) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
                when = np.divide(-np.log(u), far, out=np.full(len(u), np.inf), where=far > 0)
                i = int(when.argmin())
                if when[i] < np.inf:
                    found = float(when[i]), int(h[i]), counts[i].tobytes()
                    best = min(best or found, found)
        yield pa.RecordBatch.from_pylist([dict(zip(("t", "h", "f"), best))] if best else [], pa.schema([("t", pa.float64()), ("h", pa.int64()), ("f", pa.binary())]))

    return run


def _sums(centroids: np.ndarray):
    """Of a task: by topic, how many rows (place -1), and their sum at each place in parts of UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), WIDTH + 1), np.int64)
        for b in batches:
            for _, counts in _counts(b):
                x = features(counts)
                near = distances(centroids, x).argmin(1)
                total[:, 0] += np.bincount(near, minlength=len(centroids))
                total[:, 1:] += ((near == np.arange(len(centroids))[:, None]).astype(float) @ (x * UNIT)).astype(np.int64)
        at, place = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place - 1, pa.int32()), pa.array(total.ravel())], names=["topic", "place", "total"])

    return run


def fit_topics(counted: DataFrame, k: int = TOPICS, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's method from seeds drawn by squared distance, on all rows of COUNTED with enough words."""
    most = counted.agg(F.max("n")).first()[0] or 0
    if not most:
        return np.zeros((1, WIDTH))
    rows = counted.filter(F.col("n") >= (LEAST if most >= LEAST else 1)).select("h", "f")
    c = None
    while c is None or len(c) < k:
        first = rows.mapInArrow(tidy(_draw(c)), "t double, h long, f binary").orderBy("t", "h", "f").limit(1).collect()
        if not first:
            break
        seed = features(np.frombuffer(first[0].f, np.int32)[None])
        c = seed if c is None else np.concatenate([c, seed])
    for _ in range(rounds):
        total = np.zeros((len(c), WIDTH + 1))
        for r in rows.mapInArrow(tidy(_sums(c)), "topic int, place int, total long").groupBy("topic", "place").agg(F.sum("total").alias("total")).collect():  # TOPICS times WIDTH + 1
            total[r.topic, r.place + 1] = r.total
        n = total[:, :1]
        now = np.where(n > 0, np.rint(total[:, 1:] / np.maximum(1, n)) / UNIT, c)
        if (now == c).all():
            break
        c = now
    return c


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = 500, close: float = 1e-10) -> dict[tuple, float]:
    """Cells scaled so that their sums by each part of the key come to the targets' shares of the whole."""
    keys = list(cells)
    if not keys:
        return {}
    w = np.array([cells[k] for k in keys], float)
    whole = w.sum()
    sides = []
    for d, target in enumerate(targets):
        names = {n: i for i, n in enumerate(sorted({k[d] for k in keys}))}
        share = np.array([target[n] for n in names], float)
        sides.append((np.array([names[k[d]] for k in keys]), share / share.sum() * whole))
    for _ in range(rounds):
        worst = 0.0
        for at, want in sides:
            have = np.bincount(at, w, len(want))
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            worst = max(worst, float(np.abs(np.where(have > 0, scale, 1) - 1).max()))
            w = w * scale[at]
        if worst < close:
            break
    return dict(zip(keys, w.tolist()))


def calibrate(tokens: dict[tuple, float], weights: dict[tuple, float], fraction: float) -> dict[tuple, float]:
    """Probabilities in proportion to weight over tokens, 1 at most, that keep ``fraction`` of the tokens."""
    ratio = {k: weights[k] / n for k, n in tokens.items() if n > 0}
    whole = sum(tokens.values())
    low, high = 0.0, 1.0 / min([r for r in ratio.values() if r > 0], default=1.0)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(1.0, mid * r) * tokens[k] for k, r in ratio.items()) < fraction * whole:
            low = mid
        else:
            high = mid
    return {k: min(1.0, high * ratio[k]) if k in ratio else 1.0 for k in tokens}


class Tempered:
    """The words seen to a power: below 1 lifts the rare ones."""

    def __init__(self, power: float):
        self.power = power

    def __call__(self, seen: dict) -> dict:
        return {k: v**self.power for k, v in seen.items()}

    def column(self, seen: Column) -> Column:
        return F.pow(seen, F.lit(self.power))


PARTS = ("source", "lang", "topic")


def rake_table(cells: DataFrame, targets: tuple, rounds: int = 100, close: float = 1e-6) -> DataFrame:
    """``rake`` for cells (source, lang, topic, n) of any number: with their weight ``w``, which keeps the sum of n."""
    whole = cells.agg(F.sum("n")).first()[0]
    wants = []
    for part, target in zip(PARTS, targets):
        seen = cells.groupBy(part).agg(F.sum("n").cast("double").alias("v"))
        if isinstance(target, Tempered):
            seen = seen.withColumn("want", target.column(F.col("v")))
        else:
            given = target({r[0]: r.v for r in seen.collect()})
            seen = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{part} {cells.schema[part].dataType.simpleString()}, want double")
        total = seen.agg(F.sum("want")).first()[0]
        wants.append(materialize(seen.select(part, (F.col("want") * F.lit(whole / total)).alias("want"))))
    now = cells.withColumn("w", F.col("n").cast("double"))
    for _ in range(rounds):
        worst = F.lit(0.0)
        for part, want in zip(PARTS, wants):
            scale = now.groupBy(part).agg(F.sum("w").alias("have")).join(want, part, "left").select(part, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias(f"by_{part}"))
            now = now.join(scale, part).withColumn("w", F.col("w") * F.col(f"by_{part}"))
            worst = F.greatest(worst, F.abs(F.col(f"by_{part}") - 1))
        now = materialize(now.withColumn("off", worst).select(*PARTS, "n", "w", "off"))
        done = now.agg(F.max("off")).first()[0] < close
        now = now.drop("off")
        if done:
            break
    return now


@dataclass(frozen=True)
class Plan:
    centroids: np.ndarray
    tokens: dict | None  #: None, as weights, with more than CELLS cells
    weights: dict | None
    probability: DataFrame  #: by source, lang and topic

    def copies(self, tagged: DataFrame, keys: tuple, chance: str, own: str = "") -> DataFrame:
        """tagged with ``probability`` and, from it and the column of chances, ``copies``, after ``own`` in the names."""
        out = f"{own}probability", f"{own}copies"
        of = self.probability.select(*(F.col(c).alias(f"{own}__{c}") for c in PARTS), F.col("probability").alias(f"{own}__p"))
        of = of if self.tokens is None else F.broadcast(of)
        joined = tagged.join(of, [F.coalesce(F.col(k), F.lit("")) == F.col(f"{own}__{c}") if c != "topic" else F.col(k) == F.col(f"{own}__topic") for k, c in zip(keys, PARTS)], "left")
        p = F.coalesce(f"{own}__p", F.lit(1.0))
        return joined.withColumn(out[0], p).withColumn(out[1], (F.floor(p) + (F.col(chance) < p - F.floor(p)).cast("long")).cast("int"))


def _tempered(power: float) -> Tempered:
    return Tempered(power)


def _text(documents: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")


def plan(
    documents: DataFrame, fraction: float = 0.8, targets: tuple = (_tempered(0.7), _tempered(0.7), _tempered(0.5)),
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", language_col: str = "lang",
) -> Plan:
    """Statistics of all documents, raked.

    targets: for source, language and topic, a function from the words seen by
    category to the weights wanted; the default lifts the rare ones.
    """

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        told = [words(t.as_py()) for t in b.column("t")]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([n for n, _ in told], pa.int64()), pa.array([f.astype(np.int32).tobytes() for _, f in told], pa.binary())], names=["source", "lang", "h", "n", "f"])

    text = _text(documents, text_col)
    slim = documents.select(name(source_col).alias("source"), name(language_col).alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"), text.alias("t"))
    counted = materialize(map_rows(slim, count, COUNTED), compression="zstd")
    centroids = fit_topics(counted)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for some, counts in _counts(b):
            for s, lang, n, t in zip(*(some.column(c).to_pylist() for c in ("source", "lang", "n")), topics(centroids, counts).tolist()):
                seen[s, lang, t] = seen.get((s, lang, t), 0) + n
        cols = list(zip(*seen)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["source", "lang", "topic", "n"])

    by_batch = map_rows(counted, run, "source string, lang string, topic int, n long")
    cells = materialize(by_batch.groupBy(*PARTS).agg(F.sum("n").alias("n")))
    spark = documents.sparkSession
    if cells.count() > CELLS:
        raked = rake_table(cells, targets)
        return Plan(centroids, None, None, materialize(raked.select(*PARTS, F.when(F.col("n") > 0, F.col("w") * fraction / F.col("n")).otherwise(1.0).alias("probability"))))
    tokens = {(r.source, r.lang, r.topic): float(r.n) for r in cells.collect()}  # CELLS at most
    wanted = []
    for d, target in enumerate(targets):
        seen: dict = {}
        for k, n in tokens.items():
            seen[k[d]] = seen.get(k[d], 0.0) + n
        wanted.append(target(seen))
    weights = rake(tokens, wanted)
    found = [(*k, fraction * weights[k] / n if n > 0 else 1.0) for k, n in tokens.items()]
    return Plan(centroids, tokens, weights, spark.createDataFrame(found, "source string, lang string, topic int, probability double"))


def _topics(centroids: np.ndarray, texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Of each text, how many words and the topic."""
    n, found = [], []
    for at in range(0, len(texts), 1_024):
        told = [words(t) for t in texts[at : at + 1_024]]
        n += [k for k, _ in told]
        found += topics(centroids, np.array([f for _, f in told])).tolist()
    return n, found


def _chance(doc_id: int | None, text: bytes, seed: int) -> float:
    """In [0, 1), the same for the same document."""
    return xxhash.xxh3_64_intdigest(text if doc_id is None else str(doc_id).encode(), seed) / 2.0**64


def assign(documents: DataFrame, p: Plan, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", language_col: str = "lang") -> DataFrame:
    """doc_id, source and language (empty for null), topic, n_tokens, probability, kept, copies."""
    centroids = p.centroids

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, raw = [], [t.as_py() for t in b.column(3)]
        for n, t, i, text in zip(*_topics(centroids, raw), b.column(0).to_pylist(), raw):
            rows.append((t, n, _chance(i, text, seed)))
        cols = list(zip(*rows)) or [()] * 3
        more = [pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.float64()])]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], names=["doc_id", "source", "lang", "topic", "n_tokens", "chance"])

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), name(source_col).alias("source"), name(language_col).alias("lang"), _text(documents, text_col).alias("t"))
    tagged = map_rows(slim, run, "doc_id long, source string, lang string, topic int, n_tokens long, chance double")
    return p.copies(tagged, PARTS, "chance").select("doc_id", *PARTS, "n_tokens", "probability", (F.col("copies") > 0).alias("kept"), "copies")


def sample(documents: DataFrame, p: Plan, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", language_col: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns, each as often as it has copies."""
    centroids, own = p.centroids, uuid.uuid4().hex
    names = [f"{own}_topic", f"{own}_chance"]

    @F.arrow_udf("struct<topic:int,chance:double>")
    def told(ids: pa.Array, texts: pa.Array) -> pa.Array:
        raw = [t.as_py() for t in texts]
        found = _topics(centroids, raw)[1]
        chances = [_chance(i, t, seed) for i, t in zip(ids.to_pylist(), raw)]
        return pa.StructArray.from_arrays([pa.array(found, pa.int32()), pa.array(chances, pa.float64())], ["topic", "chance"])

    told = told.asNondeterministic()  # else it is worked out before the join and again after it
    whole = [F.col(f"`{c}`") for c in documents.columns]
    tagged = documents.withColumn(f"{own}_t", told(F.col(f"`{id_col}`").cast("long"), _text(documents, text_col)))
    tagged = tagged.withColumns({names[0]: F.col(f"{own}_t.topic"), names[1]: F.col(f"{own}_t.chance"), f"{own}_s": F.col(f"`{source_col}`").cast("string"), f"{own}_l": F.col(f"`{language_col}`").cast("string")})
    kept = p.copies(tagged, (f"{own}_s", f"{own}_l", names[0]), names[1], own).filter(F.col(f"{own}copies") > 0)
    return kept.select(*whole, F.explode(F.sequence(F.lit(1), F.col(f"{own}copies"))).alias(f"{own}_copy")).drop(f"{own}_copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return assign(documents, plan(documents)).filter("kept").drop("kept")
