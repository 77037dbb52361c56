"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it (one pass;
the pivots are a fixed number of vectors chosen by hash).  Distances are counted
in ``BINS`` bins for each pivot, and neighbouring bins make blocks of up to
``BLOCK`` rows, so a block is an annulus.  A bin with more rows, even a third of
all and all equal, is many blocks, between which its rows are dealt.

A query first searches the block that holds it, which gives its threshold,
the k-th best score so far.  The triangle inequality bounds the scores that the
vectors of a pivot within some distances can have:

    q.x <= q.p + |q| d(x, p)
    2 q.x <= |q|^2 + |x|^2 - (d(q, p) - d(x, p))^2  outside that annulus

Only the blocks whose bound reaches the threshold are visited; in each, the
sorted annuli are expanded from the best bound on, until no bound reaches the
k-th best score.  A block is sent once for every ``CHUNK`` queries that need it,
and not at all where none does, so both sides of every group have a bounded
number of rows.

Components are integers, floor(1024 x), and scores are exact.  Defined results:
vectors that are null or have null or non-finite components take no part, nor
do rows without an id; an empty vector scores 0; shorter vectors count as
padded with zeros; rows with the query's id are its own; equal scores go by the
smaller id, repeated rows each count; products beyond 64 bits count as the
nearest 64-bit number; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordframe.llm.common import map_rows, materialize, one_thread, table

PIVOTS, BLOCK, CHUNK, ANNULUS, BINS = 32, 4096, 4096, 256, 1024
_TOLD = 1_000_000  #: rows of up to 50 bytes that are broadcast at most
_EXACT = 2.0**53


def _matrix(rows) -> np.ndarray:
    rows = [np.asarray(r, np.int64) for r in rows]
    out = np.zeros((len(rows), max([1, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == n else np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in floating point: only used for bounds, which are given slack."""
    a, b = (x.astype(np.float64) for x in _same_width(a, b))
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    a, b = _same_width(a, b)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _bound(dot: np.ndarray, norm: np.ndarray, apart: np.ndarray, low, high, most) -> np.ndarray:
    """The highest score that a vector at distance low..high from the pivot, of a norm up to ``most``, can have.

    dot, norm, apart: of the queries, their product with the pivot, norm, and distance from it.
    """
    gap = np.maximum(0, np.maximum(apart - high, low - apart))
    best = np.minimum(dot + norm * high, (norm**2 + most**2 - gap**2) / 2)
    return best + 1 + 1e-6 * (np.abs(best) + norm * (high + most))


def keyed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, pivot, far (the distance from it), norm, deal (that equal rows can be dealt by)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        m = _matrix(b.column(1).to_pylist())
        d = _distances(m, pivots)
        near = d.argmin(1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(m)), near]), pa.array(np.sqrt((m.astype(np.float64) ** 2).sum(1))), pa.array(np.arange(len(m), dtype=np.int32))], names=["vec_id", "v", "pivot", "far", "norm", "deal"])

    return map_rows(vectors, run, "vec_id long, v array<long>, pivot int, far double, norm double, deal int")


def annuli(bins: list, most: int) -> list[tuple]:
    """(pivot, first bin, last bin, rows, least distance, greatest, greatest norm) of runs of bins of up to ``most`` rows, or of one bin.

    bins: (pivot, bin, rows, least distance, greatest, greatest norm), in any order.
    """
    out: list[tuple] = []
    for p, b, n, low, high, norm in sorted(bins):
        if out and out[-1][0] == p and out[-1][3] + n <= most:
            _, start, _, m, least, _, size = out[-1]
            out[-1] = (p, start, b, m + n, least, high, max(size, norm))
        else:
            out.append((p, b, b, n, low, high, norm))
    return out


def _search(pivots: np.ndarray, k: int):
    """Of a block and the queries that visit it: each query's best k of the block."""

    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_key": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(block) or not len(queries):
            return none
        one_thread()
        block = block.sort_values(["far", "vec_id"], kind="stable")
        ids, x, far, norm = block["vec_id"].to_numpy(), _matrix(block["v"]), block["far"].to_numpy(), block["norm"].to_numpy()
        p = pivots[int(block["pivot"].iloc[0])][None]
        starts = np.arange(0, len(ids), ANNULUS)
        ends = np.minimum(starts + ANNULUS, len(ids))
        out = []
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            q, own = _matrix(some["v"]), some["query_id"].to_numpy()
            size, apart, dot = some["norm"].to_numpy(), _distances(q, p)[:, 0], _products(q, p)[:, 0].astype(float)
            kth = some["kth"].to_numpy().astype(float).copy()
            bounds = np.stack([_bound(dot, size, apart, far[a], far[b - 1], norm[a:b].max()) for a, b in zip(starts, ends)], 1)
            best: list[list[tuple[int, int]]] = [[] for _ in own]
            for j in bounds.max(0).argsort()[::-1]:
                todo = np.flatnonzero(bounds[:, j] >= kth)
                if not len(todo):
                    continue
                a, b = starts[j], ends[j]
                scores = _products(q[todo], x[a:b])
                for i, row in zip(todo, scores):
                    fit = np.flatnonzero((row >= kth[i]) & (ids[a:b] != own[i]))
                    if not len(fit):
                        continue
                    order = np.lexsort((ids[a:b][fit], -row[fit]))[:k]
                    best[i] = sorted([*best[i], *zip((-row[fit][order]).tolist(), ids[a:b][fit][order].tolist())])[:k]
                    if len(best[i]) == k:
                        kth[i] = max(kth[i], -best[i][-1][0])
            for i, found in enumerate(best):
                out += [(own[i], some["query_key"].iloc[i], v, -s) for s, v in found]
        return pd.DataFrame(out, columns=none.columns) if out else none

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows for which the Column ``is_query`` holds, the k best of all others."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~bad)
    rows = sound.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("v"))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # a fixed number
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = _matrix([r.v for r in chosen])
    held = materialize(keyed(rows, points))
    reach = {r.pivot: (r.low, r.high) for r in held.groupBy("pivot").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # a row for each pivot
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for p, v in reach.items() for x in (p, v[i]))), F.col("pivot"))
    span = of(1) - of(0)
    bin_of = F.when(span > 0, F.least(F.floor((F.col("far") - of(0)) / span * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
    binned = held.withColumn("bin", bin_of)
    counted = binned.groupBy("pivot", "bin").agg(F.count("*"), F.min("far"), F.max("far"), F.max("norm")).collect()  # pivots x BINS rows at most
    runs = annuli([tuple(r) for r in counted], block)
    parts = [-(-r[3] // block) for r in runs]
    first = np.concatenate(([0], np.cumsum(parts))).astype(int)  # of the blocks of each run
    whose = spark.createDataFrame([(r[0], b, int(first[i]), parts[i]) for i, r in enumerate(runs) for b in range(r[1], r[2] + 1)], "pivot int, bin int, first int, parts int")
    dealt = F.pmod(F.xxhash64("vec_id", "deal"), F.col("parts"))
    candidates = binned.join(F.broadcast(whose), ["pivot", "bin"]).withColumn("block", (F.col("first") + dealt).cast("int")).drop("bin", "first", "parts", "deal")

    asked = candidates.withColumnRenamed("vec_id", "query_id").filter(is_query("query_id")).withColumn("query_key", F.xxhash64("v"))
    asked = materialize(asked.drop("far", "pivot").dropDuplicates(["query_id", "query_key"]))
    found = "query_id long, query_key long, vec_id long, score long"

    def visit(queries: DataFrame, load: DataFrame) -> DataFrame:
        """Each block meets the queries that are sent to it, in as many copies as they are chunks; load: parts of their numbers (block, n)."""
        needed = load.groupBy("block").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"))
        needed = F.broadcast(needed) if int(first[-1]) <= _TOLD else needed
        copies = candidates.join(needed, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        sent = queries.join(needed, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id", "query_key", F.lit(2)), F.col("chunks")).cast("int")).drop("chunks")
        return copies.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInPandas(_search(points, k), found)

    at_home = materialize(visit(asked.withColumn("kth", F.lit(float("-inf"))), asked.select("block", F.lit(1).alias("n"))))
    kth = at_home.groupBy("query_id", "query_key").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("k"))
    told = asked.join(kth, ["query_id", "query_key"], "left").withColumn("kth", F.coalesce("k", F.lit(float("-inf")))).drop("k").withColumnRenamed("block", "home")
    pivot_of = np.array([r[0] for r in runs])
    low, high, most = (np.array([r[i] for r in runs]) for i in (4, 5, 6))

    def reached(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Some queries, and for each block besides its own that one of them needs: the query's row, the block."""
        for at in range(0, b.num_rows, 64):
            some = b.slice(at, 64)
            t = {n: some.column(i) for i, n in enumerate(some.schema.names)}
            q, size, kth = _matrix(t["v"].to_pylist()), t["norm"].to_numpy()[:, None], t["kth"].to_numpy()[:, None]
            d, dot = _distances(q, points)[:, pivot_of], _products(q, points).astype(float)[:, pivot_of]
            row, run = np.nonzero(_bound(dot, size, d, low, high, most) >= kth)
            n = np.asarray(parts)[run]
            to = np.repeat(first[run] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            other = to != t["home"].to_numpy()[row]
            yield some, row[other], to[other].astype(np.int32)

    def route(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, row, to in reached(b):
            for i in range(0, len(row), 1 << 13):
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row[i : i + (1 << 13)])).columns, pa.array(to[i : i + (1 << 13)])], names=[*some.schema.names, "block"])

    def weigh(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, to in reached(b):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(to, return_counts=True)], names=["block", "n"])

    columns = ["query_id", "query_key", "v", "norm", "kth", "home"]
    told = told.select(*columns)
    sent = map_rows(told, route, "query_id long, query_key long, v array<long>, norm double, kth double, home int, block int")
    both = at_home.unionByName(visit(sent, map_rows(told, weigh, "block int, n long")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
