"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Sizes, checksums and two random numbers of every row are written to the
   shared folder, so that they stay what they are whichever tasks run again.
   By the first, rows fall into blocks, and are counted by block: equal rows and
   rows without an id spread like all others.
2. How many rows each block sends to each cell is drawn, exactly as a uniform
   permutation of all rows would have it (multivariate hypergeometric, cell by
   cell).  A cell is one of ``cells`` runs of slots of a shard, its size known
   beforehand; with them a shard of any size is dealt with by many tasks.
3. Rows are permuted within their block; the first go to cell 0, and so on.
4. After the exchange, rows are permuted again within their cell, which gives
   their slots.

There are as many blocks, and as many cells of all shards, as rows make at
``EACH`` rows a block, 256 and 192 at least; so a task's rows stay few.  The
matrix, blocks x cells, is broadcast up to ``TOLD`` numbers (reached at about
40 000 million rows) and joined beyond.  Only identifiers, sizes and checksums
are shuffled, twice.  The same seed on the same files gives the same shards.

Defined results: a null text has 0 bytes and the checksum of the empty text;
null ids are dealt like others; repeated rows are equal and take any of their
slots; an empty table gives an empty table; with fewer rows than shards, some
shards stay empty; other columns are not read.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordframe.llm.common import materialize, table

OVERHEAD = 8  #: bytes that a row has besides its text
EACH = 1 << 24  #: rows of a block
TOLD = 6_000_000  #: numbers of the matrix that are broadcast at most


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; by inversion outward from the mode, so exact for any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    p = math.exp(
        lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(n - mode + 1) - lg(bad - n + mode + 1)
        - lg(good + bad + 1) + lg(n + 1) + lg(good + bad - n + 1)
    )
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up + p_down < 1e-18:  # what is left is rounding
            break
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A matrix with these sums, distributed as under a uniform permutation."""
    if sum(rows) != sum(columns):
        raise ValueError("rows and columns must have the same sum")
    rng = random.Random(seed)
    left = list(columns)
    out = []
    for n in rows:
        rest, row = sum(left), []
        for j, c in enumerate(left):
            rest -= c
            x = hypergeometric(rng, c, rest, n)
            row.append(x)
            left[j] -= x
            n -= x
        out.append(row)
    return out


def _parts(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def shuffle(
    documents: DataFrame, shards: int = 24, cells: int | None = None, blocks: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; cells of a shard and blocks follow from the number of rows if they are not given."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = materialize(
        documents.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.rand(seed).alias("first"),
            F.rand(seed + 1).alias("second"),
        )
    )
    total = held.count()
    blocks = blocks or max(256, -(-total // EACH))
    cells = cells or max(8, -(-total // (EACH * shards)))
    block = F.floor(F.col("first") * blocks).cast("int")
    counted = dict(held.groupBy(block.alias("b")).count().collect())  # one row for each block
    counts = [counted.get(b, 0) for b in range(blocks)]
    per_shard = _parts(total, shards)
    matrix = communication_matrix(counts, [c for s in per_shard for c in _parts(s, cells)], seed)
    bounds = F.from_json(F.lit(json.dumps([list(accumulate(row)) for row in matrix])), "array<array<bigint>>")
    slim = held.withColumn("block", block)
    number = F.col("id").cast("int")
    table_of = documents.sparkSession.range(blocks).select(number.alias("block"), F.element_at(bounds, number + 1).alias("bounds"))
    if blocks * shards * cells <= TOLD:
        table_of = F.broadcast(table_of)

    ties = ["text_crc32", "size"]
    place = F.row_number().over(Window.partitionBy("block").orderBy("first", *ties)).cast("long") - 1
    sent = slim.withColumn("place", place).join(table_of, "block")
    sent = sent.withColumn("cell", F.size(F.filter("bounds", lambda c: c <= F.col("place"))))

    shard = F.floor(F.col("cell") / cells).cast("int")
    cell = F.col("cell") % cells
    rows = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)  # of the shard
    each = F.floor(rows / cells)
    offset = cell * each + F.least(cell, rows - each * cells)
    again = F.row_number().over(Window.partitionBy("cell").orderBy("second", "first", *ties)).cast("long") - 1
    return sent.select("doc_id", "size", "text_crc32", shard.alias("shard"), (offset + again).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
