"""Near duplicates: exact Jaccard join on 5-word shingles, by signature trees.

1. Each text becomes the set of its distinct shingles (64-bit values, made by
   prefix sums in numpy).  Texts with equal sets are one class from here on.
2. Routing.  If 100 |A & B| >= 80 |A | B|, the sets differ in at most a quarter
   of the size of either.  The hash space of a size range (sizes up to twice as
   large) is cut into segments; a set of n shingles emits the contents of its
   first n / 4 + 1 segments that are not empty, as one key each.  Two sets that
   link then have a key in common: every element in which they differ spoils
   one segment only.  A set without so many filled segments emits the empty
   ones too.  Sets near the end of a size range also emit the keys of the next.
   So no link is lost, and no frequency of anything has to be counted.
3. The classes of a key are packed into a signature tree: leaves of similar
   sets, nodes with the OR of their token bitmaps and their range of sizes.  A
   token's bit is its bucket and its place among the set's tokens there, so a
   bitmap is kept as a count for each bucket, OR is the greater count, and no
   two tokens of a set share a bit.  The tree is traversed against itself: a
   pair of nodes is passed over if no two sets in it can have the sizes or the
   overlap that a link needs, or if all its sets are connected already.  What
   survives connects classes to candidate groups.
4. Each candidate group is joined by a tree in the same way, but pairs of sets
   that survive at the leaves are compared exactly.
   Keys with more than ``KEY_MEMBERS`` classes, and groups of more than
   ``MEMBERS`` shingles, are cut into blocks by hash; each pair of blocks is a
   task of its own, and their links are joined afterwards.

Nothing unbounded is collected: not links, nor groups, nor fingerprints.

Defined results: a null or empty text, or one without words, has an empty set,
links with nothing and is its own component; fewer than five words are one
shingle; rows with equal ids stay rows; a null id takes part, but a component
is named by its smallest id that is not null; an empty table stays empty; other
columns are not read by ``groups`` and are kept by ``keep_one``.  Classes and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordframe.llm.common import id_and_text, map_rows, materialize, table, tidy
from recordframe.llm.components import components
from recordframe.llm.hashing import BASE, U, mix, word_hashes

SHINGLE = 5
MEMBERS = 4_000_000  #: shingles of a block, 32 MB
KEY_MEMBERS = 100_000  #: classes of a key in a block
FANOUT = 16


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * U(BASE) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h))


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def routing_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a set; sets that link have one in common."""
    a = len(s)
    own = a.bit_length() - 1
    out = []
    mixed = mix(s)
    for label in (own, own + 1) if 5 * a >= 4 << own + 1 else (own,):
        k = (2 << label) * 11 // 40 + 5
        segment = (s >> U(32)) * U(k) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        which = segment[first]
        content = np.add.reduceat(mixed, first)
        need = a // 4 + 1
        out.append(mix(content[:need] ^ mix(which[:need] + U(label << 40))))
        if len(first) < need:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), which)
            out.append(mix(U(1) ^ mix(empty + U(label << 40))))
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * len(a) < 4 * len(b) or 5 * len(b) < 4 * len(a):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * both >= 80 * (len(a) + len(b) - both)


class Forest:
    """Union-find; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("children", "rows", "bits", "low", "high", "whole")

    def __init__(self, children, rows, bits, low, high):
        self.children, self.rows, self.bits, self.low, self.high, self.whole = children, rows, bits, low, high, False


def buckets(size: int) -> int:
    """Counts in the signature of a set: a power of two, an eighth to a quarter of the size or more."""
    return max(32, 1 << max(0, size.bit_length() - 3))


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """The set's token bitmap over n buckets, as a count for each (255 stands for more)."""
    return np.minimum(np.bincount((s & U(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8)


def _folded(x: np.ndarray, n: int) -> np.ndarray:
    """A signature over fewer buckets."""
    return x.reshape(-1, n).sum(0) if len(x) > n else x


class SignatureTree:
    """Signatures under nodes with OR-combined bitmaps and size ranges; its self-join links those for which ``same`` holds."""

    def __init__(self, signatures: list[np.ndarray], sizes: np.ndarray, same=None):
        n, width = len(signatures), min(map(len, signatures))
        self.same, self.size = same, np.asarray(sizes, np.int64)
        self.bits = np.stack([_folded(x, width) for x in signatures]).astype(np.int16)
        self.forest = Forest(n)
        order = np.lexsort((*self.bits[:, :8].T, self.size)).tolist()  # copies stand together
        level = [self._node(None, order[i : i + FANOUT]) for i in range(0, n, FANOUT)]
        while len(level) > 1:
            level = [self._node(level[i : i + FANOUT], None) for i in range(0, len(level), FANOUT)]
        self.top = level[0]

    def _node(self, children: list[Node] | None, rows: list[int] | None) -> Node:
        if rows is not None:
            r = np.array(rows)
            return Node(None, r, self.bits[r].max(0), self.size[r].min(), self.size[r].max())
        return Node(children, None, np.max([c.bits for c in children], 0), min(c.low for c in children), max(c.high for c in children))

    def _whole(self, x: Node) -> int:
        """The root that all sets below share, or -1."""
        if x.children is None:
            roots = [self.forest.root(int(x.rows[0]))] if x.whole else [self.forest.root(int(i)) for i in x.rows]
        else:
            roots = [self._whole(x.children[0])] if x.whole else [self._whole(c) for c in x.children]
        if roots[0] < 0 or any(r != roots[0] for r in roots):
            return -1
        x.whole = True
        return roots[0]

    def _possible(self, x: Node, y: Node) -> bool:
        if 5 * x.high < 4 * y.low or 5 * y.high < 4 * x.low:
            return False
        most = int(np.minimum(x.bits, y.bits).sum())
        return bool((x.bits.max() >= 255) & (y.bits.max() >= 255)) or 9 * most >= 4 * (x.low + y.low)

    def join(self) -> Forest:
        self._join(self.top, self.top)
        return self.forest

    def _join(self, x: Node, y: Node) -> None:
        r = self._whole(x)
        if r >= 0 and (x is y or r == self._whole(y)) or x is not y and not self._possible(x, y):
            return
        if x.children is None:
            self._leaves(x, y)
        elif x is y:
            for c in x.children:
                self._join(c, c)
            for i, c in enumerate(x.children):
                for d in x.children[i + 1 :]:
                    self._join(c, d)
        else:
            for c in x.children:
                for d in y.children:
                    self._join(c, d)

    def _leaves(self, x: Node, y: Node) -> None:
        a, b = x.rows, y.rows
        both = np.minimum(self.bits[a][:, None], self.bits[b][None]).sum(2)
        both[(self.bits[a].max(1) >= 255)[:, None] & (self.bits[b].max(1) >= 255)[None]] = 1 << 40  # counts are cut off
        m, n = self.size[a][:, None], self.size[b][None]
        maybe = (9 * both >= 4 * (m + n)) & (5 * m >= 4 * n) & (5 * n >= 4 * m)
        if x is y:
            maybe = np.triu(maybe, 1)
        root = self.forest.root
        for i, j in zip(*np.nonzero(maybe)):
            i, j = int(a[i]), int(b[j])
            if root(i) != root(j) and (self.same is None or self.same(i, j)):
                self.forest.join(i, j)


# -- the DataFrame side ----------------------------------------------------


def fingerprints(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set), the signature and the row's key."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(t.as_py()) for t in b.column(1)]
        seals = [signature(s, buckets(2 * len(s))).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.array(seals, pa.binary()), b.column(2)], names=["doc_id", "n_shingles", "class", "signature", "key"])

    return map_rows(texts, run, "doc_id long, n_shingles long, class long, signature binary, key long")


def _routed(texts: DataFrame) -> DataFrame:
    """key, class; a class once for each task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, classes = [], []
            for i, t in enumerate(b.column(1)):
                s = shingles(t.as_py())
                if len(s) and (d := digest(s)) not in seen:
                    if len(seen) < 1 << 18:
                        seen.add(d)
                    keys.append(routing_keys(s))
                    classes.append(np.full(len(keys[-1]), d, np.int64))
                if sum(map(len, keys)) > 1 << 18 or i == b.num_rows - 1 and keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))], names=["key", "class"])
                    keys, classes = [], []

    return texts.mapInArrow(tidy(run), "key long, class long")


def _by_group(rows: DataFrame, solve) -> DataFrame:
    """(a, b) links: rows are of groups (their first three columns) and members, sorted by group within partitions.

    solve gets a group's members as lists, one for each further column, and
    gives the members' names and the name of each one's root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        nodes: list[int] = []
        roots: list[int] = []
        done: set[int] = set()

        def finish() -> None:
            names = tuple(sorted({m[0] for m in group}))
            if len(names) > 1 and hash(names) not in done:  # the same classes often share many keys
                if len(done) < 1 << 18:
                    done.add(hash(names))
                x, y = solve(group)
                for i, r in zip(x, y):
                    if i != r:
                        nodes.append(i)
                        roots.append(r)

        for b in batches:
            where = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            for g, member in zip(where, zip(*(b.column(i).to_pylist() for i in range(3, b.num_columns)))):
                if g != now:
                    if group:
                        finish()
                    now, group = g, []
                group.append(member)
            if len(nodes) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])
                nodes.clear()
                roots.clear()
        if group:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _compatible(group: list[tuple]) -> tuple[list[int], list[int]]:
    """Members: class, size, signature.  Links those that may be near duplicates by their signatures."""
    members = {m[0]: m for m in group}
    names = sorted(members)
    forest = SignatureTree([np.frombuffer(members[d][2], np.uint8) for d in names], [members[d][1] for d in names]).join()
    return names, [names[forest.root(i)] for i in range(len(names))]


def _near(group: list[tuple]) -> tuple[list[int], list[int]]:
    """Members: class, text.  Links near duplicates."""
    sets: dict[int, np.ndarray] = {}
    for d, text in group:
        if d not in sets and digest(s := shingles(text)) == d:
            sets[d] = s
    names = sorted(sets)
    if len(names) < 2:
        return [], []
    held = [sets[d] for d in names]
    width = buckets(max(map(len, held)))
    forest = SignatureTree([signature(s, width) for s in held], [len(s) for s in held], lambda i, j: linked(held[i], held[j])).join()
    return names, [names[forest.root(i)] for i in range(len(names))]


def _blocked(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Rows with ``one`` and ``two``: a row of a group cut into blocks goes to every pair of blocks that has its own."""
    own = F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.col(blocks) - 1)
    return rows.withColumn("other", F.explode(every)).withColumns({"one": F.least(own, F.col("other")), "two": F.greatest(own, F.col("other"))}).drop("other", blocks)


def _sorted(rows: DataFrame, *columns: str) -> DataFrame:
    keys = [columns[0], "one", "two"]
    return rows.select(*keys, *columns[1:]).repartition(*keys).sortWithinPartitions(*keys)


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class."""
    texts = id_and_text(documents, id_col, text_col)
    texts = texts.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    slim = materialize(fingerprints(texts))
    classes = slim.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("key").alias("holder"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))

    of = Window.partitionBy("key")
    met = _routed(texts).withColumn("n", F.count("*").over(of)).filter("n > 1")
    seals = slim.filter(F.col("class").isNotNull()).groupBy("class").agg(F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    routed = _blocked(met.join(seals, "class").withColumn("blocks", F.ceil(F.col("n") / KEY_MEMBERS).cast("int")), "key", "blocks")
    star = _by_group(_sorted(routed, "key", "class", "size", "signature"), _compatible).distinct()
    candidates = materialize(components(star))
    sized = candidates.withColumnRenamed("node", "class").join(classes, "class")
    blocks = materialize(sized.groupBy("root").agg(F.ceil(F.sum("n") / MEMBERS).cast("int").alias("blocks")))
    held = sized.join(blocks, "root").select("class", "holder", F.col("root").alias("group"), "blocks")
    copies = Window.partitionBy("holder").orderBy("holder")
    named_texts = texts.select(F.col("key").alias("holder"), "text").withColumn("copy", F.row_number().over(copies)).filter("copy = 1").drop("copy")  # one of rows that agree in id and text
    members = _blocked(named_texts.join(held, "holder"), "group", "blocks")
    links = materialize(_by_group(_sorted(members, "group", "class", "text"), _near))
    if blocks.filter("blocks > 1").isEmpty():
        roots = links.select(F.col("a").alias("class"), F.col("b").alias("root"))  # already stars
    else:
        roots = components(links).withColumnRenamed("node", "class")
    labelled = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named_roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    final = labelled.join(named_roots, "root").select("class", "component_id")
    out = slim.join(final, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the smallest id, none as the last, then by a hash of id and text.

    Rows go by that hash, so rows with one id or none but texts that are not
    linked all stay, and so does every text without a word.
    """
    own = uuid.uuid4().hex
    key, one, copy = f"{own}_key", f"{own}_one", f"{own}_copy"
    doc = F.col(f"`{id_col}`").cast("long")
    keyed = documents.withColumn(key, F.xxhash64(doc.isNull(), doc, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    found = materialize(groups(keyed, key, text_col).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"), F.col("class").isNull().alias("empty")).distinct())
    ids = keyed.select(F.col(key).alias("key"), doc.alias("id")).distinct()
    first = found.filter("not empty").join(ids, "key").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias(key), F.lit(True).alias(one)).unionByName(found.filter("empty").select(F.col("key").alias(key), F.lit(False).alias(one)))
    rows = keyed.join(kept, key).withColumn(copy, F.when(F.col(one), 0).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates([key, copy]).select(*(F.col(f"`{c}`") for c in documents.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), m AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM m JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents AS d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
