"""URL filters by association rules.

The list of rules (host and path, the longest fitting one wins) decides some
pages outright.  Those verdicts are the labels: frequent-set mining tells which
combinations of URL tokens go with "block", over all labelled pages.  Mined
rules below the support or the confidence are pruned, and so are rules that a
shorter one with as much confidence covers.  An inverted index, each rule
under its rarest token, finds the rules for the pages that the list leaves open.

Tokens are all labels of the host, all segments of the path, all keys of the
query and the extension.  Sets are mined level by level without a limit of
length.  A set that some smaller one already is in count, or within one that is
always blocked, adds no rule that would stay, so it is not extended: what is
held are the sets that tell pages apart, each in ``min_support`` of the blocked.
There is no shuffle by host.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and has no tokens, so it is allowed; null ids stay null;
repeated rows are judged each; with no labelled page there are no mined rules;
an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.llm.common import materialize, table

#: Verdict, host and path of the listed rules.
LISTED = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.9
_CUT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; empty where there is no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _CUT, 1), _UPPER, _LOWER), F.regexp_extract(url, _CUT, 2), F.regexp_extract(url, _CUT, 3)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LISTED) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens(host: Column, path: Column, query: Column) -> Column:
    """The distinct tokens of a URL: all labels of the host, segments of the path and keys of the query, and the extension."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    named = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}="), x))
    keys = F.transform(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: F.element_at(F.split(x, "=", 2), 1))
    some = [
        F.when(n > 1, F.concat(F.lit("domain="), F.get(labels, n - 2))),
        F.when(host != "", F.concat(F.lit("top="), F.element_at(labels, -1))),
        F.when(path.rlike(r"\.[A-Za-z0-9]+$"), F.concat(F.lit("ext="), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
    ]
    rest = named("host", F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0)))), named("path", F.split(path, "/")), named("query", keys)
    return F.array_distinct(F.concat(F.array_compact(F.array(*some)), *rest))


def _counter(found: list[tuple]):
    """How many pages of a task have each candidate (a sorted tuple), and how many of them are blocked."""
    tree: dict = {}
    for k, s in enumerate(found):
        at = tree
        for x in s:
            at = at.setdefault(x, {})
        at[None] = k
    single = {x for s in found for x in s}

    def walk(at: dict, items: list, start: int, out: list) -> None:
        if None in at:
            out.append(at[None])
        for i in range(start, len(items)):
            below = at.get(items[i])
            if below is not None:
                walk(below, items, i + 1, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, blocked = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        for b in batches:
            for items, verdict in zip(b.column("tokens").to_pylist(), b.column("verdict").to_pylist()):
                out: list[int] = []
                walk(tree, sorted(single.intersection(items)), 0, out)
                seen[out] += 1
                if verdict == "block":
                    blocked[out] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.array(blocked[some])], names=["k", "seen", "blocked"])

    return run


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[frozenset, float, int]]:
    """(tokens, confidence, frequency) of the rules for "block"; labelled has ``tokens`` and ``verdict``."""
    labelled = materialize(labelled.select("tokens", "verdict"))
    least = max(1, math.ceil(labelled.count() * min_support - 1e-9))
    one = labelled.select(F.explode(F.array_distinct("tokens")).alias("x"), (F.col("verdict") == "block").cast("long").alias("b"))
    singles = one.groupBy("x").agg(F.count("*").alias("seen"), F.sum("b").alias("blocked")).filter(F.col("blocked") >= least).collect()
    level = {(r.x,): (r.seen, r.blocked) for r in singles}
    best: dict[tuple, float] = {(): 0.0}
    kept = []
    while level:
        grow = set()
        for s, (seen, blocked) in sorted(level.items()):
            confidence = blocked / seen
            below = max(best[s[:i] + s[i + 1 :]] for i in range(len(s)))
            if blocked >= seen * min_confidence:
                if below < confidence:
                    kept.append((frozenset(s), confidence, seen))
                below = max(below, confidence)
            best[s] = below
            if confidence < 1:
                grow.add(s)
        by_start: dict[tuple, list] = {}
        for s in sorted(grow):
            by_start.setdefault(s[:-1], []).append(s[-1])
        found = [(*a, x, y) for a, ends in by_start.items() for i, x in enumerate(ends) for y in ends[i + 1 :]]
        found = [s for s in found if all(s[:i] + s[i + 1 :] in grow for i in range(len(s) - 2))]
        if not found:
            break
        counted = labelled.mapInArrow(_counter(found), "k long, seen long, blocked long").groupBy("k").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")).filter(F.col("blocked") >= least)
        before, level = level, {}
        for r in counted.collect():
            s = found[r.k]
            if all(before[s[:i] + s[i + 1 :]][0] > r.seen for i in range(len(s))):
                level[s] = (r.seen, r.blocked)
    return kept


def index(rules: Sequence[tuple[frozenset, float, int]], frequency: dict[str, int] | None = None) -> dict[str, list[frozenset]]:
    """Each rule under its rarest token (by the rules' own frequencies, then by name)."""
    rare = frequency or {}
    at: dict[str, list[frozenset]] = {}
    for s, _, _ in rules:
        at.setdefault(min(s, key=lambda x: (rare.get(x, 0), x)), []).append(s)
    return at


def judge(pages: DataFrame, listed: Sequence[tuple[str, str, str]] = LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule decided)."""
    host, path, query = parts(F.col(f"`{url_col}`"))
    cut = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), query.alias("__query"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    cut = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("host"), F.col("path"), F.col("__query")).alias("tokens"))
    found = index(mine(cut.filter(F.col("verdict").isNotNull()).select("tokens", "verdict"), min_support, min_confidence))

    @F.pandas_udf("boolean")
    def blocked(items: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in items:
            yield pd.Series([any(s.issubset(x) for t in x for s in found.get(t, ())) for x in map(set, batch)], dtype="boolean")

    hit = cut.withColumn("hit", blocked("tokens"))
    mined = F.col("verdict").isNull() & F.col("hit")
    return hit.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"), mined.alias("mined"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
