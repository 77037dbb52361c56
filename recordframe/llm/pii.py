"""Personal data by weak supervision.

Four kinds have forms that say enough (mail addresses, IP addresses, cards with
a valid check digit, international phone numbers); they are always reported.
Other candidates (national phone numbers, identity numbers, bank accounts,
named persons, street addresses) are looked for by loose patterns, and six
labelers vote on each: strict form, gazetteer, checksum, context before,
misleading context, and known personal data nearby.

1. One pass over all texts takes base spans and candidates, each with its kind,
   votes and shape, to a table in the shared folder; no text is in it.
2. Its candidates are counted by pattern.  The number of such patterns is fixed
   by the design, so the counts are small however large the corpus is.
   Expectation-maximisation over the counts (each labeler's rates of voting
   for, against or not at all, given the truth; a prior for each kind)
   estimates the reliabilities without labelled data.
3. A logistic regression on votes, kind and shape is trained with the
   posteriors as its targets, weighted by the counts.
4. The candidates that it gives ``THRESHOLD`` or more are reported, from the
   table; the texts are not read again.

Patterns are matched so that time grows with the length of the text alone.

Defined results: a null text counts as empty; null ids stay null; repeated rows
are scanned each; an empty table stays empty, and trains nothing; other columns
are not read.  Positions are code points; spans are sorted by start, then kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.llm.common import id_and_text, map_rows, materialize, table

BASE = ("email", "ip", "card", "phone")
WEAK = ("local_phone", "identity", "account", "person", "street")
KINDS = BASE + WEAK
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where digits do
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "local_phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "person": re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20|\b(?:Herr|Frau|Señora?|Monsieur|Madame)\x20|\b(?:[Nn]ame|[Nn]ombre|[Nn]om)(?:\x20is|:)\x20)([A-Z][^\W\d_]+(?:\x20[A-Z][^\W\d_]+)?)"),
    "street": re.compile(r"(?<![0-9])[0-9]{1,5}\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?\x20(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd)\b"),
}
_STRICT = {
    "local_phone": re.compile(r"\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}"),
    "identity": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,38}"),
    "person": re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+"),
    "street": re.compile(r"[1-9][0-9]{0,4} .* (?:Street|Road|Avenue|Lane|Drive|Boulevard)"),
}
# Short gazetteers of common given names, bank account countries and street words.
_NAMES = frozenset("Anna Maria John James Mary Peter Paul Thomas Michael David Robert Sarah Laura Julia Hans Karl Marie Pierre Jean Jose Juan Carmen Luis Elena Emma Sophie Lucas Martin Daniel Linda Susan Karen Lisa Mark George Helen Alice".split())
_COUNTRIES = frozenset("AT BE CH DE ES FR GB IE IT LU NL PL PT SE DK FI NO CZ GR HU".split())
_CUES = {
    "local_phone": re.compile(r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|contact)\b"),
    "identity": re.compile(r"(?i)\b(?:ssn|social|security|identity|taxpayer)\b"),
    "account": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    "person": re.compile(r"(?i)\b(?:name|signed|sincerely|contact|dear|nombre|nom)\b"),
    "street": re.compile(r"(?i)\b(?:address|live[sd]?|located|resid\w*|at)\b"),
}
_MISLEADING = re.compile(r"(?i)\b(?:version|page|figure|table|isbn|issn|chapter|section|example|order|part|serial)\b")
_AROUND = 48  #: characters of context on either side


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _remainder97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, tuple]]:
    """(start, kind, end, pattern) of what stands clear of the base spans.

    pattern: kind, the labelers' votes (1 for, -1 against, 0 none), shape.
    """
    for kind in WEAK:
        for m in _LOOSE[kind].finditer(text):
            group = 1 if kind == "person" else 0
            start, end = m.span(group)
            if any(s < end and start < e for s, _, e in base):
                continue
            s = m[group]
            before, after = text[max(0, m.start() - _AROUND) : start], text[end : end + _AROUND]
            gazetteer = {
                "person": lambda: 1 if s.split()[0] in _NAMES else 0,
                "account": lambda: 1 if s[:2] in _COUNTRIES else -1,
                "street": lambda: 1 if s.rsplit(" ", 1)[-1] in ("Street", "Road", "Avenue") else 0,
                "local_phone": lambda: -1 if s.strip("(")[0] in "01" else 0,
                "identity": lambda: 0,
            }[kind]()
            votes = (
                1 if _STRICT[kind].fullmatch(s) else -1,
                gazetteer,
                (1 if _remainder97(s) else -1) if kind == "account" else 0,
                1 if _CUES[kind].search(before) else 0,
                -1 if _MISLEADING.search(before) else 0,
                1 if any(e > start - _AROUND and b < end + _AROUND for b, _, e in base) else 0,
            )
            shape = (min(3, (end - start) // 8), int(after[:1].isalnum() or before[-1:].isalnum()), int("\n" in before[-2:]))
            yield start, KINDS.index(kind), end, (KINDS.index(kind), *votes, *shape)


N_VOTES = 6
_SPAN = "start:int,kind:int,stop:int"


def extract(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``base`` spans and ``weak`` candidates with their patterns: all that is needed of a text."""
    span = [("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]
    base_type, weak_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("pattern", pa.list_(pa.int32()))]))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sure, loose = [], []
        for t in b.column(1):
            text = t.as_py().decode("utf-8", "replace")
            base = base_spans(text)
            sure.append([{"start": s, "kind": k, "stop": e} for s, k, e in base])
            loose.append([{"start": s, "kind": k, "stop": e, "pattern": p} for s, k, e, p in candidates(text, base)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sure, base_type), pa.array(loose, weak_type)], names=["doc_id", "base", "weak"])

    return map_rows(id_and_text(documents, id_col, text_col), run, f"doc_id long, base array<struct<{_SPAN}>>, weak array<struct<{_SPAN},pattern:array<int>>>")


def count_patterns(extracted: DataFrame) -> dict[tuple, int]:
    """How often each pattern of candidates occurs in what ``extract`` found."""
    counted = extracted.select(F.explode("weak.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return {tuple(r.pattern): r.n for r in counted.collect()}  # the design bounds their number


def em(counts: dict[tuple, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the patterns, in the order of counts, and reliabilities[labeler][truth][vote + 1].

    It starts from the votes' balance, and every estimate is smoothed by two
    pseudo-observations that hold labelers to be right more often than wrong.
    """
    patterns = list(counts)
    if not patterns:
        return np.zeros(0), np.full((N_VOTES, 2, 3), 1 / 3)
    n = np.array([counts[p] for p in patterns], float)
    kind = np.array([p[0] for p in patterns])
    votes = np.array([p[1 : 1 + N_VOTES] for p in patterns])
    q = 1 / (1 + np.exp(-(votes.sum(1) - 1.5)))
    prior = np.zeros(len(KINDS))
    for _ in range(rounds):
        rates = np.zeros((N_VOTES, 2, 3))
        for truth, w in ((0, n * (1 - q)), (1, n * q)):
            for v in (-1, 0, 1):
                rates[:, truth, v + 1] = (w[:, None] * (votes == v)).sum(0)
            rates[:, truth] += np.array([1.0, 1.0, 0.1] if truth == 0 else [0.1, 1.0, 1.0])
        rates /= rates.sum(2, keepdims=True)
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = ((n * q)[own].sum() + 1) / (n[own].sum() + 4)
        logs = np.log(rates)
        score = np.log(prior / (1 - prior))[kind]
        for j in range(N_VOTES):
            score = score + logs[j, 1, votes[:, j] + 1] - logs[j, 0, votes[:, j] + 1]
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return q, rates


def _features(p: tuple) -> list[float]:
    kind, votes, shape = p[0], p[1 : 1 + N_VOTES], p[1 + N_VOTES :]
    return [1.0, *(float(kind == len(BASE) + k) for k in range(len(WEAK))), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes), *(float(shape[0] == k) for k in range(1, 4)), float(shape[1]), float(shape[2])]


def train(counts: dict[tuple, int], rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression on the posteriors; Newton steps with a ridge."""
    q, _ = em(counts)
    size = len(_features((len(BASE), *[0] * N_VOTES, 0, 0, 0)))
    w = np.zeros(size)
    w[0] = -2.0
    if not counts:
        return w
    x = np.array([_features(p) for p in counts])
    n = np.array(list(counts.values()), float)
    for _ in range(min(rounds, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - q)) + 0.1 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(size)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted(counts: dict[tuple, int], weights: np.ndarray) -> list[tuple]:
    """The patterns that the classifier takes for personal data."""
    return [p for p in counts if 1 / (1 + math.exp(-float(np.clip(np.dot(_features(p), weights), -30, 30)))) >= THRESHOLD]


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: (start, kind as a number, stop, base), sorted."""
    extracted = materialize(extract(documents, id_col, text_col))
    counts = count_patterns(extracted)
    good = [",".join(map(str, p)) for p in accepted(counts, train(counts))]
    told = lambda x, own: F.struct(x["start"], x["kind"], x["stop"], F.lit(own).alias("base"))
    base = F.transform("base", lambda x: told(x, True))
    if not good:
        return extracted.select("doc_id", F.array_sort(base).alias("spans"))
    holds = F.create_map(*(F.lit(x) for p in good for x in (p, True)))
    taken = F.filter("weak", lambda x: F.coalesce(F.element_at(holds, F.array_join(x["pattern"].cast("array<string>"), ",")), F.lit(False)))
    return extracted.select("doc_id", F.array_sort(F.concat(base, F.transform(taken, lambda x: told(x, False)))).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = find(documents)
    names = F.array(*(F.lit(k) for k in KINDS))
    base = F.filter("spans", lambda x: x["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")

    def counted(kind: int) -> Column:  # a second parameter of a lambda would be the place in the array
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{BASE[kind]}")

    n = map(counted, range(len(BASE)))
    return found.select("doc_id", *n, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
