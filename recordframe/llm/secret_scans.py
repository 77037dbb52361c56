"""Secret scans that link the parts of a credential.

Strong secrets are reported wherever they stand: assignments of eight or more
characters, access identifiers of the ``AKIA`` form, and long hexadecimal runs.
Weak candidates say little alone: short assignments and assignments to other
names, account names, endpoints.  A weak candidate is reported only if a part
that completes it stands within ``WINDOW`` characters in the same scope, a
block of lines without a blank line: a secret needs an identifier or an
endpoint, and those need a secret.

Everything is made of SQL functions.  ``split`` gives the text between the
matches of a pattern and ``regexp_extract_all`` the matches, from whose lengths
the positions follow.  The interval join is a sweep over the sorted candidates
of a text and its scope breaks, once forward and once backward, which carries
the last place of each kind of part; so no pairs are formed.  A text with n
matches costs n steps, and copies n * sqrt(n) references.  There is no shuffle.

Defined results: a null text counts as empty and has no spans; null ids stay
null; repeated rows are scanned each; an empty table stays empty; other columns
are kept as they are, whatever their names.  Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.llm.common import free_name, table

WINDOW = 256  #: code points between two parts of one credential at most


def _either(words: str) -> str:
    """Letters in either case, written out: folding rules differ between regex libraries."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({_either('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run that is too short holds no longer match
HEX = "[0-9a-f]{32,}"
IDENTIFIER = f"({_either('access_?key_?id|client_?id|username|user|login|account')}){_IS}([A-Za-z0-9@_.+-]+)"
WEAK = f"({_either('pwd|passphrase|pass|credentials?|auth|private_?key')}){_IS}([^\\x20\\x09-\\x0D\"',;]+)"
ENDPOINT = f"({_either('https?|ftp|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|jdbc')})://([^\\x20\\x09-\\x0D\"'<>]+)"
BREAK = r"\n[\x20\x09\r]*\n"

_SPAN = "struct<start:int,stop:int,chars:int>"
NONE = f"cast(array() as array<{_SPAN}>)"


def _let(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(items: Column, carry: dict[str, Column], out: str, step) -> Column:
    """The array of what step(state, item) gives for the items in turn: (new state, what to add as an array).

    Appending to an array copies it, so the items are taken in about sqrt(n)
    blocks of that many, each with an array of its own: n * sqrt(n) copied
    references, where one array would need n * n.
    """
    none = F.expr(f"cast(array() as array<{out}>)")
    names = list(carry)

    def add(s: Column, x: Column) -> Column:
        return _let(step(s, x), lambda r: F.struct(*(r[n].alias(n) for n in names), F.when(F.size(r["add"]) > 0, F.concat(s["out"], r["add"])).otherwise(s["out"]).alias("out")))

    def blocks(xs: Column, size: Column) -> Column:
        zero = F.struct(*(v.alias(n) for n, v in carry.items()), F.expr(f"cast(array() as array<array<{out}>>)").alias("out"))

        def block(s: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(xs, k * size + 1, size), F.struct(*(s[n].alias(n) for n in names), none.alias("out")), add)
            return _let(inner, lambda t: F.struct(*(t[n].alias(n) for n in names), F.array_append(s["out"], t["out"]).alias("out")))

        last = F.floor((F.size(xs) - 1) / size).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), zero, block, lambda s: F.flatten(s["out"]))

    return _let(items, lambda xs: F.when(F.size(xs) > 0, _let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda size: blocks(xs, size))).otherwise(none))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Every leftmost match: its start, its end, and how many characters ``group`` has of it."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.transform(F.arrays_zip(between.alias("a"), whole.alias("b"), part.alias("c")), lambda x: F.struct(F.length(x["a"]).alias("a"), F.length(x["b"]).alias("b"), F.length(x["c"]).alias("c")))

    def add(s: Column, x: Column) -> Column:
        begin, stop = s["at"] + x["a"], s["at"] + x["a"] + x["b"]
        return F.struct(stop.alias("at"), F.array(F.struct(begin.alias("start"), stop.alias("stop"), x["c"].alias("chars"))).alias("add"))

    matches = F.filter(steps, lambda x: x["b"].isNotNull())  # after the last match only text is left
    return F.when(text.rlike(pattern), _fold(matches, {"at": F.lit(0)}, _SPAN, add)).otherwise(F.expr(NONE))


#: The kinds in their order, and what part of a credential each is: s secret, i identifier, e endpoint.
KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
_PART = {"assign": "s", "access": "i", "hex": "s", "identifier": "i", "weak": "s", "endpoint": "e"}
_FAR = -(1 << 30)


def _events(name: str, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["stop"].alias("stop"), F.lit(_PART[kind]).alias("part"), F.lit(k > 2).alias("weak")))


def _sweep(events: Column, forward: bool) -> Column:
    """The weak events that have a completing part before them (or after them), as the array of them."""
    event = "struct<start:int,kind:int,stop:int,part:string,weak:boolean>"

    def step(s: Column, x: Column) -> Column:
        near = lambda p: (x["start"] - s[p] if forward else s[p] - x["stop"]) <= WINDOW
        seen = (lambda p: s[p] > _FAR) if forward else (lambda p: s[p] != _FAR)
        has = {p: seen(p) & near(p) for p in "sie"}
        hit = x["weak"] & F.when(x["part"] == "s", has["i"] | has["e"]).otherwise(has["s"])
        edge = F.greatest if forward else F.least
        new = [
            F.when(x["part"] == "b", F.lit(_FAR))
            .when(x["part"] == p, F.when(s[p] == _FAR, x["stop"] if forward else x["start"]).otherwise(edge(s[p], x["stop"] if forward else x["start"])))
            .otherwise(s[p])
            .alias(p)
            for p in "sie"
        ]
        return F.struct(*new, F.when(hit, F.array(x)).otherwise(F.expr(f"cast(array() as array<{event}>)")).alias("add"))

    return _fold(events if forward else F.reverse(events), {p: F.lit(_FAR) for p in "sie"}, event, step)


def _scanned(text: Column) -> tuple[list, list, list]:
    """Three selections, one after the other, from a table with the column ``text``; others are carried along."""
    every = [spans(text, p, g).alias(n) for n, p, g in (("assign", ASSIGN, 2), ("identifier", IDENTIFIER, 2), ("weak", WEAK, 2), ("endpoint", ENDPOINT, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("break", BREAK, 0))]
    long_enough, short = F.filter("assign", lambda x: x["chars"] >= 8), F.filter("assign", lambda x: x["chars"] < 8)
    enough = {"short": short, "assign": long_enough, "weak": F.filter("weak", lambda x: x["chars"] >= 4)}
    base = F.array_sort(F.concat(_events("assign", "assign"), _events("access", "access"), _events("hex", "hex")))
    weak = F.concat(_events("identifier", "identifier"), _events("short", "weak"), _events("weak", "weak"), _events("endpoint", "endpoint"))
    return every, enough, {"base_spans": base, "candidates": weak}


def _found(documents: DataFrame, text_col: str) -> DataFrame:
    """``row`` with all columns of the documents, ``text``, ``base_spans`` and ``linked_spans``: so no name can clash."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns))) if documents.columns else F.struct(F.lit(0))
    found = documents.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    every, enough, told = _scanned(F.col("text"))
    found = found.select("row", "text", *every).withColumns(enough).withColumns(told)
    breaks = F.transform("break", lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("kind"), x["stop"].alias("stop"), F.lit("b").alias("part"), F.lit(False).alias("weak")))
    found = found.withColumn("events", F.when(F.size("candidates") > 0, F.array_sort(F.concat("base_spans", "candidates", breaks))).otherwise(F.slice("candidates", 1, 0)))
    events = F.col("events")
    either = F.array_sort(F.concat(_sweep(events, True), _sweep(events, False)))
    linked = _let(either, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) != x)))  # array_union compares every pair
    return found.select("row", "text", "base_spans", F.when(F.size(events) > 1, linked).otherwise(F.slice(events, 1, 0)).alias("linked_spans"))


def scan(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``base_spans`` and ``linked_spans``: arrays of (start, kind, stop, part, weak), sorted.

    If documents have columns of these names, the new ones get an underscore more.
    """
    names = documents.columns
    own = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)]
    return _found(documents, text_col).select(*own, F.col("base_spans").alias(free_name("base_spans", names)), F.col("linked_spans").alias(free_name("linked_spans", names)))


def _told(events: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(events, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def redact(documents: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced; where spans overlap, their union is."""
    cuts = F.array_sort(F.concat("base_spans", "linked_spans"))
    zero = {"at": F.lit(0)}

    def join(s: Column, x: Column) -> Column:
        """Spans that overlap as one."""
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], F.array(F.struct(s["at"].alias("from"), x["start"].alias("to")))).otherwise(F.expr("cast(array() as array<struct<from:int,to:int>>)")).alias("add"))

    def cut(text: Column, kept: Column) -> Column:
        """What is kept, each followed by the mark: from a part of the text for each block, as a place in a string is found by counting."""
        size = F.ceil(F.sqrt(F.size(kept))).cast("int")

        def block(k: Column) -> Column:
            some = F.slice(kept, k * size + 1, size)
            return _let(
                some,
                lambda xs: _let(
                    F.struct(F.substring(text, xs[0]["from"] + 1, F.element_at(xs, -1)["to"] - xs[0]["from"]).alias("part"), xs[0]["from"].alias("at")),
                    lambda p: F.array_join(F.transform(xs, lambda x: F.concat(F.substring(p["part"], x["from"] - p["at"] + 1, x["to"] - x["from"]), F.lit(mark))), ""),
                ),
            )

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / size).cast("int")), block), "")

    last = F.aggregate(cuts, F.lit(0), lambda s, x: F.greatest(s, x["stop"]))
    found = _found(documents, text_col).withColumn("kept", _fold(cuts, zero, "struct<from:int,to:int>", join)).withColumn("last", last)
    hit = F.size("base_spans") + F.size("linked_spans") > 0
    clean = _let(F.col("kept"), lambda kept: F.concat(cut(F.col("text"), kept), F.substring(F.col("text"), F.col("last") + 1, F.length("text"))))
    found = found.select("row", hit.alias("hit"), F.when(hit, clean).alias("clean"))
    columns = []
    for i, c in enumerate(documents.columns):
        own, kind = F.col("row")[f"c{i}"], documents.schema[i].dataType
        new = F.col("clean") if c == text_col else F.length("clean").cast(kind) if c == "n_chars" else None
        columns.append((own if new is None else F.when(F.col("hit"), new).otherwise(own)).alias(c))
    return found.select(*columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(_told(F.col("base_spans")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base_spans", "linked_spans"))).alias("spans"))


def _oracle() -> str:
    """The same in SQL: positions from the lengths between matches, and a weak candidate's complement looked for among all parts of its scope."""
    quoted = lambda p: p.replace("'", "''")
    kinds = [("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("identifier", IDENTIFIER, 2), ("weak", WEAK, 2), ("endpoint", ENDPOINT, 2), ("break", BREAK, 0)]
    matches = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, string_split_regex(s, '{quoted(p)}') AS between, regexp_extract_all(s, '{quoted(p)}') AS hits, regexp_extract_all(s, '{quoted(p)}', {g}) AS parts FROM t"
        for kind, p, g in kinds
    )
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    told = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (WHERE {where}), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), m AS ({matches}),
i AS (SELECT doc_id, kind, between, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m),
p AS (
  SELECT doc_id, kind, length(parts[i]) AS chars, length(hits[i]) AS size,
    CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM i
),
e AS (
  SELECT DISTINCT doc_id, CASE WHEN kind = 'assign' AND chars < 8 THEN 'weak' ELSE kind END AS kind, start, start + size AS stop
  FROM p WHERE NOT (kind = 'weak' AND chars < 4)
),
f AS (SELECT *, {order} AS k, CASE WHEN kind IN ('assign', 'hex', 'weak') THEN 's' WHEN kind IN ('access', 'identifier') THEN 'i' ELSE 'e' END AS part FROM e WHERE kind <> 'break'),
linked AS (
  SELECT DISTINCT a.doc_id, a.kind, a.start, a.stop, a.k FROM f AS a JOIN f AS b ON a.doc_id = b.doc_id
  WHERE a.kind IN ('identifier', 'weak', 'endpoint') AND (a.part = 's') <> (b.part = 's')
    AND greatest(a.start - b.stop, b.start - a.stop) <= {WINDOW}
    AND NOT EXISTS (SELECT 1 FROM e AS x WHERE x.doc_id = a.doc_id AND x.kind = 'break' AND x.start > least(a.start, b.start) AND x.start < greatest(a.start, b.start))
),
every AS (
  SELECT doc_id, kind, start, stop, k, TRUE AS base FROM f WHERE kind IN ('assign', 'access', 'hex')
  UNION ALL SELECT doc_id, kind, start, stop, k, FALSE FROM linked
)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256({told("base")}) AS base_sha256, {told("kind IS NOT NULL")} AS spans
FROM t LEFT JOIN every ON every.doc_id = t.doc_id GROUP BY t.doc_id
"""


ORACLE = _oracle()
