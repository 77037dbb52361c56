"""The engine's queries, each with the DuckDB SQL that must give the same rows.

Most are round trips: a table is written in a format, file by file under a key
with many values, and read back; the SQL selects what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordframe.formats import encode
from recordframe.functions import bio, infer
from recordframe.operators import analytics
from recordframe.sources import detect, sink
from recordframe.sources.formats import get_format
from recordframe.sources.reader import decode_files, fasta_lines, sam_lines
from recordframe.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, key: str, order: list[str], write: Callable[[pd.DataFrame], bytes | tuple[bytes, bytes]]) -> DataFrame:
    """(path, content, header): a file for each value of key, its rows in order."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        made = write(rows.sort_values(order))
        content, header = made if isinstance(made, tuple) else (made, None)
        return pd.DataFrame({"path": [str(rows[key].iloc[0])], "content": [content], "header": [header]})

    return df.groupBy(key).applyInPandas(one, "path string, content binary, header binary")


def unpacked(files: DataFrame, parser: str | None, schema: T.StructType | None = None, **options) -> DataFrame:
    found = schema or get_format(parser).schema
    return decode_files(files, found, parser, **options).select(*found.fieldNames())


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# -- sequences ---------------------------------------------------------------

_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"), F.pmod(F.col("doc_id"), F.lit(97)).cast("int").alias("file"))


@query(f"""
WITH s AS (SELECT lang, {_LETTERS} AS q FROM documents),
c AS (SELECT lang, length(q) AS n, length(regexp_replace(q, '[^GCS]', '', 'g')) AS g, length(regexp_replace(q, '[^ATUW]', '', 'g')) AS a, length(regexp_replace(q, '[^RYKM]', '', 'g')) AS h FROM s)
SELECT lang, count(*) AS n, round(avg(n), 6) AS mean_length, round(avg((g + 0.5 * h) / nullif(g + a + h, 0)), 6) AS mean_gc FROM c GROUP BY lang
""")
def flagship_fasta_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped FASTA files without an extension, their type told by magic bytes; GC by language."""
    import gzip

    write = lambda r: gzip.compress(encode.fasta([f"{i} {x}" for i, x in zip(r.doc_id, r.lang)], r.sequence), 1)
    seqs = unpacked(packed(_sequences(spark, sf_dir), "file", ["doc_id"], write), None, get_format("fasta").schema)
    return seqs.groupBy(F.substring_index("id", " ", -1).alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("sequence")), 6).alias("mean_length"), F.round(F.avg(bio.gc_content(F.col("sequence"))), 6).alias("mean_gc"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LETTERS} AS sequence FROM documents")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed(_sequences(spark, sf_dir), "file", ["doc_id"], lambda r: encode.fasta(r.doc_id, r.sequence)), "fasta")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LETTERS} AS sequence FROM documents")
def fasta_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By line in the JVM."""
    path = scratch(spark)
    s = _sequences(spark, sf_dir)
    s.select(F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.regexp_replace("sequence", "(.{1,60})", "$1\n")).alias("value")).select(F.regexp_replace("value", "\n$", "").alias("value")).write.text(path)
    return fasta_lines(spark, path).select("id", "sequence")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LETTERS} AS sequence, repeat('@', length({_LETTERS})) AS quality FROM documents")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed(_sequences(spark, sf_dir), "file", ["doc_id"], lambda r: encode.fastq(r.doc_id, r.sequence, ["@" * len(s) for s in r.sequence])), "fastq")


_ALIGNED = """
SELECT 'q' || l_orderkey || '.' || l_linenumber AS query_name, CAST(l_partkey % 4096 AS BIGINT) AS flag,
  CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'chr' || (l_suppkey % 5) END AS ref_name,
  nullif(l_partkey % 100, 0) - 1 AS pos, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS mapq,
  (l_partkey % 50 + 1) || 'M' || (l_linenumber + 1) || 'X' AS cigar, '' AS rnext, CAST(NULL AS BIGINT) AS pnext,
  CAST(l_quantity AS BIGINT) AS tlen, 'ACGT' AS sequence, 'IIII' AS quality, 'NM:i:' || l_linenumber || '|RF:Z:' || l_returnflag AS extra
FROM lineitem
"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    c = F.col
    return l.select(
        "l_suppkey", F.concat(F.lit("q"), "l_orderkey", F.lit("."), "l_linenumber").alias("query_name"), F.pmod(c("l_partkey"), F.lit(4096)).alias("flag"),
        F.when(c("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("chr"), c("l_suppkey") % 5)).alias("ref_name"), (F.nullif(c("l_partkey") % 100, F.lit(0)) - 1).alias("pos"),
        F.when(c("l_linenumber") != 7, c("l_linenumber").cast("long")).alias("mapq"), F.concat(c("l_partkey") % 50 + 1, F.lit("M"), c("l_linenumber") + 1, F.lit("X")).alias("cigar"),
        F.lit("").alias("rnext"), F.lit(None).cast("long").alias("pnext"), c("l_quantity").cast("long").alias("tlen"), F.lit("ACGT").alias("sequence"), F.lit("IIII").alias("quality"),
        F.concat(F.lit("NM:i:"), "l_linenumber", F.lit("|RF:Z:"), "l_returnflag").alias("extra"),
    )


def _rows(r: pd.DataFrame) -> list[tuple]:
    none = lambda v: None if v is None or v != v else int(v)
    names = [n for n in get_format("sam").schema.fieldNames()]
    return [tuple(none(v) if n in ("pos", "mapq", "pnext") else v for n, v in zip(names, row)) for row in r[names].itertuples(index=False, name=None)]


@query(_ALIGNED)
def bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed(_aligned(spark, sf_dir), "l_suppkey", ["query_name"], lambda r: encode.bam(_rows(r), ["chr1", "chr2", "chr3", "chr4"])), None, get_format("bam").schema)


@query(_ALIGNED)
def sam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed(_aligned(spark, sf_dir), "l_suppkey", ["query_name"], lambda r: encode.sam(_rows(r))), "sam")


@query(_ALIGNED)
def sam_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By line in the JVM, from text that is written in the JVM."""
    path = scratch(spark)
    a = _aligned(spark, sf_dir)
    star = lambda n: F.when(F.col(n) == "", "*").otherwise(F.col(n))
    a.select(F.concat_ws("\t", "query_name", "flag", star("ref_name"), F.coalesce(F.col("pos") + 1, F.lit(0)), F.coalesce("mapq", F.lit(255)), "cigar", star("rnext"), F.coalesce(F.col("pnext") + 1, F.lit(0)), "tlen", "sequence", "quality", F.replace("extra", F.lit("|"), F.lit("\t"))).alias("value")).write.text(path)
    return sam_lines(spark, path).drop("_path")


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 50 + 1) || 'M' || (l_linenumber + 1) || 'X' AS cigar FROM lineitem")
def cigar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    ops = F.array((F.col("l_partkey") % 50 + 1) * 16, (F.col("l_linenumber").cast("long") + 1) * 16 + 8)
    return l.select("l_orderkey", "l_linenumber", bio.cigar_text(ops).alias("cigar"))


@query(f"SELECT doc_id, round((g + 0.5 * h) / nullif(g + a + h, 0), 6) AS gc FROM (SELECT doc_id, length(regexp_replace(q, '[^GCS]', '', 'g')) AS g, length(regexp_replace(q, '[^ATUW]', '', 'g')) AS a, length(regexp_replace(q, '[^RYKM]', '', 'g')) AS h FROM (SELECT doc_id, {_LETTERS} AS q FROM documents))")
def gc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("doc_id", F.round(bio.gc_content(F.col("sequence")), 6).alias("gc"))


@query("SELECT c_custkey, round(list_avg(list_transform(string_split(c_name, ''), lambda x: CAST(unicode(x) AS DOUBLE))), 6) AS mean_quality FROM customer")
def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(bio.mean_quality(F.col("c_name")), 6).alias("mean_quality"))


# -- detection, codecs, errors -----------------------------------------------

_KNOWN = [(m, n) for _, t in detect.MAGIC for m, n in t if not n.startswith("thermo_cf")]


@query("SELECT file_type, count(*) AS n FROM (SELECT CASE event_id % " + str(len(_KNOWN) + 1) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(_KNOWN)) + " ELSE 'unknown:0000' || repeat('0', 4) END AS file_type FROM events) GROUP BY file_type")
def magic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*(F.lit(bytearray(m.ljust(9, b"\0") if n not in ("fasta", "fastq") else m + b"x" * 8)) for m, n in _KNOWN), F.lit(bytearray(9)))
    e = table(spark, sf_dir, "events").select(F.get(heads, F.pmod(F.col("event_id"), F.lit(len(_KNOWN) + 1)).cast("int")).alias("content"))
    return e.groupBy(detect.magic_type(F.col("content")).alias("file_type")).agg(F.count("*").alias("n"))


_EXT = [*detect.EXTENSIONS, "nope"]


@query("SELECT CAST(page_id AS BIGINT) AS page_id, CASE page_id % " + str(len(_EXT)) + " " + " ".join(f"WHEN {i} THEN '{'|'.join(detect.EXTENSIONS[e])}'" for i, e in enumerate(_EXT[:-1])) + " ELSE 'unknown' END AS types, CASE page_id % " + str(len(_EXT)) + " " + " ".join(f"WHEN {i} THEN '{detect.PARSERS[detect.EXTENSIONS[e][0]]}'" for i, e in enumerate(_EXT[:-1]) if detect.EXTENSIONS[e][0] in detect.PARSERS) + " END AS parser FROM pages")
def ext_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("dir.x/file."), F.get(F.array(*map(F.lit, _EXT)), F.pmod(F.col("page_id"), F.lit(len(_EXT))).cast("int")))
    kinds = detect.extension_types(name)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(kinds, "|").alias("types"), detect.parser_names(kinds[0]).alias("parser"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LETTERS} AS sequence FROM documents")
def codec_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with another codec, all told by their first bytes."""

    def write(r: pd.DataFrame) -> bytes:
        import bz2
        import gzip
        import lzma

        import zstandard

        data = encode.fasta(r.doc_id, r.sequence)
        half = len(data) // 2
        return [lambda: data, lambda: gzip.compress(data, 1), lambda: gzip.compress(data[:half], 1) + gzip.compress(data[half:], 1), lambda: bz2.compress(data, 1), lambda: lzma.compress(data, preset=0), lambda: zstandard.ZstdCompressor().compress(data)][int(r.file.iloc[0]) % 6]()

    return unpacked(packed(_sequences(spark, sf_dir), "file", ["doc_id"], write), None, get_format("fasta").schema)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS path, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN l_suppkey % 3 = 0 THEN 'Valid FASTA records start with ''>''' END AS message FROM lineitem GROUP BY l_suppkey")
def permissive_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")  # noqa: E741
    files = packed(l, "l_suppkey", ["l_orderkey"], lambda r: (b"" if r.l_suppkey.iloc[0] % 3 else b"broken") + encode.fasta(r.l_orderkey.astype(str), ["A"] * len(r)))
    rows = decode_files(files, get_format("fasta").schema, "fasta", "PERMISSIVE")
    return rows.groupBy(F.col("_path").alias("path")).agg(F.count("*").alias("n"), F.max("_error.message").alias("message"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS path, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE count(*) END AS n, l_suppkey % 3 = 0 AS broken FROM lineitem GROUP BY l_suppkey")
def permissive_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end within a record, or whose tags and operations have codes that are not there, become one row each."""

    def file(r) -> bytes:
        k, whole = int(r.l_suppkey.iloc[0]), encode.bam(_rows(r), ["chr1", "chr2", "chr3", "chr4"])
        return whole if k % 3 else whole[: len(whole) * 2 // 3] if k % 2 else whole.replace(b"AS", b"A\xff")[:-7] + b"\xff" * 7

    rows = decode_files(packed(_aligned(spark, sf_dir), "l_suppkey", ["query_name"], file), get_format("bam").schema, "bam", "PERMISSIVE")
    return rows.groupBy(F.col("_path").alias("path")).agg(F.count(F.when(F.col("_error").isNull(), 1)).alias("n"), (F.count("_error") > 0).alias("broken"))


_CELL = "CASE WHEN n_coefficients = 0 THEN n WHEN n_coefficients = 4 THEN 1.5 + 2.5 / n + 3.5 / (n * n) ELSE 1.5 + 2.5 / (n * n) + 3.5 / (n * n * n * n) END"


@query(f"""SELECT l_orderkey, l_linenumber, chr(CAST(l_partkey % 94 + 33 AS INTEGER)) AS phred, CAST(floor((l_linenumber % 4) * 65535 / 3) AS BIGINT) AS rescaled,
  CASE WHEN l_partkey <= 1024 THEN l_partkey ELSE l_partkey & 1023 END AS masked, CASE WHEN l_linenumber = 1 THEN 9223372036854775807 ELSE l_orderkey END AS saturated,
  round({_CELL}, 9) AS mz FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS n, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 7 END AS n_coefficients FROM lineitem)""")
def scalar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    line, n = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    wide = F.when(line == 1, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(F.col("l_orderkey").cast("decimal(20,0)"))
    coefficients = F.element_at(F.array(F.lit(0), F.lit(4), F.lit(7)), (line % 3 + 1).cast("int"))
    return l.select(
        "l_orderkey", "l_linenumber", bio.phred(F.col("l_partkey") % 94).alias("phred"), bio.rescale_sample(line % 4, 2).alias("rescaled"), bio.mask_to_range(F.col("l_partkey"), F.lit(1024)).alias("masked"),
        bio.saturate(wide).alias("saturated"), F.round(bio.frequency_to_mz(n, coefficients, F.lit(1.5), F.lit(2.5), F.lit(3.5)), 9).alias("mz"),
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS run_date, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS day, CAST(l_shipdate AS TIMESTAMP) AS iso, make_timestamp(CAST(l_orderkey AS BIGINT) * 1000000000) AS filetime FROM lineitem""")
def date_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of date that instruments write, in turn by line; years of two digits are of 1970 to 2069."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    at, line = F.col("l_shipdate").cast("timestamp_ntz"), F.col("l_linenumber")
    form = lambda *forms: F.element_at(F.array(*(F.date_format(at, f) for f in forms)), (line % len(forms) + 1).cast("int"))
    return l.select(
        "l_orderkey", "l_linenumber", bio.run_date(form("dd-MMM-yy, HH:mm:ss", "dd MMM yy h:mm a", "MM/dd/yy hh:mm:ss a")).alias("run_date"), bio.cytometry_date(form("dd-MMM-yy", "dd-MMM-yyyy", "yyyy-MMM-dd", "dd-MM-yyyy")).alias("day"),
        bio.iso_date(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"), bio.filetime(F.col("l_orderkey").cast("long") * 10_000_000_000 + 116_444_736_000_000_000).alias("filetime"),
    )


# -- delimited text ----------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, replace(CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR), '.', ',') AS quantity, CAST(l_partkey AS DOUBLE) + 0.5 AS part FROM lineitem")
def csv_decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal commas look like numbers and cannot be cast: the column stays text, the others get their types."""
    path = scratch(spark)
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    l.select("l_orderkey", "l_linenumber", F.translate(F.col("l_quantity").cast("double").cast("string"), ".", ",").alias("quantity"), (F.col("l_partkey") + 0.5).alias("part")).write.options(header=True, sep=";").csv(path)
    found = infer.typed(spark.read.options(header=True, sep=";").csv(path))
    return found.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT * FROM lineitem")
def csv_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as text through a CSV file; types from every cell, dates (never inferred) cast afterwards."""
    path = scratch(spark)
    table(spark, sf_dir, "lineitem").write.option("header", True).csv(path)
    found = infer.typed(spark.read.option("header", True).csv(path))
    return found.withColumns({"l_linenumber": F.col("l_linenumber").cast("int"), "l_shipdate": F.col("l_shipdate").cast("timestamp_ntz")})


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    schema = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])
    return unpacked(packed(n, "n_regionkey", ["n_nationkey"], lambda r: encode.delimited(list(r.columns), r.values.tolist())), "tsv", schema)


_MASK = "CASE WHEN trim({c}) IN ('T','t','TRUE','True','true','F','f','FALSE','False','false') THEN 3 WHEN regexp_full_match(trim({c}), '[0-9+\\- ]*[0-9][0-9+\\- ]*') THEN 9 WHEN regexp_full_match(trim({c}), '[0-9+\\- .,]*[0-9][0-9+\\- .,]*') AND regexp_matches({c}, '[.,]') THEN 5 ELSE 1 END"
_CELLS = {"l_orderkey": "CAST(l_orderkey AS VARCHAR)", "l_quantity": "CAST(l_quantity AS VARCHAR)", "l_returnflag": "l_returnflag", "mixed": "CASE WHEN l_linenumber = 1 THEN '1.5' ELSE CAST(l_partkey AS VARCHAR) END", "flag": "CASE WHEN l_linenumber > 3 THEN 'T' ELSE 'false' END"}


@query("SELECT " + ", ".join(f"CAST(bit_and({_MASK.format(c=n)}) AS INTEGER) AS {n}" for n in _CELLS) + " FROM (SELECT " + ", ".join(f"{c} AS {n}" for n, c in _CELLS.items()) + " FROM lineitem)")
def type_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return infer.type_masks(l.select(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), "l_returnflag", F.when(F.col("l_linenumber") == 1, "1.5").otherwise(F.col("l_partkey").cast("string")).alias("mixed"), F.when(F.col("l_linenumber") > 3, "T").otherwise("false").alias("flag")))


_COUNT = "length(line) - length(replace(line, d, ''))"
_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"SELECT place, delimiter, round(avg({_COUNT.replace('d,', 'delimiter,')}), 6) AS mean, round(var_pop({_COUNT.replace('d,', 'delimiter,')}), 4) AS variance FROM ({_LINES}), (VALUES (0, chr(9)), (1, ';'), (2, ':'), (3, '|'), (4, '~'), (5, ','), (6, '^'), (7, ' ')) AS c(place, delimiter) GROUP BY place, delimiter")
def delim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return infer.delimiter_stats(lines).select("place", "delimiter", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT delimiter, CAST(n AS BIGINT) AS n FROM (VALUES ('|', 4), (';', 4), (',', 4)) AS v(delimiter, n)")
def dialect_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables joined by different delimiters: what is found, and of how many columns."""
    found = []
    for name, d in (("nation", "|"), ("supplier", ";"), ("customer", ",")):
        df = table(spark, sf_dir, name)
        columns = [F.col(c).cast("string") for c in df.columns[:4]] + [F.lit("x")] * max(0, 4 - len(df.columns))
        lines = df.select(F.concat_ws(d, *columns).alias("value"))
        picked = infer.pick_delimiter(infer.delimiter_stats(lines))
        found.append(lines.agg(F.lit(picked).alias("delimiter"), F.max(F.size(F.split("value", "[" + picked + "]"))).cast("long").alias("n")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT p_partkey || chr(9) || p_name || chr(9) || p_brand || chr(9) || p_type || chr(9) || p_size || chr(9) || regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS line FROM part")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.lines(table(spark, sf_dir, "part"))


@query("SELECT r_regionkey AS a_b, r_name AS c_d FROM region")
def sanitize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.sanitize(table(spark, sf_dir, "region").toDF("a b", "c-d"))


# -- analytics ---------------------------------------------------------------


@query("""
SELECT 'l_quantity' AS "column", 'number' AS kind, min(l_quantity) AS min, max(l_quantity) AS max, count(*) AS n FROM lineitem
UNION ALL SELECT 'l_returnflag', 'length', CAST(min(length(l_returnflag)) AS DOUBLE), CAST(max(length(l_returnflag)) AS DOUBLE), count(*) FROM lineitem
UNION ALL SELECT 'l_partkey', 'number', CAST(min(l_partkey) AS DOUBLE), CAST(max(l_partkey) AS DOUBLE), count(*) FROM lineitem
""")
def bounds_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.bounds(table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_partkey"))


@query("SELECT 'l_extendedprice' AS \"column\", count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 0) AS variance, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem UNION ALL SELECT 'l_discount', count(*), round(avg(l_discount), 4), round(var_pop(l_discount), 0), min(l_discount), max(l_discount) FROM lineitem")
def streaming_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analytics.streaming_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount")
    return s.withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 0)})


@query("SELECT round(t.i * 50.0 / 199, 6) AS tick, round(avg(greatest(0, 1 - pow(0.1 * (l_quantity - t.i * 50.0 / 199), 2))), 6) AS density FROM (SELECT l_quantity FROM lineitem), range(200) AS t(i) GROUP BY t.i")
def kde_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.kernel_density(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0), "tick", "density")




@query("SELECT user_id, t AS time, list_sort(list(y || ':' || v))::VARCHAR AS spectrum FROM (SELECT user_id, epoch_us(date_trunc('day', ts)) // 1000000 AS t, event_type AS y, count(*) AS v FROM events GROUP BY ALL) GROUP BY user_id, t".replace("list_sort(list(y || ':' || v))::VARCHAR", "array_to_string(list_sort(list(y || ':' || v)), ',')"))
def spectra_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    s = analytics.spectra(e.select("user_id", "event_id", day.alias("time"), "event_type", F.lit(1).alias("intensity")), by=["user_id"], order="event_id", axis="event_type")
    told = F.array_join(F.array_sort(F.transform(F.map_entries("spectrum"), lambda x: F.concat_ws(":", x["key"], x["value"]))), ",")
    return s.select("user_id", "time", told.alias("spectrum"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS t FROM events)),
a AS (SELECT user_id, k, t, t AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.t, CASE WHEN o.t - a.anchor > 86400 THEN o.t ELSE a.anchor END FROM a JOIN o ON o.user_id = a.user_id AND o.k = a.k + 1)
SELECT user_id, anchor AS time, CAST(sum(n) AS BIGINT) AS n FROM a JOIN (SELECT user_id, epoch_us(ts) // 1000000 AS t, count(*) AS n FROM events GROUP BY ALL) USING (user_id, t) GROUP BY user_id, anchor
""")
def spectra_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"))
    marked = analytics.anchored(e.withColumn("order", F.col("time")), 86_400, ["user_id"], "order")
    return marked.groupBy("user_id", F.col("anchor").alias("time")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max(n) AS widest FROM (SELECT user_id, epoch_us(date_trunc('day', ts)) // 1000000 AS t, count(DISTINCT event_type) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def spectra_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an aggregate of the caller's own as the merge."""
    e = table(spark, sf_dir, "events")
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    s = analytics.spectra(e.select("user_id", day.alias("time"), "event_type", F.lit(1).alias("intensity")), merge=lambda c: F.sum(c * 2), by=["user_id"], axis="event_type")
    return s.groupBy("user_id").agg(F.max(F.size("spectrum")).cast("long").alias("widest"))


# -- instruments: a file for each supplier, a scan or a point for each of its lines ------

_OF = "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i FROM (SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem)"
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _instrument(spark: SparkSession, sf_dir: str, parser: str, write) -> DataFrame:
    found = unpacked(packed(_supplied(spark, sf_dir), "l_suppkey", _ORDER, write), parser)
    return rounded(found, *found.columns)


@query(f"SELECT round(0.2 * i, 6) AS time, round((l_partkey * 37 - 5000) * 0.5 + 2, 6) AS intensity FROM ({_OF})")
def chemstation_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "chemstation_fid", lambda r: encode.chemstation_fid((r.l_partkey * 37 - 5000).tolist(), mult=0.5, offset=2.0))


@query(f"SELECT round(0.2 * i, 6) AS time, 210.0::DOUBLE AS signal, CAST(l_partkey * 41 - 9000 AS DOUBLE) AS intensity FROM ({_OF})")
def chemstation_mwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "chemstation_mwd", lambda r: encode.chemstation_mwd((r.l_partkey * 41 - 9000).tolist(), signal="MWD A, Sig=210,5 Ref=360,100"))


def _pairs(r: pd.DataFrame) -> zip:
    return zip(r.l_orderkey.tolist(), r.l_linenumber.tolist(), r.l_partkey.tolist(), r.l_quantity.tolist())


_PACKED = "CASE WHEN v < 16384 THEN v WHEN v < 131072 THEN v // 8 * 8 WHEN v < 1048576 THEN v // 64 * 64 ELSE v // 512 * 512 END"


@query(f"SELECT time, mz, ({_PACKED})::DOUBLE AS intensity FROM (SELECT round(i * 600 / 60000.0, 6) AS time, (l_linenumber + k)::DOUBLE AS mz, l_partkey % 1000000 * CASE k WHEN 0 THEN 1 ELSE 8 END AS v FROM ({_OF}), (VALUES (0), (1)) AS p(k))")
def chemstation_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities have fourteen bits and an exponent of eight, so large ones lose their last bits."""
    found = unpacked(packed(_supplied(spark, sf_dir), "l_suppkey", _ORDER, lambda r: encode.chemstation_ms([(600 * i, [(20 * n, encode.pack_intensity(p % 1_000_000)), (20 * (n + 1), encode.pack_intensity(p % 1_000_000 * 8))]) for i, (_, n, p, _) in enumerate(_pairs(r))])), "chemstation_ms")
    return rounded(found, "time")


_POINTS = f"FROM ({_OF}), (VALUES (0), (1), (2)) AS p(k)"
_THREE = "CASE k WHEN 0 THEN l_partkey WHEN 1 THEN -l_orderkey WHEN 2 THEN l_linenumber * 40000 END"


def _three(r: pd.DataFrame) -> list[tuple]:
    return [(600 * i, 4000, 40, [p, -o, n * 40000]) for i, (o, n, p, _) in enumerate(_pairs(r))]


@query(f"SELECT round(i * 600 / 60000.0, 6) AS time, (200 + 2 * k)::DOUBLE AS wavelength, round(({_THREE}) / 2000.0, 6) AS intensity {_POINTS}")
def chemstation_dad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "chemstation_dad", lambda r: encode.chemstation_dad(_three(r)))


@query(f"SELECT round(i * 600 / 60000.0, 6) AS time, (200 + 2 * k)::DOUBLE AS wavelength, round(({_THREE}) * 0.25, 6) AS intensity {_POINTS}")
def chemstation_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "chemstation_uv", lambda r: encode.chemstation_uv(_three(r), mult=0.25))


@query(f"SELECT round((i + 1) / 300.0, 6) AS time, round(l_quantity * 2, 6) AS intensity FROM ({_OF})")
def chemstation_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "chemstation_array", lambda r: encode.chemstation_array(r.l_quantity.tolist(), 0, (1, 5), mult=2.0))


@query(f"SELECT i::DOUBLE AS time, 190.0 + 2.5 * k AS wavelength, (CASE k WHEN 0 THEN l_quantity ELSE l_partkey END)::DOUBLE AS intensity FROM ({_OF}), (VALUES (0), (1)) AS p(k)".replace("190.0 + 2.5 * k", "(190 + 2.5 * k)::DOUBLE"))
def masshunter_dad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "masshunter_dad", lambda r: encode.masshunter_dad([(float(i), 190.0, 2.5, [q, float(p)]) for i, (_, _, p, q) in enumerate(_pairs(r))]))


@query(f"SELECT round(i * 600 / 60000.0, 6) AS time, (10 + k)::DOUBLE AS mz, (CASE k WHEN 0 THEN l_partkey WHEN 1 THEN l_linenumber ELSE l_quantity END)::DOUBLE AS intensity {_POINTS} WHERE i % 2 = 0 OR k = 0")
def inficon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "inficon", lambda r: encode.inficon([[(1000, 1200, 1)], [(1000, 0, 0)]], [(600 * i, i % 2, [p, n, q] if i % 2 == 0 else [p]) for i, (_, n, p, q) in enumerate(_pairs(r))]))


_GAS = f"SELECT i::DOUBLE AS time, (44 + k)::DOUBLE AS mz, (CASE k WHEN 0 THEN l_partkey WHEN 1 THEN l_orderkey ELSE l_quantity END)::DOUBLE AS intensity {_POINTS}"


def _gas(r: pd.DataFrame) -> list:
    scans = [(60.0 * i, [p, o, q]) for i, (o, _, p, q) in enumerate(_pairs(r))]
    return [("CO2", part) for part in (scans[: len(scans) // 2], scans[len(scans) // 2 :]) if part]


@query(_GAS)
def thermo_dxf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "thermo_dxf", lambda r: encode.thermo_dxf(_gas(r)))


@query(_GAS)
def thermo_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "thermo_cf", lambda r: encode.thermo_cf(_gas(r)))


@query(f"SELECT i::DOUBLE AS time, round(10.0 + 2.0 / (100 + k) + 3.0 / ((100 + k) * (100 + k)), 6) AS mz, (CASE k WHEN 0 THEN l_partkey WHEN 1 THEN l_linenumber ELSE l_quantity END)::DOUBLE AS intensity {_POINTS}")
def thermo_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instrument(spark, sf_dir, "thermo_raw", lambda r: encode.thermo_raw([(float(i), 100.0, 1.0, [(0, [p, n]), (2, [q])]) for i, (_, n, p, q) in enumerate(_pairs(r))], (0.0, 10.0, 2.0, 3.0)))


@query("SELECT l_quantity AS \"Q-A\", l_extendedprice AS \"P-A\", CAST(l_orderkey AS DOUBLE) AS \"Time\" FROM lineitem")
def fcs_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")  # noqa: E741
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("Q-A", "P-A", "Time")])
    return unpacked(packed(l, "l_suppkey", _ORDER, lambda r: encode.flow({"Q-A": r.l_quantity.to_numpy(), "P-A": r.l_extendedprice.to_numpy(), "Time": r.l_orderkey.to_numpy()}, "D")), None, schema)


@query("SELECT CASE WHEN l_partkey > 1024 THEN l_partkey & 1023 ELSE l_partkey END AS \"FSC\", l_orderkey AS \"Time\" FROM lineitem")
def fcs_int_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("FSC", "Time")])
    return unpacked(packed(_supplied(spark, sf_dir), "l_suppkey", _ORDER, lambda r: encode.flow({"FSC": r.l_partkey.to_numpy(), "Time": r.l_orderkey.to_numpy()}, "I", 32, big=False, ranges={"FSC": 1024})), "flow", schema)


def _image(r: pd.DataFrame, channels: int, most: int) -> np.ndarray:
    v = np.stack([r.l_partkey, r.l_orderkey, r.l_linenumber, r.l_quantity.astype(int)], 1)[:, :channels] % most
    return v.reshape(-1, 1, channels)


@query(f"SELECT 0::BIGINT AS x, i AS y, l_partkey % 256 * 257 AS red, l_orderkey % 256 * 257 AS green, l_linenumber % 256 * 257 AS blue, 65535::BIGINT AS alpha FROM ({_OF})")
def png_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed(_supplied(spark, sf_dir), "l_suppkey", _ORDER, lambda r: encode.png(_image(r, 3, 256), 2, filters=(0, 1, 2, 3, 4))), None, get_format("png").schema)


@query(f"SELECT 0::BIGINT AS x, i AS y, l_partkey % 16 * 257 AS red, (l_partkey % 16) * 2 * 257 AS green, (l_partkey % 16) * 3 * 257 AS blue, 65535::BIGINT AS alpha FROM ({_OF})")
def png_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    palette = np.arange(16)[:, None] * np.array([1, 2, 3])
    return unpacked(packed(_supplied(spark, sf_dir), "l_suppkey", _ORDER, lambda r: encode.png(_image(r, 1, 16), 3, 4, palette)), "png")


@query(f"SELECT 0::BIGINT AS x, i AS y, l_partkey % 4 * 21845 AS red, l_partkey % 4 * 21845 AS green, l_partkey % 4 * 21845 AS blue, 65535::BIGINT AS alpha FROM ({_OF})")
def png_gray_lowbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed(_supplied(spark, sf_dir), "l_suppkey", _ORDER, lambda r: encode.png(_image(r, 1, 4), 0, 2)), "png")


@query("SELECT l_orderkey, l_linenumber, CAST((l_partkey & 16383) * pow(8, l_partkey >> 14) AS DOUBLE) AS intensity FROM lineitem")
def ms_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bio.packed_intensity(F.col("l_partkey")).alias("intensity"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(sum(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS BIGINT) AS level FROM lineitem")
def delta_decode_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences summed by a window instead of a decoder."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.sum("l_partkey").over(w).alias("level"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS path, 'instrument' AS key, n_name AS value FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'date', '2012-10-26T18:08:10' FROM nation")
def metadata_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of a data set for each nation, through files in the shared folder."""
    from recordframe.sources.reader import decode as one

    files = packed(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey"], lambda r: encode.flow({"a": np.arange(2)}, extra={"$CYT": r.n_name.iloc[0], "$DATE": "26-Oct-2012", "$BTIM": "18:08:10"}))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(p, k, sink.plain(v)) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, v in one(c)[0].metadata.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["path", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, key string, value string")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LETTERS} AS sequence FROM documents")
def udtf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordframe.api import register_udtf

    packed(_sequences(spark, sf_dir), "file", ["doc_id"], lambda r: encode.fasta(r.doc_id, r.sequence)).createOrReplaceTempView("fasta_files")
    name = register_udtf(spark, "fasta")
    return spark.sql(f"SELECT p.id, p.sequence FROM fasta_files, LATERAL {name}(content) p")


