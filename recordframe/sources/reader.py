"""Files as DataFrames.

Bytes come through Spark's ``binaryFile`` source, so any file system that Spark
reads will do, and are decoded to Arrow batches where they are read: the plan
is a scan and a MapInArrow, without a shuffle.  A file is one task's work, as
most formats can only be read from their beginning; FASTA and SAM also have
scans by line in the JVM (``fasta_lines``, ``sam_lines``), which split large
files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from recordframe.formats.base import Decoded, RecordFormatError
from recordframe.sources import codecs, detect
from recordframe.sources.formats import get_format

BATCH = 65_536
ERROR = T.StructType([T.StructField("message", T.StringType()), T.StructField("byte", T.LongType()), T.StructField("record", T.LongType())])


def decode(data: bytes, parser: str | None = None, header: bytes | None = None, options: dict | None = None) -> tuple[Decoded, str]:
    """The content of a file, one layer of compression taken off, and the parser that read it."""
    try:
        data, _ = codecs.inflate(data)
    except RecordFormatError:
        raise
    except Exception as e:  # each codec has errors of its own
        raise RecordFormatError(f"The file cannot be decompressed: {type(e).__name__}: {e}", 0) from e
    name = detect.parser_name(detect.from_magic(data) if not parser else "", parser)
    found = get_format(name)
    options = dict(options or {})
    if unused := sorted(set(options) - set(found.options)):
        raise ValueError(f"Unused params remain: {', '.join(unused)}")
    if name == "masshunter_dad":
        options["header"] = header
    try:
        return found.decode(data, **options), name
    except RecordFormatError:
        raise
    except (ArithmeticError, LookupError, TypeError, ValueError, struct.error) as e:  # what a decoder did not foresee
        raise RecordFormatError(f"The file is not a whole {name} file: {type(e).__name__}: {e}") from e


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(found: Decoded, path: str, schema: pa.Schema, error=None) -> Iterator[pa.RecordBatch]:
    n = found.rows
    for a in range(0, max(n, 1 if error else 0), BATCH):
        size = min(BATCH, n - a) if n else 1
        columns = []
        for f in schema:
            if f.name == "_path":
                columns.append(pa.array([path] * size, pa.string()))
            elif f.name == "_idx":
                columns.append(pa.array(np.arange(a, a + size), pa.int64()) if n else pa.nulls(1, pa.int64()))
            elif f.name == "_error":
                columns.append(pa.array([error] * size, f.type))
            elif f.name in found.columns:
                c = found.columns[f.name][a : a + size]
                columns.append(c if c.type == f.type else c.cast(f.type))
            else:
                columns.append(pa.nulls(size, f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def decode_files(files: DataFrame, schema: T.StructType, parser: str | None = None, mode: str = "FAILFAST", options: dict | None = None) -> DataFrame:
    """Rows of files (path, content, and header for formats of two files): _path, _idx and the columns of schema.

    mode FAILFAST ends with the first broken file; PERMISSIVE gives it one row
    with ``_error``; DROPMALFORMED leaves it out.
    """
    if mode not in ("FAILFAST", "PERMISSIVE", "DROPMALFORMED"):
        raise ValueError(f"unknown mode {mode}")
    extra = [T.StructField("_error", ERROR)] if mode == "PERMISSIVE" else []
    out = T.StructType([T.StructField("_path", T.StringType()), T.StructField("_idx", T.LongType()), *schema.fields, *extra])
    if "header" not in files.columns:
        files = files.withColumn("header", F.lit(None).cast("binary"))
    arrow = _arrow(out)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, header in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                try:
                    found, _ = decode(content.as_py() or b"", parser, header.as_py(), options)
                    if found.columns and list(found.columns) != names and not set(names) <= set(found.columns):
                        raise RecordFormatError(f"Columns {list(found.columns)} differ from {names}")
                    yield from _batches(found, path, arrow)
                except RecordFormatError as e:
                    if mode == "FAILFAST":
                        raise RecordFormatError(e.message, e.byte, e.record, path) from None
                    if mode == "PERMISSIVE":
                        yield from _batches(Decoded({}), path, arrow, {"message": e.message, "byte": e.byte, "record": e.record})

    return files.select("path", "content", "header").mapInArrow(run, out)


def files(spark: SparkSession, path: str | list[str], parser: str | None = None) -> DataFrame:
    """(path, content) of files, and the companion files of formats that have two as ``header``."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    if parser != "masshunter_dad":
        return found
    name = F.regexp_replace("path", r"(?i)\.(sp|sd)$", "")
    of = lambda ending: found.filter(F.lower("path").endswith(ending)).withColumn("key", name)
    heads = of(".sd").select("key", F.col("content").alias("header"))
    return of(".sp").join(heads, "key", "left").drop("key")


def head_schema(data: bytes, parser: str | None, options: dict | None = None) -> T.StructType:
    """The columns of a file, by reading it."""
    found, _ = decode(data, parser, options=options)
    return from_arrow_schema(pa.schema([pa.field(n, c.type) for n, c in found.columns.items()]))


def read_records(spark: SparkSession, path: str | list[str], parser: str | None = None, mode: str = "FAILFAST", view: str | None = None, schema: T.StructType | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """The records of files; without a parser, that of the first file's type reads all of them.

    columns: only these are made.  view: a temporary view of that name is made.
    """
    found = files(spark, path, parser)
    if parser is None:
        first = found.first()
        if first is None:
            raise RecordFormatError("No files found", path=str(path))
        data, _ = codecs.inflate(bytes(first.content))
        parser = detect.parser_name(detect.from_magic(data))
        if parser == "masshunter_dad":
            found = files(spark, path, parser)
    parser = detect.ALIASES.get(parser, parser)
    wanted = schema or get_format(parser).schema
    if wanted is None:
        first = found.first()
        wanted = head_schema(bytes(first.content), parser, options) if first else T.StructType([])
    if columns is not None:
        wanted = T.StructType([wanted[c] for c in columns])
    out = decode_files(found, wanted, parser, mode, options)
    if view:
        out.createOrReplaceTempView(view)
    return out


def read_metadata(spark: SparkSession, path: str | list[str], parser: str | None = None) -> DataFrame:
    """(path, key, value) of every file, values as text."""
    from recordframe.sources.sink import plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, content, header in zip(*(b.column(i) for i in range(3))):
                found, _ = decode(content.as_py(), parser, header.as_py())
                rows += [(p.as_py(), k, plain(v)) for k, v in sorted(found.metadata.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), (), ()))], names=["path", "key", "value"])

    found = files(spark, path, parser)
    if "header" not in found.columns:
        found = found.withColumn("header", F.lit(None).cast("binary"))
    return found.select("path", "content", "header").mapInArrow(run, "path string, key string, value string")


def detect_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_type, parser, extension_types): only the first bytes leave the scan."""
    head = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 80).alias("head"))
    kind = detect.magic_type(F.col("head"))
    return head.select("path", kind.alias("file_type"), detect.parser_names(kind).alias("parser"), detect.extension_types(F.col("path")).alias("extension_types"))


# -- formats whose records are lines: scans in the JVM that split files ------


def fasta_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """_path, id, sequence of uncompressed FASTA files (or of ones with an extension that tells the codec)."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("_path"), F.regexp_replace("value", "^>", "").alias("value"))
    return raw.filter("value <> ''").select("_path", *fasta_columns(F.col("value")))


def fasta_columns(record: Column) -> list[Column]:
    """id and sequence of the text between two '>'; a stray '>' is an error."""
    head = F.substring_index(record, "\n", 1)
    rest = F.substring(record, F.length(head) + 2, F.length(record))
    sequence = F.regexp_replace(rest, r"[\r\n]", "")
    checked = F.when(F.instr(sequence, ">") > 0, F.raise_error(F.lit("Unexpected '>' found"))).otherwise(sequence)
    return [F.regexp_replace(head, "\r$", "").alias("id"), checked.alias("sequence")]


def sam_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """_path and the columns of alignments of SAM files."""
    raw = spark.read.text(path).select(F.input_file_name().alias("_path"), "value")
    return raw.filter("value <> '' and not value rlike '^@[A-Z][A-Z]\t'").select("_path", *sam_columns(F.col("value")))


def sam_columns(line: Column) -> list[Column]:
    f = F.split(line, "\t")
    cell = lambda i: F.get(f, i)
    some = lambda i: F.when(cell(i) == "*", "").otherwise(cell(i))
    number = lambda i: cell(i).cast("long")
    first = F.when(F.size(f) < 11, F.raise_error(F.lit("Sam record too short"))).otherwise(cell(0))
    return [
        first.alias("query_name"), number(1).alias("flag"), some(2).alias("ref_name"), (F.nullif(number(3), F.lit(0)) - 1).alias("pos"),
        F.when(cell(4) != "255", number(4)).alias("mapq"), some(5).alias("cigar"), some(6).alias("rnext"), (F.nullif(number(7), F.lit(0)) - 1).alias("pnext"),
        number(8).alias("tlen"), some(9).alias("sequence"), some(10).alias("quality"), F.array_join(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), "|").alias("extra"),
    ]
