"""The front door: readers of single inputs, as a façade over DataFrames."""

from __future__ import annotations

import os
from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordframe.formats.base import RecordFormatError
from recordframe.operators.analytics import spectra
from recordframe.sources import detect
from recordframe.sources.reader import decode, decode_files, head_schema, read_metadata, read_records
from recordframe.sources.formats import get_format, names, register_format

__all__ = ["Reader", "RecordFormatError", "get_format", "names", "read_metadata", "read_records", "register_format", "register_udtf", "spectra"]


class Reader:
    """One input (data, a file object, or a file name): headers, metadata, parser, rows and ``df``."""

    def __init__(self, data: bytes | str | None = None, filename: str | None = None, parser: str | None = None, spark: SparkSession | None = None, **options):
        if (data is None) == (filename is None):
            raise ValueError("exactly one of data and filename must be given")
        self.spark, self._filename, self._options = spark, filename, options
        header = None
        if data is None:
            with open(filename, "rb") as f:
                raw = f.read()
            beside = os.path.splitext(filename)[0]
            for end in (".sd", ".SD"):
                if os.path.exists(beside + end):
                    with open(beside + end, "rb") as f:
                        header = f.read()
        else:
            raw = data.read() if hasattr(data, "read") else data
            raw = raw.encode() if isinstance(raw, str) else bytes(raw)
        self._raw, self._header = raw, header
        self._found, self.parser = decode(raw, parser, header, options)
        self._at = 0

    @property
    def headers(self) -> list[str]:
        return list(self._found.columns)

    @property
    def metadata(self) -> dict:
        return dict(self._found.metadata)

    def _row(self):
        return namedtuple("Record", [h.replace(" ", "_").replace("-", "_") for h in self.headers], rename=True)

    def __iter__(self) -> Iterator:
        return self

    def __next__(self):
        if self._at >= self._found.rows:
            raise StopIteration
        row = self._row()._make(c[self._at].as_py() for c in self._found.columns.values())
        self._at += 1
        return row

    @property
    def df(self) -> DataFrame:
        """The rows as a DataFrame, decoded on an executor."""
        spark = self.spark or SparkSession.active()
        one = spark.createDataFrame([(self._filename or "", bytearray(self._raw), bytearray(self._header) if self._header else None)], "path string, content binary, header binary")
        schema = get_format(self.parser).schema or head_schema(self._raw, self.parser, self._options)
        return decode_files(one, schema, self.parser, options=self._options)

    def __repr__(self) -> str:
        return f"<Reader {self.parser}: {', '.join(self.headers)}>"


def register_udtf(spark: SparkSession, parser: str, name: str | None = None) -> str:
    """A table function for SQL, ``parse_<parser>(content)``, with the columns of that parser."""
    from pyspark.sql.functions import udtf

    schema = get_format(parser).schema
    if schema is None:
        raise ValueError(f"{parser} has no fixed schema")

    class Parse:
        def eval(self, content):
            found, _ = decode(bytes(content), parser)
            columns = [c.to_pylist() for c in found.columns.values()]
            yield from zip(*columns)

    name = name or f"parse_{parser}"
    spark.udtf.register(name, udtf(Parse, returnType=schema))
    return name


def detect_types(df: DataFrame, content: str = "content") -> DataFrame:
    """df with the file type and the parser of a binary column."""
    kind = detect.magic_type(F.col(content))
    return df.withColumns({"file_type": kind, "parser": detect.parser_names(kind)})


