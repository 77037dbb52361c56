"""``spark.read.format("records")``: the decoders as a Python data source.

For callers that want a source by name.  Files are listed and opened through
pyarrow's file systems (local paths, s3://, hdfs://, gs://), one partition for
each; ``read_records`` goes through Spark's own file systems instead and is the
way for stores that only Spark reads.

Options: parser, mode (FAILFAST, PERMISSIVE, DROPMALFORMED, or ``metadata`` for
key and value of every file), columns (separated by commas: only these are
made), and the parser's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql import types as T

from recordframe.formats.base import Decoded, RecordFormatError
from recordframe.sources import codecs, detect
from recordframe.sources.formats import get_format
from recordframe.sources.reader import ERROR, _arrow, _batches, decode, head_schema

_KNOWN = ("path", "parser", "mode", "columns")
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "key", "value")])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _list(path: str) -> list[str]:
    system, place = _open(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(place) :].strip("/").split("/"))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not hidden(f.path))


def _read(path: str) -> bytes:
    system, place = _open(path)
    with system.open_input_stream(place, compression=None) as f:
        return f.read()


@dataclass
class _File(InputPartition):
    path: str


class RecordsReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.options, self.mode = dict(options), options.get("mode", "FAILFAST")
        self.fields, self.only = schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on ``_path`` picks the files; Spark applies all other filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("_path",), ("path",)):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f

    def partitions(self) -> list[_File]:
        found = [p for p in _list(self.options["path"]) if self.only is None or p in self.only]
        if self.options.get("parser") == "masshunter_dad":
            found = [p for p in found if p.lower().endswith(".sp")]
        return [_File(p) for p in found] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        parser, own = self.options.get("parser"), {k: v for k, v in self.options.items() if k not in _KNOWN}
        beside = partition.path[:-3] + ".sd"
        header = _read(beside) if parser == "masshunter_dad" else None
        arrow = _arrow(self.fields)
        try:
            found, _ = decode(_read(partition.path), parser, header, own)
            if self.mode == "metadata":
                from recordframe.sources.sink import plain

                rows = sorted((k, plain(v)) for k, v in found.metadata.items())
                columns = {"path": [partition.path] * len(rows), "key": [k for k, _ in rows], "value": [v for _, v in rows]}
                found = Decoded({k: pa.array(v, pa.string()) for k, v in columns.items()})
            yield from _batches(found, partition.path, arrow)
        except RecordFormatError as e:
            if self.mode == "PERMISSIVE":
                yield from _batches(Decoded({}), partition.path, arrow, {"message": e.message, "byte": e.byte, "record": e.record})
            elif self.mode != "DROPMALFORMED":
                raise RecordFormatError(e.message, e.byte, e.record, partition.path) from None


class RecordsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        if self.options.get("mode") == "metadata":
            return METADATA
        files = _list(self.options["path"])
        if not files:
            raise RecordFormatError("No files found", path=self.options["path"])
        parser = self.options.get("parser")
        if not parser:
            data, _ = codecs.inflate(_read(files[0]))
            parser = detect.parser_name(detect.from_magic(data))
        parser = detect.ALIASES.get(parser, parser)
        found = get_format(parser).schema or head_schema(_read(files[0]), parser, {k: v for k, v in self.options.items() if k not in _KNOWN})
        if self.options.get("columns"):
            found = T.StructType([found[c.strip()] for c in self.options["columns"].split(",")])
        extra = [T.StructField("_error", ERROR)] if self.options.get("mode") == "PERMISSIVE" else []
        return T.StructType([T.StructField("_path", T.StringType()), T.StructField("_idx", T.LongType()), *found.fields, *extra])

    def reader(self, schema: T.StructType) -> RecordsReader:
        return RecordsReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("records")`` known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordsDataSource)
