"""Records of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordframe.sources.formats import get_format
from recordframe.sources.reader import decode_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_records(spark: SparkSession, path: str, parser: str, mode: str = "FAILFAST", schema: T.StructType | None = None, max_files: int = 100, **options) -> DataFrame:
    """A stream of the records of new files under path; formats without a fixed schema need one.

    Formats that take two files are not streamed.
    """
    if parser == "masshunter_dad":
        raise ValueError("masshunter_dad takes two files and cannot be streamed")
    wanted = schema or get_format(parser).schema
    if wanted is None:
        raise ValueError(f"{parser} needs a schema")
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).load(path)
    return decode_files(files.select("path", "content"), wanted, parser, mode, options)


def stream_spectra(records: DataFrame, start: str, watermark: str = "1 minute", axis: str = "mz") -> DataFrame:
    """Spectra of a stream: records by file, exact time and axis value, merged by sum.

    start: a timestamp, to which the records' minutes are added for the watermark.
    """
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(start))) + F.round(F.col("time") * 60_000_000).cast("long"))
    timed = records.withColumn("at", at).withWatermark("at", watermark)
    return timed.groupBy("_path", F.window("at", "1 minute"), "time", axis).agg(F.sum("intensity").alias("intensity"))
