"""What the operators share: reading tables, scratch tables, mapping over texts."""

from __future__ import annotations

import atexit
import ctypes
import glob
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space and 0x09-0x0D.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='recordframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that read
    the table.  The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordframe-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)

    def drop() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and its files with the cluster's folder
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that is free in this process goes back to the system: workers outlive tasks, and stages follow one another."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def one_thread() -> None:
    """Matrix products in this process use one thread: a task has one core, and waiting threads burn the others'."""
    global _alone
    if not _alone:
        _alone = True
        folder = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs")
        for path in glob.glob(os.path.join(folder, "*openblas*")):
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break


_alone = False


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that keeps to its core, and gives memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with fn applied to each batch; fn may yield several smaller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(tidy(run), schema)


def free_name(name: str, columns: Sequence[str]) -> str:
    """name, or with as many underscores after it that no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_text: str | None = "") -> DataFrame:
    """Only (doc_id LONG, text BINARY in UTF-8): other columns never reach Python, so none can clash.

    null_text None keeps null texts null.
    """
    text = F.col(f"`{text_col}`").cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("text"))


def slices(ids: Iterable, texts: Iterable, most: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Runs of rows of about ``most`` bytes of text, so that what is built from them stays small; texts are taken as they are needed."""
    some: tuple[list, list] = [], []
    total = 0
    for i, t in zip(ids, texts):
        some[0].append(i)
        some[1].append(t)
        total += len(t or b"")
        if total >= most:
            yield some
            some, total = ([], []), 0
    if some[0]:
        yield some
