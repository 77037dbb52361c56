"""Scratch files in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir`` (under a folder of our own where that is unset and all runs on this machine), deleted at exit."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='recordframe-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top}/records-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, and its files with the cluster's folder
            pass

    atexit.register(drop)
    return path
