"""spark.read.format("records")."""

import bz2

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordframe.formats import encode
from recordframe.sources.datasource import register


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    register(spark)
    d = tmp_path_factory.mktemp("records")
    (d / "a").write_bytes(bz2.compress(encode.fasta(["x", "y"], ["ACGT", "GG"])))
    (d / "b").write_bytes(encode.fasta(["z"], ["T"]))
    (d / "_hidden").write_bytes(b"")
    return str(d)


def test_read(spark, folder):
    df = spark.read.format("records").load(folder)
    assert {(r._path.rsplit("/", 1)[1], r._idx, r.id, r.sequence) for r in df.collect()} == {("a", 0, "x", "ACGT"), ("a", 1, "y", "GG"), ("b", 0, "z", "T")}
    assert df.rdd.getNumPartitions() == 2


def test_columns_and_sql(spark, folder):
    df = spark.read.format("records").option("parser", "fasta").option("columns", "id").load(folder)
    assert df.columns == ["_path", "_idx", "id"]
    df.createOrReplaceTempView("r")
    assert spark.sql("SELECT count(*) FROM r WHERE id <> 'z'").first()[0] == 2


def test_path_filter(spark, folder):
    df = spark.read.format("records").load(folder).filter(F.col("_path") == f"{folder}/b")
    assert [r.id for r in df.collect()] == ["z"]


def test_metadata_and_errors(spark, tmp_path):
    register(spark)
    (tmp_path / "x").write_bytes(encode.png(np.zeros((2, 3, 1), int), 0))
    df = spark.read.format("records").option("mode", "metadata").load(str(tmp_path))
    assert {(r.key, r.value) for r in df.collect()} == {("height", "2"), ("width", "3")}
    (tmp_path / "x").write_bytes(b"broken")
    rows = spark.read.format("records").options(parser="fasta", mode="PERMISSIVE").load(str(tmp_path)).collect()
    assert [(r.id, r._error.message) for r in rows] == [(None, "Valid FASTA records start with '>'")]
