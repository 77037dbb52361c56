"""Detection, reading files, metadata, errors, output, streams and the command line."""

import datetime as dt
import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordframe import __main__ as cli
from recordframe.api import Reader, read_metadata, read_records
from recordframe.formats import encode
from recordframe.formats.base import RecordFormatError
from recordframe.operators import analytics
from recordframe.sources import detect, sink
from recordframe.sources.reader import detect_files
from recordframe.streaming import stream_records


@pytest.mark.parametrize(
    "data,kind",
    [(b"\0\0\0\0", "unknown:0000"), (b"", "unknown:"), (b">", "unknown:3e"), (b">a", "fasta"), (b"@HD\tx", "sam"), (b"@PG\tx", "fastq"), (b"FCS3.1  ", "unknown:464353332e312020"), (b"FCS3.1  x", "facs"), (b"\xff\xff\x05\0x", "thermo_dxf")],
)
def test_magic(spark, data, kind):
    assert detect.from_magic(data) == kind
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(detect.magic_type(F.col("c"))).first()[0]
    assert got == kind


def test_parser_names():
    assert detect.parser_name("x", "anything") == "anything"
    for bad in ("unknown:0000", "masshunter_dad_header", "gif"):
        with pytest.raises(RecordFormatError):
            detect.parser_name(bad)
    with pytest.raises(RecordFormatError, match="#0000#"):
        detect.parser_name("unknown:0000")


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(encode.fasta(["x", "y"], ["ACGT", "GG"])))
    (tmp_path / "b").write_bytes(encode.fasta(["z"], ["T"]))
    df = read_records(spark, str(tmp_path), view="seqs")
    assert {(r.id, r.sequence, r._idx) for r in df.collect()} == {("x", "ACGT", 0), ("y", "GG", 1), ("z", "T", 0)}
    assert spark.sql("SELECT count(*) FROM seqs").first()[0] == 3
    kinds = {r.path.rsplit("/", 1)[1]: (r.file_type, r.parser) for r in detect_files(spark, str(tmp_path)).collect()}
    assert kinds == {"a": ("gzip", None), "b": ("fasta", "fasta")}
    assert read_records(spark, str(tmp_path), columns=["id"]).columns == ["_path", "_idx", "id"]


def test_two_file_format(spark, tmp_path):
    sp, sd = encode.masshunter_dad([(0.5, 190.0, 2.0, [1.0, 2.0])])
    (tmp_path / "DAD1.sp").write_bytes(sp)
    (tmp_path / "DAD1.sd").write_bytes(sd)
    df = read_records(spark, str(tmp_path), "masshunter_dad")
    assert [(r.time, r.wavelength, r.intensity) for r in df.orderBy("_idx").collect()] == [(0.5, 190.0, 1.0), (0.5, 192.0, 2.0)]


def test_schema_from_the_head(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    df = read_records(spark, str(tmp_path / "t.csv"), "csv")
    assert dict(df.dtypes) == {"_path": "string", "_idx": "bigint", "a": "bigint", "b": "string"}
    with pytest.raises(Exception, match="Unused params remain"):
        read_records(spark, str(tmp_path / "t.csv"), "csv", nonsense=1).collect()


def test_modes(spark, tmp_path):
    (tmp_path / "good").write_bytes(b">a\nAC\n")
    (tmp_path / "wrong").write_bytes(b">b")
    with pytest.raises(Exception, match="header line is not ended"):
        read_records(spark, str(tmp_path), "fasta").collect()
    lenient = read_records(spark, str(tmp_path), "fasta", mode="PERMISSIVE").collect()
    assert sorted((r.id, r._error and r._error.message) for r in lenient if r.id) == [("a", None)]
    assert [r._error.message for r in lenient if r.id is None] == ["The last header line is not ended"]
    assert read_records(spark, str(tmp_path), "fasta", mode="DROPMALFORMED").count() == 1


def test_metadata(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(encode.png(np.zeros((2, 3, 1), int), 0))
    got = {(r.key, r.value) for r in read_metadata(spark, str(tmp_path)).collect()}
    assert got == {("height", "2"), ("width", "3")}


@pytest.mark.parametrize("style,want", [("quote", '"a\tb"'), ("double", '"a\tb"'), ("escape", 'a"\tb'), ("replace", 'a"b')])
def test_styles(spark, style, want):
    assert sink.lines(spark.createDataFrame([("a\tb",)], "s string"), style).first()[0] == want


@pytest.mark.parametrize("value,want", [(1.0, "1"), (1e20, "100000000000000000000"), (1.5e-7, "0.00000015"), (-2.25, "-2.25"), (1.2345e10, "12345000000"), (0.1, "0.1"), (12345678.9, "12345678.9")])
def test_floats(spark, value, want):
    assert sink.lines(spark.createDataFrame([(value,)], "x double")).first()[0] == want


def test_values(spark):
    row = (None, True, dt.datetime(2001, 2, 3, 4, 5, 6), [1.0, 2.5])
    assert sink.lines(spark.createDataFrame([row], "a int, b boolean, c timestamp_ntz, d array<double>")).first()[0] == "null\ttrue\t2001-02-03T04:05:06\t1,2.5"


def test_write(spark, tmp_path):
    sink.write_tsv(spark.createDataFrame([("a", 1)], "x y string, z int".replace("x y", "`x y`")), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "x y\tz\na\t1\n"


def test_spectra(spark):
    rows = [("f", i, t, m, v) for i, (t, m, v) in enumerate([(0.0, 1.0, 1.0), (0.0, 2.0, 1.0), (0.4, 1.0, 5.0), (0.9, 1.0, 7.0), (2.0, 3.0, 1.0)])]
    df = spark.createDataFrame(rows, "_path string, _idx long, time double, mz double, intensity double")
    exact = {r.time: r.spectrum for r in analytics.spectra(df).collect()}
    assert exact == {0.0: {1.0: 1.0, 2.0: 1.0}, 0.4: {1.0: 5.0}, 0.9: {1.0: 7.0}, 2.0: {3.0: 1.0}}
    wide = {r.time: r.spectrum for r in analytics.spectra(df, 0.5).collect()}
    assert wide == {0.0: {1.0: 6.0, 2.0: 1.0}, 0.9: {1.0: 7.0}, 2.0: {3.0: 1.0}}
    with pytest.raises(KeyError):
        analytics.spectra(df.drop("mz"))


def test_stream_is_the_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_bytes(encode.fasta([f"r{i}"], ["ACGT"]))
    q = stream_records(spark, str(tmp_path), "fasta", max_files=1).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.id, r.sequence) for r in spark.sql("SELECT * FROM streamed").collect()} == {(r.id, r.sequence) for r in read_records(spark, str(tmp_path), "fasta").collect()}


def test_reader(spark):
    r = Reader(b">a b\nAC\n", parser="fasta", spark=spark)
    assert r.headers == ["id", "sequence"] and r.metadata == {} and r.parser == "fasta"
    assert [tuple(x) for x in r] == [("a b", "AC")]
    assert r.df.select("id").first()[0] == "a b"
    for bad in ({}, {"data": b"", "filename": "x"}):
        with pytest.raises(ValueError):
            Reader(**bad)


def test_command_line(tmp_path):
    out = io.StringIO()
    assert cli.main(["-p", "fasta"], io.BytesIO(b">test\nACGT"), out) == 0
    assert out.getvalue() == "id\tsequence\ntest\tACGT\n"
    out = io.StringIO()
    assert cli.main(["-m"], io.BytesIO(b">test\nACGT"), out) == 0 and out.getvalue() == "key\tvalue\n"
    assert cli.main([], io.BytesIO(b"\0\0\0\0"), io.StringIO()) == 1


def test_streamed_spectra(spark, tmp_path):
    from recordframe.streaming import stream_spectra

    for k in range(2):
        (tmp_path / f"f{k}").write_bytes(encode.chemstation_ms([(1000 * i, [(20, 5), (20, 7), (40, 1)]) for i in range(3)]))
    spectra = stream_spectra(stream_records(spark, str(tmp_path), "chemstation_ms", max_files=1), "2020-01-01 00:00:00")
    q = spectra.writeStream.format("memory").queryName("spectra").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r._path.rsplit("/", 1)[1], round(r.time * 60), r.mz, r.intensity) for r in spark.sql("SELECT * FROM spectra").collect())
    assert got == sorted((f"f{k}", i, m, v) for k in range(2) for i in range(3) for m, v in ((1.0, 12.0), (2.0, 1.0)))
    with pytest.raises(ValueError):
        stream_records(spark, str(tmp_path), "masshunter_dad")
