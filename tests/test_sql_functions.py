"""The SQL functions agree with the Column functions."""

from pyspark.sql import functions as F

from recordframe.functions import bio
from recordframe.functions.sql import register_functions
from recordframe.sources import detect


def test_agree(spark):
    register_functions(spark)
    heads = [m.ljust(9, b"\1") for _, t in detect.MAGIC for m, _ in t] + [b"", b"\0\0\0\0", b"\xff\xff\x05\0" + b"\0" * 48 + "CIsoGC".encode("utf-16-le") + b"\0" * 20]
    df = spark.createDataFrame([(bytearray(h),) for h in heads] + [(None,)], "c binary")
    for r in df.select(F.expr("record_type(c)").alias("a"), detect.magic_type(F.col("c")).alias("b"), "c").collect():
        assert r.a == r.b and (r.c is None or r.a == detect.from_magic(bytes(r.c)))
    s = spark.createDataFrame([("GCATN", "II5"), ("", ""), (None, None), ("RYKMgc", "~")], "q string, u string")
    for r in s.select(F.expr("gc_content(q)").alias("a"), bio.gc_content(F.col("q")).alias("b"), F.expr("mean_quality(u)").alias("c"), bio.mean_quality(F.col("u")).alias("d")).collect():
        assert r.a == r.b and r.c == r.d
    one = spark.sql("SELECT extension_types('a/b.ch') e, record_parser('facs') p, record_parser('gif') g, zero_based(0) z, zero_based(5) y, packed_intensity(16385) i, signal_of('MWD A, Sig=210,5') s").first()
    assert (list(one.e), one.p, one.g, one.z, one.y, one.i, one.s) == (["chemstation_array", "chemstation_fid", "chemstation_mwd"], "flow", None, None, 4, 8.0, 210.0)
