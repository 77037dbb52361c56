"""Scalar functions on sequences and instrument values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_content(sequence: Column) -> Column:
    """The share of G and C among the bases; ambiguous ones of two count half, others not; null without bases."""
    s = F.upper(sequence)
    strong, weak, half = _count(s, "GCS"), _count(s, "ATUW"), _count(s, "RYKM")
    return F.try_divide(strong + half * 0.5, strong + weak + half)


def mean_quality(quality: Column) -> Column:
    """The mean code of the characters (not shifted); null for an empty text."""
    total = F.aggregate(F.transform(F.split(quality, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.try_divide(total, F.length(quality))


def packed_intensity(v: Column) -> Column:
    """Fourteen bits and an exponent of eight."""
    return v.bitwiseAND(16383).cast("double") * F.pow(F.lit(8.0), F.shiftright(v, 14))


def frequency_to_mz(n: Column, n_coefficients: Column, a: Column, b: Column, c: Column) -> Column:
    return F.when(n_coefficients == 0, n).when(n_coefficients == 4, a + b / n + c / F.pow(n, F.lit(2))).when(n_coefficients.isin(5, 7), a + b / F.pow(n, F.lit(2)) + c / F.pow(n, F.lit(4)))


def cigar_text(ops: Column) -> Column:
    """Packed CIGAR operations (array of integers) as text."""
    letters = F.lit("MIDNSHP=X")
    return F.array_join(F.transform(ops, lambda x: F.concat(F.shiftright(x, 4).cast("string"), F.substring(letters, x.bitwiseAND(15).cast("int") + 1, F.lit(1)))), "")


def phred(q: Column) -> Column:
    """A quality as a character: 33 more, 255 at most."""
    return F.chr(F.least(q + 33, F.lit(255)))


def zero_based(pos: Column) -> Column:
    return F.nullif(pos, F.lit(0)) - 1


def rescale_sample(v: Column, bits: int) -> Column:
    """A sample of so many bits on the scale to 65535."""
    return F.floor(v * 65535 / ((1 << bits) - 1)).cast("long")


def mask_to_range(v: Column, top: Column) -> Column:
    """Values above a range that is a power of two lose their higher bits; above others they are an error."""
    return F.when(v <= top, v).when(F.bit_count(top) == 1, v.bitwiseAND(top - 1)).otherwise(F.raise_error(F.lit("Range is not a power of two")).cast("long"))


def saturate(v: Column) -> Column:
    """An unsigned 64-bit value, as DECIMAL(20, 0), as LONG."""
    return F.least(v, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")


def signal_of(name: Column) -> Column:
    """The number after ``Sig=``, else 0."""
    return F.coalesce(F.regexp_extract(name, "Sig=([^,]*)", 1).try_cast("double"), F.lit(0.0))


def run_date(text: Column) -> Column:
    """The instruments' date forms, in turn; null where none fits."""
    forms = ("dd-MMM-yy, HH:mm:ss", "dd MMM yy h:mm a", "dd MMM yy h:mm a Z", "MM/dd/yy hh:mm:ss a")
    return F.coalesce(*(_century(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for f in forms))


def _century(t: Column) -> Column:
    """Years of two digits from 70 on are of the last century."""
    return F.when(F.year(t) >= 2070, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)


def cytometry_date(day: Column) -> Column:
    found = [F.try_to_timestamp(day, F.lit(f)).cast("timestamp_ntz") for f in ("dd-MMM-yy", "dd-MMM-yyyy", "yyyy-MMM-dd", "dd-MM-yyyy")]
    return F.coalesce(_century(found[0]), *found[1:], F.lit("2000-01-01").cast("timestamp_ntz"))


def iso_date(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def filetime(v: Column) -> Column:
    """100-nanosecond ticks since 1601 as a timestamp, in UTC whatever the session's zone."""
    seconds = (F.floor(v / 10).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")
    return F.lit("1601-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
