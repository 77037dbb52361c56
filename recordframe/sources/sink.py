"""Tab-separated output, by expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(v) -> str | None:
    """A metadata value as the writer shows it."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, float):
        import numpy as np

        return np.format_float_positional(v, trim="-")
    return str(v)


def _float(c: Column) -> Column:
    """The shortest digits that give the number back, without an exponent, and 1 for 1.0."""
    s = c.cast("string")
    mantissa, power = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).try_cast("int")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(mantissa, "^-", "")
    digits = F.regexp_replace(F.regexp_replace(body, r"\.0$", ""), r"\.", "")
    whole = F.length(F.substring_index(body, ".", 1)) + power
    large = F.rpad(digits, F.greatest(whole, F.length(digits)), "0")
    shifted = F.when(whole >= F.length(digits), large).when(whole > 0, F.concat(F.substring(digits, F.lit(1), whole), F.lit("."), F.substring(digits, whole + 1, F.length(digits)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits))
    return F.when(s.contains("E"), F.concat(sign, shifted)).otherwise(F.regexp_replace(s, r"\.0$", ""))


def cell(c: Column, kind: T.DataType, style: str = "quote", delimiter: str = "\t", mark: str = '"') -> Column:
    """A value as text.

    style: ``quote`` puts marks around text with the delimiter in it, ``double``
    also doubles marks inside, ``escape`` puts the mark before each delimiter,
    ``replace`` puts the mark in its place.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _float(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")
    elif isinstance(kind, T.ArrayType):
        item = lambda x: F.coalesce(cell(x, kind.elementType, style, delimiter, mark), F.lit("null"))
        out = F.array_join(F.transform(c, item), ",")
    elif isinstance(kind, (T.MapType, T.StructType)):
        raise TypeError("nested records cannot be written as text")
    elif isinstance(kind, T.StringType):
        has = F.instr(c, delimiter) > 0
        sharp = F.replace(c, F.lit(mark), F.lit(mark * 2)) if style == "double" else c
        out = {
            "quote": F.when(has, F.concat(F.lit(mark), sharp, F.lit(mark))).otherwise(c),
            "double": F.when(has, F.concat(F.lit(mark), sharp, F.lit(mark))).otherwise(c),
            "escape": F.replace(c, F.lit(delimiter), F.lit(mark + delimiter)),
            "replace": F.replace(c, F.lit(delimiter), F.lit(mark)),
        }[style]
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


def lines(df: DataFrame, style: str = "quote", delimiter: str = "\t", mark: str = '"') -> DataFrame:
    """A column ``line``: each row as text, without the names."""
    cells = [cell(F.col(f"`{f.name}`"), f.dataType, style, delimiter, mark) for f in df.schema]
    return df.select(F.concat_ws(delimiter, *cells).alias("line"))


def write_tsv(df: DataFrame, path: str, style: str = "quote", delimiter: str = "\t", mark: str = '"') -> None:
    """Text files in a folder; each has the names in its first line."""
    name = lambda n: mark + n + mark if style in ("quote", "double") and delimiter in n else n
    head = delimiter.join(map(name, df.columns))
    out = lines(df, style, delimiter, mark)

    def run(batches):
        import pyarrow as pa

        begun = False
        for b in batches:
            if not begun:
                yield pa.RecordBatch.from_arrays([pa.array([head], b.schema.field(0).type)], schema=b.schema)
                begun = True
            yield b

    out.mapInArrow(run, "line string").write.text(path)


def sanitize(df: DataFrame) -> DataFrame:
    """Spaces and hyphens of names become underscores."""
    return df.toDF(*(c.replace(" ", "_").replace("-", "_") for c in df.columns))
