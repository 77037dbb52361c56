"""Dialect and types of delimited text by aggregates over all lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordframe.formats.delimited import BOOLEAN, DELIMITERS, FALSE, FLOAT, INTEGER, STRING, TRUE


def cell_mask(c: Column) -> Column:
    """The types that a cell can have, as bits."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (
        F.when(s.isin(*TRUE, *FALSE), STRING | BOOLEAN)
        .when(s.rlike(r"^[0-9+\- ]*[0-9][0-9+\- ]*$"), STRING | INTEGER)
        .when(s.rlike(r"^[0-9+\- .,]*[0-9][0-9+\- .,]*$") & s.rlike("[.,]"), STRING | FLOAT)
        .otherwise(STRING)
    )


def type_masks(df: DataFrame) -> DataFrame:
    """One row: for each column the AND of its cells' masks."""
    return df.agg(*(F.bit_and(cell_mask(F.col(f"`{c}`"))).alias(c) for c in df.columns))


def type_name(mask: Column) -> Column:
    return F.when(mask.bitwiseAND(INTEGER) > 0, "long").when(mask.bitwiseAND(FLOAT) > 0, "double").when(mask.bitwiseAND(BOOLEAN) > 0, "boolean").otherwise("string")


def typed(df: DataFrame) -> DataFrame:
    """Text columns with the types of all their cells; a column with a cell that cannot be cast stays text."""
    kinds = ((INTEGER, "long"), (FLOAT, "double"), (BOOLEAN, "boolean"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    told = [F.array(F.bit_and(cell_mask(c)).cast("long"), *(F.count_if(c.isNotNull() & F.trim(c).try_cast(n).isNull()) for _, n in kinds[:2])).alias(str(i)) for i, c in enumerate(columns)]
    masks = {c: m or [0, 0, 0] for c, m in zip(df.columns, df.agg(*told).first())} if columns else {}

    def kind(mask: int | None, no_long: int, no_double: int) -> str:
        found = next((n for bit, n in kinds if (mask or 0) & bit), "string")
        return "string" if found == "long" and no_long or found == "double" and no_double else found

    names = {c: kind(*masks[c]) for c in df.columns}

    def cast(c: str) -> Column:
        col = F.col(f"`{c}`")
        if names[c] == "boolean":
            return F.trim(col).isin(*TRUE).alias(c)
        return (col if names[c] == "string" else F.trim(col).try_cast(names[c])).alias(c)

    return df.select(*map(cast, df.columns))


def delimiter_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """(delimiter, mean, variance) of each candidate's count in a line."""
    c = F.col(column)
    counts = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(d).alias("delimiter"), (F.length(c) - F.length(F.replace(c, F.lit(d), F.lit("")))).alias("n")) for i, d in enumerate(DELIMITERS)))
    each = lines.select(F.explode(counts).alias("x")).select("x.*")
    return each.groupBy("place", "delimiter").agg(F.avg("n").alias("mean"), F.var_pop("n").alias("variance"))


def pick_delimiter(stats: DataFrame) -> str:
    """The one that varies least among those that lines have; a comma where there is none."""
    fit = stats.filter(F.col("mean") >= F.when(F.col("delimiter") == " ", 3).otherwise(1))
    found = fit.orderBy("variance", "place").limit(1).collect()
    return found[0].delimiter if found else ","
