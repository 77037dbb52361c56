"""Spectra, bounds, statistics and densities of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordframe.functions.bio import gc_content, mean_quality

MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "count": F.count}


def axis_of(df: DataFrame) -> str:
    for c in ("mz", "wavelength"):
        if c in df.columns:
            return c
    raise KeyError("records have neither mz nor wavelength")


def spectra(df: DataFrame, time_res: float = 0, merge: str | Callable[[Column], Column] = "sum", by: list[str] | None = None, order: str = "_idx", axis: str | None = None, compat: bool = False) -> DataFrame:
    """A row for each spectrum: the columns of ``by``, time, and a map from axis values to merged intensities.

    A spectrum begins with the first record more than ``time_res`` after the
    first of the one before, so begins are found in order within each file (or
    other ``by``).  With time_res 0 and times that do not fall, a spectrum is
    the records of one time, and nothing has to be in order.

    merge: how the intensities of equal axis values become one, by name or as
    an aggregate (also a grouped-aggregate pandas UDF) of their column.

    compat: as a reader that loses the first record of all spectra but the
    first; kept for results that were made so.
    """
    axis = axis or axis_of(df)
    by = by if by is not None else [c for c in ("_path",) if c in df.columns]
    marked = anchored(df, time_res, by, order) if time_res or compat else df.withColumn("anchor", F.col("time"))
    if compat:
        from pyspark.sql import Window

        w = Window.partitionBy(*by).orderBy(order)
        marked = marked.withColumn("__new", (F.col("anchor") != F.lag("anchor").over(w)) & F.lag("anchor").over(w).isNotNull()).filter("not coalesce(__new, false)")
    fold = merge if callable(merge) else MERGE[merge]
    merged = marked.groupBy(*by, F.col("anchor").alias("time"), F.col(axis).alias("__y")).agg(fold(F.col("intensity")).alias("__v"))
    entries = F.array_sort(F.collect_list(F.struct("__y", "__v")))
    return merged.groupBy(*by, "time").agg(F.map_from_entries(entries).alias("spectrum"))


def anchored(df: DataFrame, time_res: float, by: list[str], order: str = "_idx", time: str = "time") -> DataFrame:
    """Every record with ``anchor``, the time of the first of its spectrum.

    The fold runs over each group's distinct times, not over its records.
    """
    kind = df.schema[time].dataType.simpleString()
    times = df.groupBy(*by, F.col(time).alias("__t")).agg(F.min(order).alias("__o"))
    listed = times.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__o", "__t"))).alias("__all"))
    zero = F.struct(F.lit(None).cast(kind).alias("anchor"), F.expr(f"cast(array() as array<struct<t:{kind},anchor:{kind}>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = F.when(s["anchor"].isNull() | (x["__t"] - s["anchor"] > time_res), x["__t"]).otherwise(s["anchor"])
        return F.struct(a.alias("anchor"), F.array_append(s["out"], F.struct(x["__t"].alias("t"), a.alias("anchor"))).alias("out"))

    found = listed.select(*by, F.explode(F.aggregate("__all", zero, step, lambda s: s["out"])).alias("__x")).select(*by, F.col("__x.t").alias(time), F.col("__x.anchor").alias("anchor"))
    return df.join(found, [*by, time])


def bounds(df: DataFrame) -> DataFrame:
    """(column, kind, min, max, n): of numbers, their range; of text, that of its length; sequences also have GC, qualities their mean code."""
    items = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            items.append((f.name, "number", c.cast("double")))
        elif isinstance(f.dataType, T.StringType):
            items.append((f.name, "length", F.length(c).cast("double")))
            if f.name == "sequence":
                items.append(("gc", "number", gc_content(c)))
            elif f.name == "quality":
                items.append(("mean_quality", "number", mean_quality(c)))
    wide = df.agg(*(g(c).alias(f"{p}{i}") for i, (_, _, c) in enumerate(items) for p, g in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, (name, kind, _) in enumerate(items)))
    return wide.select(F.explode(rows).alias("x"), "n").select("x.*", "n")


def profile(df: DataFrame) -> dict[str, str]:
    """The columns that a plot of these records would show first."""
    names = set(df.columns)
    if {"sequence", "quality"} <= names and "flag" not in names:
        return {"x": "gc", "y": "mean_quality", "color": "length"}
    if "sequence" in names and "flag" not in names:
        return {"x": "length", "y": "gc"}
    return dict(zip(("x", "y", "color"), [c for c in df.columns if not c.startswith("_")]))


def streaming_stats(df: DataFrame, *columns: str) -> DataFrame:
    """n, mean, population variance, min and max of each column, in one pass."""
    aggs = [g(F.col(f"`{c}`").cast("double")).alias(f"{p}{i}") for i, c in enumerate(columns) for p, g in (("n", F.count), ("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))]
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"mean{i}").alias("mean"), F.col(f"var{i}").alias("variance"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max")) for i, c in enumerate(columns)))
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def kernel_density(df: DataFrame, column: str, low: float, high: float, ticks: int = 200, bandwidth: float = 0.1) -> DataFrame:
    """(tick, density): the mean of max(0, 1 - (bandwidth d)^2) over all rows, at evenly spaced ticks.

    Rows are first counted by value, and each goes only to the ticks that it
    reaches; the rest add nothing to the sum.
    """
    step = (high - low) / max(1, ticks - 1)
    values = df.select(F.col(f"`{column}`").cast("double").alias("v")).filter("v is not null")
    counted = values.groupBy("v").agg(F.count("*").alias("c"))
    reach = 1 / bandwidth
    first = F.greatest(F.lit(0), F.ceil((F.col("v") - reach - low) / step)).cast("long")
    last = F.least(F.lit(ticks - 1), F.floor((F.col("v") + reach - low) / step)).cast("long")
    met = counted.withColumn("a", first).withColumn("b", last).filter("a <= b").select("v", "c", F.explode(F.sequence("a", "b")).alias("i"))
    d = (F.col("v") - (F.lit(low) + F.col("i") * step)) * bandwidth
    sums = met.groupBy("i").agg(F.sum(F.col("c") * F.greatest(F.lit(0.0), 1 - d * d)).alias("s"))
    n = counted.agg(F.sum("c").alias("n"))
    grid = df.sparkSession.range(ticks).withColumnRenamed("id", "i")
    return grid.join(sums, "i", "left").join(F.broadcast(n)).select((F.lit(low) + F.col("i") * step).alias("tick"), F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("n")).alias("density"))
