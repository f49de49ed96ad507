"""Exact ranks and order statistics of groups of any size, from counts of value ranges: no group is gathered, and no window runs over a whole one.

Rows are counted for each (group, range of values); the counts, which are few, are summed up in order; only a range's own rows are ordered among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _counted(rows: DataFrame) -> DataFrame:
    """(key, bin, in_bin, before, n) of rows (key, bin)."""
    counts = rows.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    w = Window.partitionBy("key").orderBy("bin")
    before = F.coalesce(F.sum("in_bin").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).withColumn("n", F.sum("in_bin").over(Window.partitionBy("key")))


def statistics(rows: DataFrame, by: list[str], value: str, wanted: dict[str, Callable[[Column], Column]], width: float) -> DataFrame:
    """(by, n and a column for each name): the value at a position (from 0, a function of the group's size n) in ascending order. ``width``: that of a range of values. Null values don't count; a null in ``by`` is a key."""
    keyed = cut(rows.where(F.col(value).isNotNull()).select(F.struct(*by).alias("key"), F.col(value).cast("double").alias("value")).withColumn("bin", F.floor(F.col("value") / width)))
    at = F.array(*[position(F.col("n")).cast("long") for position in wanted.values()])
    held = F.filter(at, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("in_bin")))
    bins = _counted(keyed).withColumn("at", at).withColumn("held", held).where("size(held) > 0")
    place = F.row_number().over(Window.partitionBy("key", "bin").orderBy("value")) - 1
    found = keyed.join(bins, ["key", "bin"]).withColumn("place", F.col("before") + place).where(F.array_contains("held", F.col("place")))
    out = found.groupBy("key").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("at")[k] == F.col("place"), F.col("value"))).alias(name) for k, name in enumerate(wanted)])
    return out.select("key.*", "n", *wanted)


def percent_rank(rows: DataFrame, value: str, width: float, name: str = "percent_rank") -> DataFrame:
    """``rows`` with the share of the other rows that have a smaller value; null values rank below all others."""
    keyed = rows.withColumn("key", F.lit(0)).withColumn("bin", F.coalesce(F.floor(F.col(value) / width), F.lit(-(1 << 62))))
    inside = F.rank().over(Window.partitionBy("bin").orderBy(F.col(value).asc_nulls_first())) - 1
    j = keyed.join(_counted(keyed.select("key", "bin")), ["key", "bin"])
    share = F.when(F.col("n") > 1, (F.col("before") + inside) / (F.col("n") - 1)).otherwise(0.0)
    return j.withColumn(name, share).drop("key", "bin", "in_bin", "before", "n")
