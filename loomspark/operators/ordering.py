"""Running totals and ranks over a whole table in order, without moving it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import join_checked, materialize

#: Rows of a range, on average.
PER_RANGE = 500_000


def running(df: DataFrame, order: list[str], sums: dict[str, Column], per_range: int = PER_RANGE) -> DataFrame:
    """df with, for each name in sums, the total over the rows before this one, and `rank` from 1.

    The rows are parted into ranges of the order; totals of the ranges (as many rows as there are ranges) are
    summed and added to the running totals inside each range. Orders must be unique for a defined result.
    """
    n = df.count()
    ranges = max(1, -(-n // per_range))
    valued = df.select("*", *[e.alias(f"_v_{k}") for k, e in sums.items()])
    if ranges > 1:
        placed = materialize(valued.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        placed = valued.withColumn("_range", F.lit(0))
    totals = placed.groupBy("_range").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(f"_v_{k}"), F.lit(0)).alias(f"_t_{k}") for k in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    w = Window.partitionBy("_range").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_range")
    out = out.select(*df.columns, (F.row_number().over(w) + F.col("_n0")).alias("rank"), *[(F.coalesce(F.sum(f"_v_{k}").over(before), F.lit(0)) + F.col(f"_o_{k}")).alias(k) for k in sums])
    return out


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    return running(df, order, {})


def numbered(df: DataFrame, series: str, order: list[str]) -> DataFrame:
    """df with `n`: the row's number in its series, from 0. Ranges of (series, order) are ranked, so a long series is many tasks."""
    r = ranked(df, [series, *order])
    first = r.groupBy(F.col(series).alias("_series")).agg(F.min("rank").alias("_first"))
    return join_checked(r, first, r[series].eqNullSafe(F.col("_series"))).withColumn("n", F.col("rank") - F.col("_first")).drop("rank", "_first", "_series")


def with_previous(df: DataFrame, series: str, order: list[str], value: Column, name: str, per_range: int = PER_RANGE) -> DataFrame:
    """df with `name`: the value of the series' row before, null at its start. Each range hands its last row on to the next."""
    n = df.count()
    ranges = max(1, -(-n // per_range))
    placed = df.withColumn("_v", value)
    if ranges > 1:
        placed = materialize(placed.repartitionByRange(ranges, series, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        placed = placed.withColumn("_range", F.lit(0))
    row = F.struct(F.col(series).alias("s"), F.col("_v").alias("v"))
    last = placed.groupBy("_range").agg(F.max_by(row, F.struct(series, *order)).alias("_edge"))  # one row a range
    edges = last.select("_range", F.lag("_edge").over(Window.orderBy("_range")).alias("_edge"))
    w = Window.partitionBy("_range").orderBy(series, *order)
    out = placed.join(F.broadcast(edges), "_range").withColumn("_before", F.coalesce(F.lag(row).over(w), F.col("_edge")))
    return out.withColumn(name, F.when(F.col("_before.s").eqNullSafe(F.col(series)), F.col("_before.v"))).drop("_v", "_range", "_edge", "_before")
