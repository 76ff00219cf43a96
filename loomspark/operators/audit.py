"""Reports on a corpus: lengths, domains, scores, boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds and names of the length buckets.
BUCKETS = ((500, "<500"), (2000, "500-2k"), (5000, "2k-5k"), (10000, "5k-10k"), (None, "10k+"))


def nearest_ranks(df: DataFrame, value: Column, shares: dict[str, float]) -> DataFrame:
    """One row: avg, min, max, n and for each share the value at position floor(n * share) of the sorted values.

    The values are counted first; ranks are searched in the counts, of which there are as many as distinct values.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # distinct values of a length or score
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))
    ranked = counts.select("v", "c", upto.alias("upto"), total.alias("n"))
    at = lambda s: (F.col("upto") > F.floor(F.col("n") * s)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") * s))
    return ranked.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"),
        *[F.max(F.when(at(s), F.col("v"))).alias(k) for k, s in shares.items()],
    )


def length_buckets(df: DataFrame, length: Column) -> DataFrame:
    """(bucket, n, pct) with empty buckets as zero."""
    low, cases = 0, []
    for high, name in BUCKETS:
        inside = (F.col("l") >= low) & (F.col("l") < high) if high else F.col("l") >= low
        cases.append(F.struct(F.lit(name).alias("bucket"), F.count(F.when(inside, 1)).alias("n")))
        low = high
    one = df.select(length.alias("l")).agg(F.array(*cases).alias("b"), F.count("l").alias("total"))
    return one.select(F.explode("b").alias("x"), "total").select("x.bucket", "x.n", F.when(F.col("total") > 0, F.round(100.0 * F.col("x.n") / F.col("total"), 4)).otherwise(0.0).alias("pct"))


def top_values(df: DataFrame, value: Column, order: str, k: int = 20) -> DataFrame:
    """The k most frequent values; of equal counts the one seen first by order."""
    counts = df.select(value.alias("value"), order).groupBy("value").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def concentration(df: DataFrame, value: Column, k: int = 10, order: str = "row_id") -> DataFrame:
    """(top, total, pct, flagged): the share of the k most frequent values; flagged above 50 %."""
    top = top_values(df, value, order, k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))
    return top.crossJoin(df.agg(F.count("*").alias("total"))).select("top", "total", F.round(100.0 * F.col("top") / F.greatest("total", F.lit(1)), 4).alias("pct"), (100.0 * F.col("top") > 50.0 * F.col("total")).alias("flagged"))


def histogram(df: DataFrame, columns: dict[str, Column], low: int, high: int) -> DataFrame:
    """(dim, score, n) for whole scores low..high of each column, zeros included; others are not counted."""
    out = []
    for name, c in columns.items():
        out += [F.struct(F.lit(name).alias("dim"), F.lit(s).alias("score"), F.count(F.when(c == s, 1)).alias("n")) for s in range(low, high + 1)]
    return df.agg(F.array(*out).alias("h")).select(F.explode("h").alias("x")).select("x.*")


def column_stats(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(dim, n, avg, min, max) over the non-null values of each column, in one scan."""
    parts = [F.struct(F.lit(k).alias("dim"), F.count(c).alias("n"), F.avg(c).alias("avg"), F.min(c.cast("double")).alias("min"), F.max(c.cast("double")).alias("max")) for k, c in columns.items()]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("x")).select("x.*")
