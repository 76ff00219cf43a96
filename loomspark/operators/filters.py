"""Keep rules, offsets, labels and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ranked


def keep_by_dimensions(scores: dict[str, Column], relevant: Column, threshold: float = 0.65, least: int | None = None) -> dict[str, Column]:
    """passed, relevant and keep: of the relevant dimensions that have a model, at least `least` (None: all) reach the threshold.

    Raises without any model: keeping everything for want of one is never meant.
    """
    if not scores:
        raise ValueError("no model to filter by")
    names = F.array(*[F.lit(d) for d in scores])
    table = F.map_from_arrays(names, F.array(*[c.cast("double") for c in scores.values()]))
    mine = F.array_intersect(relevant, names)
    passed = F.size(F.filter(mine, lambda d: F.coalesce(F.element_at(table, d) >= threshold, F.lit(False))))
    needed = F.size(mine) if least is None else F.least(F.lit(least), F.size(mine))
    return {"n_relevant": F.size(mine), "n_passed": passed, "keep": (F.size(mine) > 0) & (passed >= needed)}


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def classifier_report(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(label, n, precision, recall, f1) of each class and of all, from one aggregation; zero where nothing divides."""
    t, g = truth.cast("boolean"), guess.cast("boolean")
    c = df.select(t.alias("t"), g.alias("g")).where("t is not null and g is not null").agg(
        F.count(F.when(F.col("t") & F.col("g"), 1)).alias("tp"), F.count(F.when(~F.col("t") & F.col("g"), 1)).alias("fp"), F.count(F.when(F.col("t") & ~F.col("g"), 1)).alias("fn"), F.count(F.when(~F.col("t") & ~F.col("g"), 1)).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    row = lambda name, tp, fp, fn: F.struct(F.lit(name).alias("label"), (tp + fn).alias("n"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rows = F.array(row("high", tp, fp, fn), row("low", tn, fn, fp), row("all", tp + tn, fp + fn, fp + fn))
    return c.select(F.explode(rows).alias("x")).select("x.*").withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def has_fields(text: str, total: str) -> Column:
    """Whether a record has a text that is not blank and a total."""
    return (F.length(F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")))) > 0) & F.col(total).isNotNull()


def skip_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df without its first n rows in order."""
    return ranked(df, order).where(F.col("rank") > n).drop("rank")
