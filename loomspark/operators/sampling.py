"""Samples, splits, crops and mixtures that any engine reproduces: their chance comes from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import hash_unit
from .ordering import ranked, running


def shuffle_key(key: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(seed)))


def sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """Exactly n rows (all if there are fewer), uniformly, without replacement."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def train_val(df: DataFrame, key: str, ratio: float, seed: str = "42") -> DataFrame:
    """(key, split): a shuffle whose first floor(n * ratio) rows are val."""
    n = df.count()
    rows = ranked(df.select(key, shuffle_key(F.col(key), seed).alias("h")), ["h", key])
    return rows.select(key, F.when(F.col("rank") <= int(n * ratio), "val").otherwise("train").alias("split"))


def crop(tokens: Column, key: Column, most: int, seed: str) -> Column:
    """At most `most` tokens of an array, from a uniform start."""
    room = F.size(tokens) - most
    start = F.floor(hash_unit(key, F.lit(seed)) * (room + 1)).cast("int")
    return F.when(room > 0, F.slice(tokens, start + 1, most)).otherwise(tokens)


def buffer_shuffle(df: DataFrame, order: str, size: int, seed: str) -> DataFrame:
    """df with `buffer` and `place`: consecutive rows in buffers of `size`, shuffled inside each."""
    rows = ranked(df, [order]).withColumn("buffer", F.expr(f"(rank - 1) div {size}"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("buffer").orderBy(shuffle_key(F.col(order), seed), order))).drop("rank")


def mix_probabilities(sources: DataFrame) -> DataFrame:
    """(path, name, weight, prob) of the sources with positive weights, which add up to one."""
    good = sources.where("weight > 0 and not isnan(weight)").groupBy("path", "name").agg(F.max("weight").alias("weight"))
    return good.crossJoin(F.broadcast(good.agg(F.sum("weight").alias("w")))).select("path", "name", "weight", (F.col("weight") / F.col("w")).alias("prob"))  # one row


def interleave(draws: DataFrame, draw: str, weights: list[tuple[str, float]], sizes: dict[str, int], strategy: str = "all_exhausted", seed: str = "mix") -> DataFrame:
    """(draw, source, k, item): the source of each draw by hashed chance, its k-th draw and the item that it takes, sources starting over when done.

    Draws end with the one that exhausts the last source (all_exhausted) or the first (first_exhausted). Ranks inside a
    source are taken over ranges of the draws, so that a heavy source is not one task.
    """
    total, upto, bounds = sum(w for _, w in weights), 0.0, []
    for name, w in weights:
        upto += w
        bounds.append((upto / total, name))
    cases = F.coalesce(*[F.when(F.col("u") < F.lit(b), F.lit(name)) for b, name in bounds])
    picked = draws.select(draw, hash_unit(F.col(draw), F.lit(seed)).alias("u")).withColumn("source", F.coalesce(cases, F.lit(weights[-1][0])))
    counted = running(picked, [draw], {f"c_{i}": (F.col("source") == n).cast("int") for i, (n, _) in enumerate(weights)})
    k = F.coalesce(*[F.when(F.col("source") == n, F.col(f"c_{i}") + 1) for i, (n, _) in enumerate(weights)])
    size = F.coalesce(*[F.when(F.col("source") == n, F.lit(sizes[n])) for n, _ in weights])
    rows = counted.select(draw, "source", k.alias("k"), size.alias("size"))
    ends = rows.where("k = size").groupBy("source").agg(F.min(draw).alias("at"))
    last = ends.agg((F.max if strategy == "all_exhausted" else F.min)("at").alias("last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col(draw) <= F.coalesce("last", F.col(draw))).select(draw, "source", "k", ((F.col("k") - 1) % F.col("size")).alias("item"))  # one row


def interleave_all(spark, weights: list[tuple[str, float]], sizes: dict[str, int], strategy: str = "all_exhausted", seed: str = "mix") -> DataFrame:
    """interleave() over as many draws as end it: first as many as are expected to, then twice as many until the last source is done.

    Sources without items or weight are left out; without any the result is empty.
    """
    use = [(n, w) for n, w in weights if w > 0 and sizes.get(n, 0) > 0]
    if not use:
        return interleave(spark.range(0).withColumnRenamed("id", "draw"), "draw", [("", 1.0)], {"": 1}, strategy, seed)
    total = sum(w for _, w in use)
    need = (max if strategy == "all_exhausted" else min)(sizes[n] * total / w for n, w in use)
    draws, upto, bounds = int(1.1 * need) + 100, 0.0, []
    for n, w in use:
        bounds.append((n, upto / total, (upto + w) / total))
        upto += w
    while True:
        u = spark.range(0, draws).select(hash_unit(F.col("id"), F.lit(seed)).alias("u"))
        got = u.agg(*[F.count(F.when((F.col("u") >= a) & ((F.col("u") < b) | F.lit(k == len(bounds) - 1)), 1)).alias(f"c{k}") for k, (_, a, b) in enumerate(bounds)]).first()
        done = [got[k] >= sizes[n] for k, (n, _, _) in enumerate(bounds)]
        if all(done) if strategy == "all_exhausted" else any(done):
            return interleave(spark.range(0, draws).withColumnRenamed("id", "draw"), "draw", use, sizes, strategy, seed)
        draws *= 2
