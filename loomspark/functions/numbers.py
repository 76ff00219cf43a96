"""Numeric functions as column expressions: sizes, schedules, probabilities, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_size(text: Column) -> Column:
    """1.3B, 350M, 64k, 1_300_000 as a whole number; null if it is none of these."""
    clean = F.upper(F.replace(F.trim(text), F.lit("_"), F.lit("")))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*([KMBT]?)$"
    unit = F.regexp_extract(clean, pattern, 2)
    factor = F.when(unit == "K", F.lit(1e3)).when(unit == "M", F.lit(1e6)).when(unit == "B", F.lit(1e9)).when(unit == "T", F.lit(1e12)).otherwise(F.lit(1.0))
    number = F.nullif(F.regexp_extract(clean, pattern, 1), F.lit("")).cast("double")
    return F.floor(number * factor + 1e-6).cast("long")


def format_size(n: Column) -> Column:
    shown = lambda unit, places, sign: F.concat(F.format_string(f"%.{places}f", n / F.lit(unit)), F.lit(sign))
    return F.when(n >= 1e12, shown(1e12, 2, "T")).when(n >= 1e9, shown(1e9, 2, "B")).when(n >= 1e6, shown(1e6, 1, "M")).when(n >= 1e3, shown(1e3, 1, "K")).otherwise(n.cast("string"))


def token_dtype(vocabulary: Column) -> Column:
    return F.when(vocabulary <= 65535, F.lit("uint16")).otherwise(F.lit("uint32"))


def perplexity(ce: Column) -> Column:
    return F.exp(F.least(ce, F.lit(20.0)))


def learning_rate(step: Column, lr: float, min_lr: float, warmup: int, max_steps: int) -> Column:
    """Factor of lr: linear to 1 over the warm-up, then half a cosine down to min_lr / lr."""
    progress = (step - warmup) / F.lit(float(max(max_steps - warmup, 1)))
    low = min_lr / lr
    return F.when(step < warmup, step / F.lit(float(max(warmup, 1)))).otherwise(low + (1 - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def logsumexp(values: Column) -> Column:
    """Stable ln of the sum of exp over an array, null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax(values: Column) -> Column:
    total = logsumexp(values)
    return F.transform(values, lambda x: F.exp(x - total))


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.size(values)
    return F.transform(values, lambda x: x / F.sqrt(mean + eps))


def halt_distribution(p: Column, eps: float = 1e-8) -> Column:
    """Array of halting probabilities p_i times the rest before it; what remains goes to the last; sums to one."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(1.0).alias("left"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps))
    folded = F.aggregate(p, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["left"] * clamp(x))).alias("out"), (a["left"] * (1 - clamp(x))).alias("left")))
    raw = F.transform(folded["out"], lambda x, i: F.greatest(F.when(i == F.size(p) - 1, x + folded["left"]).otherwise(x), F.lit(eps)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def geometric_divergence(dist: Column, rate: float = 0.5) -> Column:
    """Kullback-Leibler divergence of a distribution (array) from the geometric one cut at its length."""
    whole = 1 - F.pow(F.lit(1 - rate), F.size(dist))
    terms = F.transform(dist, lambda x, i: x * (F.log(x) - F.log(F.lit(rate) * F.pow(F.lit(1 - rate), i) / whole)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    return F.when(seen, F.when(logit > 0, logit / penalty).otherwise(logit * penalty)).otherwise(logit)


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by "-": the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def greedy_token(logits: Column) -> Column:
    """The place of the largest value, from 0, the first of equals."""
    return F.array_position(logits, F.array_max(logits)) - 1


def sampled_token(logits: Column, chance: Column) -> Column:
    """The token that a draw `chance` (0 to 1) from the softmax falls on, from 0."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  a value named once is computed once
    weights = bound(logits, lambda x: bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

    def passed(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
        count = lambda t: F.aggregate(w, start, lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + F.when((a["sum"] + v) / t <= chance, 1).otherwise(0)).alias("n")))["n"]
        return bound(total, count)

    return F.least(bound(weights, passed), F.size(logits).cast("long") - 1)
