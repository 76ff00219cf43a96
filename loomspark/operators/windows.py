"""Order-dependent operators on documents and tokens: budgets, packing, windows, shards, heads and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ranked, running


def budget_split(df: DataFrame, order: str, size: Column, target: int, val_ratio: float = 0.1, with_val: bool = True) -> DataFrame:
    """(order, size, split): rows in order while the total before them is below target; `val` once the train part was full two rows before."""
    train = int(target * (1 - val_ratio))
    rows = running(df.select(order, size.alias("size")), [order], {"before": F.col("size")})
    taken = rows.where(F.col("before") < target)
    # the switch looks at the total before the previous row; it is found in the running totals, which only grow
    last = taken.where(F.col("before") < train).agg(F.max("rank").alias("switch"))
    return taken.crossJoin(F.broadcast(last)).select(order, "size", F.when(F.lit(with_val) & (F.col("rank") > F.coalesce(F.col("switch"), F.lit(0)) + 1), "val").otherwise("train").alias("split"))  # one row


def pack_stream(df: DataFrame, order: str, tokens: str, length: int, eos: int) -> DataFrame:
    """(chunk, input_ids, targets): documents in order, each followed by eos, cut into runs of length + 1 tokens.

    The last run is filled with eos if it has two tokens or more, else dropped. Each document is cut at the chunk borders
    it crosses, so rows are parts of documents, not tokens; a chunk is gathered from at most length + 1 tokens.
    """
    c = length + 1
    docs = df.select(order, F.concat(F.coalesce(F.col(tokens), F.array().cast("array<bigint>")), F.array(F.lit(eos).cast("bigint"))).alias("t"))
    placed = running(docs, [order], {"off": F.size("t")})
    parts = placed.select("off", "t", F.explode(F.sequence(F.expr(f"off div {c}"), F.expr(f"(off + size(t) - 1) div {c}"))).alias("chunk"))
    start = F.greatest(F.col("chunk") * c - F.col("off"), F.lit(0)).cast("int")
    stop = F.least((F.col("chunk") + 1) * c - F.col("off"), F.size("t")).cast("int")
    cut = parts.select("chunk", "off", F.slice("t", start + 1, stop - start).alias("t"))
    runs = cut.groupBy("chunk").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("off", "t"))), lambda x: x["t"])).alias("t")).where(F.size("t") >= 2)
    full = F.concat("t", F.array_repeat(F.lit(eos).cast("bigint"), c - F.size("t")))
    return runs.select("chunk", full.alias("f")).select("chunk", F.slice("f", 1, length).alias("input_ids"), F.slice("f", 2, length).alias("targets"))


def strided_windows(df: DataFrame, id_col: str, tokens: str, length: int, stride: int) -> DataFrame:
    """(id, window, start, input_ids, targets) of each token array: starts every `stride`, the last moved back to fit; shorter arrays have none."""
    n = F.size(tokens)
    count = F.greatest(F.lit(1), F.floor((n - length - 1) / stride) + 1).cast("int")
    rows = df.where(n >= length + 1).select(id_col, tokens, F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    start = F.least(F.col("window") * stride, F.size(tokens) - length - 1)
    return rows.select(id_col, "window", start.alias("start"), F.slice(tokens, start + 1, length).alias("input_ids"), F.slice(tokens, start + 2, length).alias("targets"))


def shard_plan(df: DataFrame, order: str, per_shard: int) -> DataFrame:
    """(order, shard, row_in_shard): consecutive rows in order, per_shard each."""
    return ranked(df.select(order), [order]).select(order, F.expr(f"(rank - 1) div {per_shard}").alias("shard"), F.expr(f"(rank - 1) % {per_shard}").alias("row_in_shard"))


def group_lines(df: DataFrame, order: list[str], line: str, per_doc: int = 50) -> DataFrame:
    """(doc, text): every per_doc lines in order joined by line breaks; an incomplete last group is dropped."""
    rows = ranked(df.select(*order, line), order).select(F.expr(f"(rank - 1) div {per_doc}").alias("doc"), "rank", line)
    docs = rows.groupBy("doc").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", line))).alias("l"))  # per_doc lines
    return docs.where(F.col("n") == per_doc).select("doc", F.array_join(F.transform("l", lambda x: x[line]), "\n").alias("text"))


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with `batch` (consecutive rows in order, from 0) and `batch_size`; the last batch may be shorter."""
    n = df.count()
    rows = ranked(df, [order]).withColumn("batch", F.expr(f"(rank - 1) div {size}")).drop("rank")
    return rows.withColumn("batch_size", F.least(F.lit(size), F.lit(n) - F.col("batch") * size).cast("long"))


def causal_window(df: DataFrame, key: str, tokens: str, window: int) -> DataFrame:
    """(key, pos, first_seen, n_seen): what each position of an array attends to, itself included, at most `window` back."""
    rows = df.where(F.size(tokens) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.size(tokens).cast("long") - 1)).alias("pos"))
    first = F.greatest(F.lit(0).cast("long"), F.col("pos") - (window - 1))
    return rows.select(key, "pos", first.alias("first_seen"), (F.col("pos") - first + 1).alias("n_seen"))
