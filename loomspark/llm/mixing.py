"""Mixing sources to target weights.

Sizes per source and per block of a source are summed by Spark; quotas, the number of passes over each source
and the division of block uses among output shards are worked out on the driver, from at most BLOCKS numbers and
eight more a source. The shards come from a splitting tree: at each node the uses of every source's blocks are
parted between two halves by a multivariate hypergeometric draw, so that each shard is an exact random part. The plan
becomes a table that the records are joined with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import join_checked, materialize, ship

#: Blocks of all sources together that a plan has, about; a source has as many as its share of the records asks, at least eight, and up to
#: A_SOURCE if it is small.
BLOCKS = 200_000
A_SOURCE = 1024


def quotas(size: dict[int, float], weight: dict[int, float], cap: dict[int, int], total: float | None = None) -> dict[int, float]:
    """How much of each source to take.

    Without `total`: the most that lets every source have its share exactly. With it: that much in all; sources that run
    out (cap times their size) give what they have, and the others the rest in proportion to their weights, or all they
    have if it is not enough.
    """
    usable = {s: w for s, w in weight.items() if w > 0 and size.get(s, 0) > 0}
    if not usable:
        return {}
    whole = sum(usable.values())
    if total is None:
        total = min(cap[s] * size[s] * whole / w for s, w in usable.items())
    out, left = {}, float(total)
    for s, w in sorted(usable.items(), key=lambda x: (cap[x[0]] * size[x[0]] / x[1], x[0])):  # those that run out first
        out[s] = min(left * w / whole, cap[s] * size[s]) if whole > 0 else 0.0
        left -= out[s]
        whole -= w
    return out


def splitting_tree(uses: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) counts that add up to `uses` exactly; every split is one multivariate hypergeometric draw."""
    out = np.zeros((shards, len(uses)), dtype=np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, n) if n else np.zeros_like(have)
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(uses.astype(np.int64), 0, shards)
    return out


def clean_sources(sources: DataFrame, limit: int = 10_000) -> list[dict]:
    """The mix: one row a (path, name); null, zero and NaN weights and rows without a path count as weight 0; no max_repeats as 1.

    Of rows that contradict each other the largest weight holds. More than `limit` sources are refused.
    """
    w = F.when(F.isnan(F.col("weight").cast("double")), 0.0).otherwise(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = sources.where("path is not null").groupBy("path", "name").agg(F.max(w).alias("weight"), F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))).alias("cap"))
    found = rows.orderBy(F.col("path").asc_nulls_first(), F.col("name").asc_nulls_first()).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} sources")
    return [{"source": k, "path": r["path"], "name": r["name"], "weight": r["weight"], "cap": int(r["cap"])} for k, r in enumerate(found)]


class Mix:
    """The plan of a mixture and what comes of it."""

    def __init__(self, df: DataFrame, sources: DataFrame, path: Column, name: Column, size: Column, id_col: str, shards: int = 8, total: float | str | None = None, seed: int = 1):
        """`total`: the size asked for, "all" for as much as the usable records have once over, None for the most that meets every share."""
        spark = df.sparkSession
        ship(spark)
        self.mix = clean_sources(sources)
        self.id_col, self.seed = id_col, seed
        schema = "source int, path string, name string, weight double, cap int"
        table = spark.createDataFrame([tuple(m[c] for c in ("source", "path", "name", "weight", "cap")) for m in self.mix], schema)
        records = df.select(F.col(id_col).alias("id"), path.alias("p"), name.alias("n"), F.coalesce(size.cast("long"), F.lit(0)).alias("size")).where("size > 0")
        t = F.broadcast(table)  # at most the limit of clean_sources
        records = records.join(t, records["p"].eqNullSafe(t["path"]) & records["n"].eqNullSafe(t["name"])).select("id", "source", "path", "name", "size")
        records = materialize(records, "records")  # ids and sizes alone, read several times below
        totals = records.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        self.sizes = sizes = {r["source"]: r["size"] for r in totals}
        weight, cap = {m["source"]: m["weight"] for m in self.mix}, {m["source"]: m["cap"] for m in self.mix}
        if total == "all":
            total = sum(n for s, n in sizes.items() if weight[s] > 0)
        self.quota = quotas(sizes, weight, cap, total)
        few = max(8, min(A_SOURCE, BLOCKS // max(1, len(self.mix))))
        per_block = max(1, sum(r["n"] for r in totals) // BLOCKS)
        blocks_of = {r["source"]: max(few, r["n"] // per_block if per_block > 1 else 0) for r in totals}
        counts = spark.createDataFrame(sorted(blocks_of.items()), "source int, blocks long")
        records = records.join(F.broadcast(counts), "source")  # at most the limit of clean_sources
        self.records = records.withColumn("block", F.expr(f"pmod(xxhash64(id, {seed}), blocks)").cast("int")).drop("blocks")
        blocks = self.records.groupBy("source", "block").agg(F.sum("size").alias("size")).collect()  # at most BLOCKS, and eight a source
        rng = np.random.default_rng(seed)
        per: dict[int, list] = {}
        for b in sorted(blocks, key=lambda b: (b["source"], b["block"])):
            per.setdefault(b["source"], []).append((b["block"], b["size"]))
        uses: dict[int, list[int]] = {}  # source -> blocks in the order of their uses
        self.edge: dict[int, tuple[int, int]] = {}  # source -> block used in part, and what is left to take of it
        for s, q in self.quota.items():
            passes = min(cap[s], int((q + 1e-6) // sizes[s]))
            order: list[int] = []
            for _ in range(passes):
                order += [per[s][k][0] for k in rng.permutation(len(per[s]))]
            left = q - passes * sizes[s]
            if passes < cap[s] and left > 0:
                torn = None
                for k in rng.permutation(len(per[s])):
                    block, n = per[s][k]
                    if n <= left:
                        order.append(block)
                        left -= n
                    elif torn is None:
                        torn = block
                if torn is not None and left > 0:
                    self.edge[s] = (torn, int(left))
                    order.append(torn)
            uses[s] = order
        ids = sorted(uses)
        tree = splitting_tree(np.array([len(uses[s]) for s in ids], dtype=np.int64), shards, rng) if ids else np.zeros((shards, 0), np.int64)
        rows: dict[tuple[int, int], list[int]] = {}
        edge_shard: dict[int, int] = {}
        for col, s in enumerate(ids):
            shard_of = np.repeat(np.arange(shards), tree[:, col])
            shard_of = shard_of[rng.permutation(len(shard_of))]
            for k, (block, shard) in enumerate(zip(uses[s], shard_of.tolist())):
                if s in self.edge and k == len(uses[s]) - 1:
                    edge_shard[s] = shard
                else:
                    rows.setdefault((s, block), []).append(shard)
        torn = {(s, b): (edge_shard[s], room) for s, (b, room) in self.edge.items()}
        plan = [(s, b, rows.get((s, b), []), *torn.get((s, b), (None, None))) for s in ids for b, _ in per[s] if (s, b) in rows or (s, b) in torn]
        self.plan = materialize(spark.createDataFrame(plan, "source int, block int, shards array<int>, edge_shard int, room long"), "plan")

    def chosen(self) -> DataFrame:
        """(id, path, name, size, uses, shards): the records taken, how often, and the shard of each use.

        A record is used as often as its source is passed over; of the last, part-way pass whole blocks are used, and
        of one block the records in the order of their hash as long as that comes nearer to the quota.
        """
        placed = join_checked(self.records, self.plan, ["source", "block"])
        inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("id", F.lit(self.seed + 1)), "id")  # one block of a source
        cut = placed.where("edge_shard is not null").withColumn("sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        cut = cut.withColumn("shards", F.when(F.col("sum") - F.col("size") / 2 <= F.col("room"), F.concat("shards", F.array("edge_shard"))).otherwise(F.col("shards"))).drop("sum")
        both = placed.where("edge_shard is null").unionByName(cut).where(F.size("shards") > 0)
        return both.select(F.col("id").alias(self.id_col), "path", "name", "size", F.size("shards").alias("uses"), "shards")

    def stream(self) -> DataFrame:
        """One row a use: (shard, id, path, name, use_no, order_key), each shard in the order of order_key, which is a shuffle.

        Ranges of (shard, order_key) are sorted apart, so that a shard may be larger than a task.
        """
        rows = self.chosen().select("shards", self.id_col, "path", "name").select(self.id_col, "path", "name", F.posexplode("shards").alias("use_no", "shard"))
        rows = rows.withColumn("order_key", F.xxhash64(self.id_col, "use_no", F.lit(self.seed + 2)))
        return rows.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")

    def quota_table(self) -> DataFrame:
        """(path, name, weight, max_repeats, available, target_share, quota) of every source of the mix."""
        whole = sum(m["weight"] for m in self.mix if m["source"] in self.quota)
        rows = [(m["path"], m["name"], m["weight"], m["cap"], self.sizes.get(m["source"], 0), m["weight"] / whole if m["source"] in self.quota and whole else 0.0, float(self.quota.get(m["source"], 0.0))) for m in self.mix]
        return self.records.sparkSession.createDataFrame(rows, "path string, name string, weight double, max_repeats int, available long, target_share double, quota double")

    def shares(self) -> DataFrame:
        """(path, name, weight, max_repeats, available, target_share, quota, taken, share, max_uses, records) of every source of the mix, also of those that give nothing."""
        target = self.quota_table()
        taken = self.chosen().groupBy(F.col("path").alias("p"), F.col("name").alias("n")).agg(F.sum(F.col("size") * F.col("uses")).alias("taken"), F.max("uses").alias("max_uses"), F.count("*").alias("records"))
        total = taken.agg(F.sum("taken").alias("total"))
        joined = F.broadcast(target).join(taken, target["path"].eqNullSafe(taken["p"]) & target["name"].eqNullSafe(taken["n"]), "left").crossJoin(F.broadcast(total))  # one row
        return joined.select("path", "name", "weight", "max_repeats", "available", "target_share", "quota", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce(F.col("taken") / F.col("total"), F.lit(0.0)).alias("share"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"), F.coalesce("records", F.lit(0)).alias("records"))
