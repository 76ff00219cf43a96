"""Filling sequences of fixed capacity with items of varying length.

Only lengths decide, and there are at most `capacity` of them: the instance is a histogram, planned as a whole
on the driver whatever the number of items. Martello and Toth's reduction fixes the bins that provably dominate
all others with the same largest item, again and again, and best-fit-decreasing packs what is left, for all
items of a length at once. The plan is a list of (pattern, how many bins); each item finds its place by its
rank among the items of its length, which is counted by salted parts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import join_checked, ship

#: Tokens of one length that one task ranks, on average.
PER_TASK = 1_000_000

Pattern = tuple[tuple[int, int], ...]


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix dominating bins: (patterns fixed, lengths left).

    For the largest items w with room r = capacity - w: alone if nothing fits; with an item of exactly r, which
    no set of others can better; with the largest item that fits if no two items fit together.
    """
    left = {k: v for k, v in count.items() if v}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        order = sorted(left)
        for w in sorted(left, reverse=True):
            n = left.get(w, 0)
            if not n:
                continue
            while order and not left.get(order[0]):
                order.pop(0)
            room = capacity - w
            if room < order[0]:
                fixed.append((((w, 1),), n))
                left.pop(w)
                changed = True
                continue
            if room == w:
                if n > 1:
                    fixed.append((((w, 2),), n // 2))
                    changed = True
                    left[w] = n % 2
                    if not left[w]:
                        left.pop(w)
                continue
            partner = room if left.get(room) else None
            if partner is None:
                low = order[0]
                two = 2 * low if left[low] > 1 else low + next((x for x in order[1:] if left.get(x)), capacity)
                if two > room:  # no two items fit beside w
                    k = bisect_left(order, room + 1) - 1
                    while k >= 0 and (not left.get(order[k]) or order[k] == w and n < 2):
                        k -= 1
                    partner = order[k] if k >= 0 else None
            if partner is not None and partner != w:
                both = min(n, left[partner])
                fixed.append((((w, 1), (partner, 1)), both))
                changed = True
                for x in (w, partner):
                    left[x] -= both
                    if not left[x]:
                        left.pop(x)
            elif partner == w:
                fixed.append((((w, 2),), n // 2))
                changed = True
                left[w] = n % 2
                if not left[w]:
                    left.pop(w)
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit-decreasing over a histogram: bins of one pattern are filled together."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, n))

    for w in sorted(count, reverse=True):
        n = count[w]
        while n:
            k = bisect_left(rooms, w)
            if k == len(rooms):
                each = capacity // w
                if n // each:
                    put(capacity - each * w, ((w, each),), n // each)
                if n % each:
                    put(capacity - n % each * w, ((w, n % each),), 1)
                break
            room = rooms[k]
            pattern, m = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(k)
            each = room // w
            full = min(m, n // each)
            if full:
                put(room - each * w, (*pattern, (w, each)), full)
            n, m = n - full * each, m - full
            if m and n and n < each:
                put(room - n * w, (*pattern, (w, n)), 1)
                n, m = 0, m - 1
            if m:
                put(room, pattern, m)
    return [x for room in rooms for x in bins[room]]


def plan(count: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_instance(count, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """For each length the ranks' bins and offsets, as arrays to search in."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        base = 0
        for pattern, n in patterns:
            offset = 0
            for w, each in pattern:
                rows.setdefault(w, []).append((rank.get(w, 0), base, each, offset))
                rank[w] = rank.get(w, 0) + n * each
                offset += w * each
            base += n
        self.bins = base
        self.rows = {w: np.array(r, dtype=np.int64) for w, r in rows.items()}

    def find(self, w: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[w]
        at = r[np.searchsorted(r[:, 0], ranks, "right") - 1]
        inside = ranks - at[:, 0]
        return at[:, 1] + inside // at[:, 2], at[:, 3] + inside % at[:, 2] * w


def pack(df: DataFrame, capacity: int, id_col: str = "sample_id", tokens_col: str = "input_ids", per_task: int = PER_TASK) -> DataFrame:
    """(sequence, input_ids, n_tokens, items): items put together into sequences of at most `capacity` tokens.

    `items` names each part by its id, its start in the item, its length and its offset in the sequence. Only an item
    longer than the capacity is split, into full sequences and one rest that is packed like an item. Each token comes
    out once; the lengths are those of the arrays, whatever other columns say. Null and empty arrays give nothing,
    null tokens inside an array stay; rows that repeat are packed each; null ids are kept; an empty table gives none.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = df.sparkSession
    ship(spark)
    items = df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")).where(F.size("tokens") > 0)
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(capacity))
    parts = items.select("id", F.explode(starts).alias("start"), "tokens").select("id", "start", F.slice("tokens", F.col("start") + 1, F.lit(capacity)).alias("part"))
    parts = parts.withColumn("length", F.size("part"))
    lengths = items.select(F.size("tokens").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    full = F.when(F.col("n") % capacity == 0, F.col("n") / capacity).otherwise(F.floor(F.col("n") / capacity)).cast("long")
    rest = lengths.where(F.col("n") % capacity > 0).groupBy((F.col("n") % capacity).alias("w")).agg(F.sum("c").alias("c"))  # at most capacity - 1 rows
    count = {r["w"]: r["c"] for r in rest.collect()}
    n_full = lengths.agg(F.sum(full * F.col("c"))).first()[0] or 0
    places = Places(plan(count, capacity))
    spread = {w: c for w, c in count.items()} | ({capacity: n_full} if n_full else {})
    table = spark.createDataFrame([(w, max(1, -(-w * c // per_task))) for w, c in spread.items()], "length int, salts long")
    salted = parts.join(F.broadcast(table), "length").withColumn("salt", F.pmod(F.xxhash64("id", "start"), "salts"))  # at most `capacity` rows
    # how many parts of a length lie in earlier salts
    sizes = items.select(F.size("tokens").alias("n"), "id").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity))).alias("start"), "id", "n")
    sizes = sizes.select(F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("int").alias("length"), "id", "start")
    sizes = sizes.join(F.broadcast(table), "length").groupBy("length", F.pmod(F.xxhash64("id", "start"), "salts").alias("salt")).agg(F.count("*").alias("c"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "salt", "ahead")
    inner = Window.partitionBy("length", "salt").orderBy("id", "start")
    ranked = join_checked(salted.withColumn("k", F.row_number().over(inner) - 1), ahead, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("ahead"))
    shared = spark.sparkContext.broadcast(places)  # rows: the plan's patterns, bounded by the lengths there are

    def place(batches):
        p = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for w in np.unique(length).tolist():
                mine = length == w
                if w == capacity:
                    seq[mine] = p.bins + rank[mine]
                else:
                    seq[mine], offset[mine] = p.find(w, rank[mine])
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(offset), batch.column("id"), batch.column("start"), batch.column("length"), batch.column("part")], names=["sequence", "offset", "id", "start", "length", "part"])

    schema = T.StructType([
        T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("id", items.schema["id"].dataType),
        T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("part", items.schema["tokens"].dataType),
    ])
    placed = ranked.select("id", "start", "length", "part", "rank").mapInArrow(place, schema)
    # a group is one sequence: at most `capacity` tokens
    filled = placed.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("offset", F.col("id").alias(id_col), "start", "length", "part"))).alias("p"))
    return filled.select(
        "sequence", F.flatten(F.transform("p", lambda x: x["part"])).alias("input_ids"), F.aggregate("p", F.lit(0), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.transform("p", lambda x: F.struct(x[id_col].alias(id_col), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("items"),
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(sequences, tokens, fill, least_sequences): how full the sequences are, beside the bound ceil(tokens / capacity)."""
    t = packed.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"))
    return t.withColumn("fill", F.col("tokens") / F.greatest(F.col("sequences") * capacity, F.lit(1))).withColumn("least_sequences", F.ceil(F.col("tokens") / capacity))
