"""Capping records per dominant contributor.

The allowed count comes from water-filling over the contributors' counts, sorted; the kept records are found
by narrowing histograms, so that a contributor with a third of all rows is never sorted or gathered in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import join_checked, materialize, ship


def water_fill(top: list[int], total: int, share: float | str | Fraction) -> int | None:
    """Largest cap c with c <= share x sum(min(count, c)), all other contributors being below it; None if nothing needs a cap.

    `top` holds the largest counts, at least ceil(1 / share) of them if there are so many. The level is raised from
    the largest contributor down: with the k largest at level c and the rest whole, c = share x (rest + k c).
    """
    s = Fraction(str(share)) if not isinstance(share, Fraction) else share
    counts = sorted(top, reverse=True)
    if not counts or s >= 1 or counts[0] <= s * total:
        return None
    rest, k = total, 0
    level = Fraction(0)
    while k < len(counts):
        rest -= counts[k]
        k += 1
        if 1 - s * k <= 0:
            return 1  # so many large contributors cannot all stay below the share: as few rows as can be
        level = s * rest / (1 - s * k)
        if k == len(counts) or counts[k] <= level:
            break
    return max(1, int(level))


def kth_table(rows: DataFrame, wanted: DataFrame, buckets: int = 256) -> DataFrame:
    """(g, last, below): for each group of wanted (g, k) the k-th smallest value (k from 1) of rows (g, v), and how many are smaller.

    Each pass counts the rows of at most `buckets` equal intervals a group, by partial sums, and keeps the one that holds the
    k-th; the search ends when every interval has one value. State and counts are tables: neither rows nor groups come to
    the driver, and no group is sorted or gathered. Values are longs without nulls; groups with fewer than k rows are left out.
    """
    exact = "decimal(20,0)"  # differences of longs may overflow a long
    rows = rows.select("g", F.col("v").cast(exact).alias("v"))
    ends = join_checked(rows, wanted, ["g"]).groupBy("g", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    state = materialize(ends.where("n >= k").select("g", "lo", "hi", F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("below")), "narrowing")
    by_bucket = Window.partitionBy("g").orderBy("b")  # at most `buckets` rows a group
    while not state.where("lo < hi").isEmpty():
        open_ = materialize(state.where("lo < hi").withColumn("width", F.ceil((F.col("hi") - F.col("lo") + 1) / buckets).cast(exact)), "narrowing")
        inside = join_checked(rows, open_, ["g"]).where(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("g", "lo", "hi", "k", "below", "width", F.expr("(v - lo) div width").cast(exact).alias("b")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(by_bucket))
        hit = counts.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        start = (F.col("lo") + F.col("b") * F.col("width")).cast(exact)
        end = F.least(F.col("hi"), (start + F.col("width") - 1).cast(exact))
        before = F.col("upto") - F.col("n")
        narrowed = hit.select("g", start.alias("lo"), end.cast(exact).alias("hi"), (F.col("k") - before).alias("k"), (F.col("below") + before).alias("below"))
        state = materialize(state.where("lo = hi").select("g", "lo", "hi", "k", "below").unionByName(narrowed), "narrowing")
    return state.select("g", F.col("lo").cast("long").alias("last"), "below")


def kth_smallest(df: DataFrame, group: str, value: str, wanted: dict, buckets: int = 256) -> dict:
    """kth_table for a few groups named by the caller, as a dict."""
    ks = df.sparkSession.createDataFrame(list(wanted.items()), "g string, k long")
    return {r["g"]: r["last"] for r in kth_table(df.select(F.col(group).alias("g"), F.col(value).alias("v")), ks, buckets).collect()}


def cap_contributors(
    df: DataFrame, contributor: Column, quality: Column, id_col: str, max_count: int | None = None, max_share: float | None = None, of_input: float | None = None, levels: tuple[int, int] = (0, 5)
) -> DataFrame:
    """df with a column `kept`: each contributor keeps at most a count of its rows, those of best quality, then of smallest id.

    The cap is the smallest of max_count, the count that of_input x all rows gives (rounded down, at least 1), and
    the water level of max_share (no contributor above that share of what is kept). Quality is a whole number within
    `levels`; null and others rank behind all. Equal ids of one quality are kept by a hash of the row, of rows equal in all
    columns as many as the count allows. Ids that are no numbers are ranked by their hash. Rows without a
    contributor are always kept. A null id ranks last in its quality. An empty table stays empty.
    """
    spark = df.sparkSession
    ship(spark)
    lo, hi = levels
    kept_cols = df.columns
    kind = df.schema[id_col].dataType
    number = F.col(id_col).cast("long") if isinstance(kind, T.NumericType) else F.when(F.col(id_col).isNotNull(), F.coalesce(F.expr(f"try_cast(cast(`{id_col}` as string) as long)"), F.xxhash64(id_col)))
    q = quality.cast("long")
    rank_level = F.when(q.between(lo, hi), hi - q).otherwise(F.lit(hi - lo + 1))
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in kept_cols]).alias("row"), contributor.cast("string").alias("who"), rank_level.alias("level"), F.coalesce(number, F.lit(2**63 - 1)).alias("id"))
    narrow = base.select("who", "level", "id")
    counts = narrow.where("who is not null").groupBy("who", "level").agg(F.count("*").alias("n"))
    counts = materialize(counts, "contributors")
    per = counts.groupBy("who").agg(F.sum("n").alias("n"))
    caps = [max_count] if max_count is not None else []
    if of_input is not None:
        rows = df.count()
        caps.append(max(1, int(Fraction(str(of_input)) * rows)))
    if max_share is not None:
        top = [r["n"] for r in per.orderBy(F.desc("n")).limit(int(1 / Fraction(str(max_share))) + 2).collect()]
        nobody = narrow.where("who is null").count()
        level = water_fill(top, nobody + (per.agg(F.sum("n")).first()[0] or 0), max_share)
        caps += [level] if level is not None else []
    if not caps:
        return df.withColumn("kept", F.lit(True))
    cap = min(caps)
    over = materialize(per.where(F.col("n") > cap).select("who"), "capped")
    # the level at which a contributor's cap falls, and how many rows of that level stay
    levels_of = counts.join(over, "who", "left_semi").groupBy("who").agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("l"))  # at most the number of levels
    before = F.aggregate("l", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("left")), lambda a, x: F.when(
        a["at"] >= 0, a).when(a["sum"] + x["n"] > cap, F.struct(a["sum"].alias("sum"), x["level"].alias("at"), (F.lit(cap) - a["sum"]).alias("left"))).otherwise(
        F.struct((a["sum"] + x["n"]).alias("sum"), a["at"].alias("at"), a["left"].alias("left"))))
    edge = materialize(levels_of.select("who", before.alias("b")).select("who", F.col("b.at").alias("edge"), F.col("b.left").alias("room")), "edges")
    # the id at which the cap falls inside that level; ids that repeat there are told apart by a hash of the row, equal rows by a number
    at_edge = join_checked(narrow, edge, ["who"]).where("level = edge and room > 0")
    last = kth_table(at_edge.select(F.col("who").alias("g"), F.col("id").alias("v")), edge.where("room > 0").select(F.col("who").alias("g"), F.col("room").alias("k")))
    edge = materialize(edge.join(last.withColumnRenamed("g", "who"), "who", "left"), "limits")
    placed = join_checked(base, edge, ["who"], "left")
    at_last = (F.col("level") == F.col("edge")) & (F.col("room") > 0) & (F.col("id") == F.col("last"))
    same = placed.where(at_last).groupBy("who").agg(F.count("*").alias("equal"), (F.max("room") - F.max("below")).alias("left"))
    torn = materialize(same.where(F.col("equal") > F.col("left")).select("who", "left"), "torn")
    sure = F.col("edge").isNull() | (F.col("level") < F.col("edge")) | ((F.col("level") == F.col("edge")) & (F.col("room") > 0) & (F.col("id") <= F.col("last")))
    if torn.isEmpty():
        return placed.select("row.*", sure.alias("kept"))
    placed = join_checked(placed, torn, ["who"], "left").withColumn("tie", F.coalesce(at_last & F.col("left").isNotNull(), F.lit(False)))
    tied = materialize(placed.where("tie").select("row", "who", "left", F.xxhash64("row").alias("h"), F.monotonically_increasing_id().alias("m")), "tied")
    for value in ("h", "m"):
        wanted = tied.groupBy(F.col("who").alias("g")).agg(F.max("left").alias("k")) if value == "h" else alike
        found = kth_table(tied.select(F.col("who").alias("g"), F.col(value).alias("v")) if value == "h" else same_hash, wanted)
        cut = materialize(found.select(F.col("g").alias("who"), F.col("last").alias(f"last_{value}"), F.col("below").alias(f"below_{value}")), "cut")
        tied = join_checked(tied, cut, ["who"], "left")
        if value == "h":
            at_hash = tied.where(F.col("h") == F.col("last_h"))
            same_hash = at_hash.select(F.col("who").alias("g"), F.col("m").alias("v"))
            alike = materialize(at_hash.groupBy(F.col("who").alias("g")).agg((F.max("left") - F.max("below_h")).alias("k")), "alike")
    kept = (F.col("h") < F.col("last_h")) | ((F.col("h") == F.col("last_h")) & (F.col("m") <= F.col("last_m")))
    rest = placed.where("not tie").select("row.*", sure.alias("kept"))
    return rest.unionByName(tied.select("row.*", kept.alias("kept")))
