"""Deduplication in source order and near-duplicate joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, normalized_prefix, text_hash
from ..runtime import materialize


def _first(df: DataFrame, key: Column | str, order: str, carry: list[str]) -> DataFrame:
    """The first row by order of each key: a minimum with partial aggregation, so a key with a third of all rows costs no more."""
    best = F.min(F.struct(order, *carry)).alias("m")
    return df.groupBy(key if isinstance(key, Column) else F.col(key)).agg(best).select("m.*")


def dedup_levels(df: DataFrame, order: str, text: str = "text", url: Column | None = None, fuzzy_chars: int | None = 1000) -> DataFrame:
    """(order, level) of every row of df, level being exact, url or fuzzy where the row is dropped and kept otherwise.

    Rows are dropped as in one pass in order: first by equal text, then, among what is left, by equal url (empty urls
    all pass), then by equal normalised prefix. Orders are unique; null texts count as empty.
    """
    base = df.select(order, text_hash(F.col(text)).alias("h"), F.coalesce(url if url is not None else F.lit(""), F.lit("")).alias("u"), F.md5(normalized_prefix(F.col(text), fuzzy_chars or 1)).alias("p"))
    one = _first(base, "h", order, ["u", "p"])
    two = one if url is None else _first(one.where("u <> ''"), "u", order, ["p"]).unionByName(one.where("u = ''").select(order, "p"))
    three = two if fuzzy_chars is None else _first(two, "p", order, [])
    marks = [one.select(order, F.lit(1).alias("l1")), two.select(order, F.lit(1).alias("l2")), three.select(order, F.lit(1).alias("l3"))]
    out = df.select(order)
    for m in marks:
        out = out.join(m, order, "left")
    return out.select(order, F.when(F.col("l1").isNull(), "exact").when(F.col("l2").isNull(), "url").when(F.col("l3").isNull(), "fuzzy").otherwise("kept").alias("level"))


def dedup(df: DataFrame, order: str, text: str = "text", url: Column | None = None, fuzzy_chars: int | None = 1000) -> DataFrame:
    """The kept order values alone: three aggregations of hashes, no text is shuffled."""
    base = df.select(order, text_hash(F.col(text)).alias("h"), F.coalesce(url if url is not None else F.lit(""), F.lit("")).alias("u"), F.md5(normalized_prefix(F.col(text), fuzzy_chars or 1)).alias("p"))
    kept = _first(base, "h", order, ["u", "p"])
    if url is not None:
        kept = _first(kept.where("u <> ''"), "u", order, ["p"]).unionByName(kept.where("u = ''").select(order, "p"))
    if fuzzy_chars is not None:
        kept = _first(kept, "p", order, [])
    return kept.select(order)


def _gram_sets(df: DataFrame, id_col: str, text: str, n: int, first: int | None) -> DataFrame:
    """(id, g, k): the sorted 64-bit hashes of a text's n-grams and the hash of the set, for texts with n-grams."""
    grams = ngrams(F.col(text), n, first)
    hashed = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.transform(grams, lambda x: F.xxhash64(x)))).alias("g"))
    return hashed.where(F.size("g") > 0).withColumn("k", F.md5(F.array_join("g", ",")))


def gram_classes(df: DataFrame, id_col: str, text: str = "text", n: int = 5, first: int | None = None) -> DataFrame:
    """(id, class): the smallest id among the texts with the same set of n-grams; texts without n-grams have none."""
    sets = _gram_sets(df, id_col, text, n, first).select("id", "k")
    least = sets.groupBy("k").agg(F.min("id").alias("class"))
    return sets.join(least, "k").select(F.col("id").alias(id_col), "class")


def near_pairs(df: DataFrame, id_col: str, text: str = "text", n: int = 5, first: int | None = None, least: float = 0.5, equal: bool = False) -> DataFrame:
    """(a, b, members_a, members_b, shared, jaccard): pairs of different texts whose n-gram sets are more than `least` alike (or as much, with `equal`).

    Texts of one n-gram set are a class, stood for by its smallest id and counted as members, so that copies make no
    pairs (gram_classes tells who is in a class). Grams are 64-bit hashes. Two sets that alike share a gram among the rarest of
    each (prefix filter), by which they are joined, and what the places of that gram leave possible must reach the similarity
    (position filter); grams of one set alone join nothing. No pair is lost.
    """
    sets = _gram_sets(df, id_col, text, n, first)
    classes = sets.groupBy("k").agg(F.min(F.struct("id", "g")).alias("m"), F.count("*").alias("members")).select("m.id", "m.g", "members")
    classes = materialize(classes, "gram-sets")
    single = classes.select("id", F.size("g").alias("size"), F.explode("g").alias("gram"))
    rarity = single.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = single.join(rarity, "gram").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("o"))  # one text's grams
    keep = F.col("size") - F.ceil(F.col("size") * least).cast("int") + 1
    prefix = ordered.select("id", "size", F.posexplode(F.slice("o", F.lit(1), F.least(keep, F.col("size"))))).where("col.df > 1")
    prefix = materialize(prefix.select("id", "size", "pos", F.col("col.gram").alias("gram")), "prefixes")
    a = prefix.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a"), "gram")
    b = prefix.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"), "gram")
    near_size = (F.col("size_a") >= F.col("size_b") * least) & (F.col("size_b") >= F.col("size_a") * least)
    # counted from the rarest shared gram on: at most this many grams are shared; the filter holds for that gram, so one row of the pair passes
    possible = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    enough = possible * (1 + least) >= (F.col("size_a") + F.col("size_b")) * least - 1e-9
    candidates = a.join(b, "gram").where((F.col("a") < F.col("b")) & near_size & enough).select("a", "b").distinct()
    left = classes.select(F.col("id").alias("a"), F.col("g").alias("ga"), F.col("members").alias("members_a"))
    right = classes.select(F.col("id").alias("b"), F.col("g").alias("gb"), F.col("members").alias("members_b"))
    shared = F.size(F.array_intersect("ga", "gb"))
    sized = candidates.join(left, "a").join(right, "b").withColumn("shared", shared)
    j = F.col("shared") / (F.size("ga") + F.size("gb") - F.col("shared"))
    return sized.withColumn("jaccard", j).where(F.col("jaccard") >= least if equal else F.col("jaccard") > least).select("a", "b", "members_a", "members_b", "shared", "jaccard")
