"""Evaluation texts leaking into training texts, found by greedy string tiling.

Words of the items get small numbers; a document's words are numbered by the same table, which leaves the
runs that share nothing with any item. Shared runs of SEED words (Karp-Rabin codes, rolled over the whole
document at once) are the seeds that join documents to items. For each joined pair the longest common runs
are marked, longest first and never twice (greedy string tiling); the tiles give the exact runs, the
coverage of the item in whatever order its parts stand. The test for changed words starts at every common run
long enough to be the longest of a passage, marked or not, and goes forwards and backwards from it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import join_checked, materialize, ship

#: Words of a seed. A passage of 24 words with one change in ten keeps a run of at least seven.
SEED = 5
_BASE = np.uint64(1_000_003)
_WORDS = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, accents, encoding variants, entities and invisible signs."""
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "&" in text and _ENTITY.search(text):
        text = _HIDDEN.sub("", html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join([c for c in text if not unicodedata.combining(c)]) if not text.isascii() else text
    return _WORDS.findall(text.casefold())


_MARKS = re.compile("[\u0300-\u036f]+")


def fast_words(text: str | None) -> list[str]:
    """words(), by tables: the same result for texts whose combining signs are those of Latin, Greek and Cyrillic."""
    if not text or text.isascii() and "&" not in text:
        return _WORDS.findall(text.casefold()) if text else []
    text = _HIDDEN.sub("", text)
    if "&" in text and _ENTITY.search(text):
        text = _HIDDEN.sub("", html.unescape(text))
    decomposed = unicodedata.normalize("NFKD", text)
    plain = _MARKS.sub("", decomposed)
    if not plain.isascii() and any(unicodedata.combining(c) for c in set(plain)):
        plain = "".join([c for c in plain if not unicodedata.combining(c)])
    return _WORDS.findall(plain.casefold())


class Items:
    """A block of items, numbered and indexed by their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.ids = [r[0] for r in rows]
        hashes, owner = [], []
        for k, (_, question) in enumerate(rows):
            code = np.array([self.number.setdefault(w, len(self.number) + 1) for w in fast_words(question)], dtype=np.int64)
            self.codes.append(code)
            h, ok = self.roll(code)
            hashes.append(h[ok])
            owner.append(np.full(int(ok.sum()), k))
        flat, own = np.concatenate([*hashes, np.empty(0, np.uint64)]), np.concatenate([*owner, np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.hash, self.owner = flat[order], own[order]

    @staticmethod
    def roll(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin codes of all runs of SEED words, and which of them have no foreign word."""
        n = len(code) - SEED + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(SEED):
            part = code[i : i + n]
            h = h * _BASE + part.astype(np.uint64)
            ok &= part > 0
        return h, ok

    def candidates(self, codes: np.ndarray) -> dict[int, int]:
        """Items that share a seed, with the number of shared seeds."""
        h, ok = self.roll(codes)
        h = np.unique(h[ok])
        if not len(h) or not len(self.hash):
            return {}
        a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        found: dict[int, int] = defaultdict(int)
        for x, y in zip(a.tolist(), b.tolist()):
            for k in self.owner[x:y].tolist():
                found[k] += 1
        return found


def common_runs(q: np.ndarray, d: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """All maximal common runs of `least` words or more: (length, place in q, place in d), overlapping ones too."""
    at: dict[tuple, list[int]] = defaultdict(list)
    where = np.flatnonzero(np.isin(d, q))
    dl, ql = d.tolist(), q.tolist()
    inside = set(where.tolist())
    for j in where.tolist():
        if j + least <= len(dl) and all(j + i in inside for i in range(least)):
            at[tuple(dl[j : j + least])].append(j)
    matches = []
    for i in range(len(ql) - least + 1):
        for j in at.get(tuple(ql[i : i + least]), ()):
            if i and j and ql[i - 1] == dl[j - 1]:
                continue  # not the start of its run
            n = least
            while i + n < len(ql) and j + n < len(dl) and ql[i + n] == dl[j + n]:
                n += 1
            matches.append((n, i, j))
    return matches


def tiles(q: np.ndarray, d: np.ndarray, least: int = 3, matches: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in q, place in d, length), longest first, no word of either in two tiles."""
    matches = common_runs(q, d, least) if matches is None else matches
    out, used_q, used_d = [], np.zeros(len(q), bool), np.zeros(len(d), bool)
    heap = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
    while heap:
        n, i, j = heap.pop(0)
        free = ~(used_q[i : i + n] | used_d[j : j + n])
        if free.all():
            out.append((i, j, n))
            used_q[i : i + n] = used_d[j : j + n] = True
            continue
        rest, k = [], 0
        while k < n:  # what is left of a run that earlier tiles cut
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= least:
                    rest.append((e - k, i + k, j + k))
                k = e
            else:
                k += 1
        if rest:
            heap = sorted(heap + rest, key=lambda m: (-m[0], m[1], m[2]))
    return out


def _reach(ql: list[int], dl: list[int], i0: int, j0: int, most: int) -> list[int]:
    """Words of q that can be followed from (i0, j0) with 0, 1, ... most edits, edits at the very end included."""
    nq, nd = len(ql), len(dl)
    reach, out = {0: i0}, []
    for _ in range(most + 1):
        ahead: dict[int, int] = {}
        furthest = i0
        for k, i in reach.items():
            j = j0 + (i - i0) + k
            while i < nq and 0 <= j < nd and ql[i] == dl[j]:
                i += 1
                j += 1
            furthest = max(furthest, i)
            for kk, ii in ((k, i + 1), (k - 1, i + 1), (k + 1, i)):  # changed, dropped, added
                if ii <= nq and ii > ahead.get(kk, -1):
                    ahead[kk] = ii
        out.append(furthest - i0)
        reach = ahead
    return out


def longest_left(least: int, per: int, longest: int) -> int:
    """Words of the longest run that any passage of `least` words or more, of at most `longest`, keeps: n - e words in e + 1 runs."""
    return max(1, min(-(-(n - n // per) // (n // per + 1)) for n in range(least, max(least, longest) + 1)))


def near_passage(q: np.ndarray, d: np.ndarray, starts: list[tuple[int, int]], least: int = 24, per: int = 10) -> bool:
    """Whether some passage of q of at least `least` words stands in d with at most one edit in `per` words.

    From each start (a place where both agree, in the passage sought) the furthest ends with 0, 1, 2 ... edits are
    followed forwards and backwards, diagonal by diagonal; edits at the passage's own ends are allowed for as well.
    """
    ql, dl = q.tolist(), d.tolist()
    nq, nd = len(ql), len(dl)
    if nq < least:
        return False
    most = nq // per
    ql_back, dl_back = ql[::-1], dl[::-1]
    for i, j in starts:
        ahead, back = _reach(ql, dl, i, j, most), _reach(ql_back, dl_back, nq - i, nd - j, most)
        for e in range(most + 1):
            if max(ahead[x] + back[e - x] for x in range(e + 1)) >= max(least, e * per):
                return True
    return False


def seeds_needed(run: int, least: int, per: int, longest: int) -> int:
    """Seeds of an item that any leak keeps: run - SEED + 1 of an exact run; of n words with e edits in e + 1 runs, n - e - (SEED - 1)(e + 1)."""
    near = [n - e - (SEED - 1) * (e + 1) for n in range(least, max(least, longest) + 1) for e in range(n // per + 1)]
    return max(1, min([run - SEED + 1, *near]))


def compare(q: np.ndarray, d: np.ndarray, run: int = 12, least: int = 24, per: int = 10) -> tuple[int, float, bool]:
    """(longest common run, share of q in tiles of SEED words or more, whether d leaks q)."""
    keep = longest_left(least, per, len(q))
    matches = common_runs(q, d, min(3, keep))
    found = tiles(q, d, matches=[m for m in matches if m[0] >= 3])
    longest = max((n for _, _, n in found), default=0)
    coverage = sum(n for _, _, n in found if n >= SEED) / len(q) if len(q) else 0.0
    leak = longest >= run or near_passage(q, d, sorted((i, j) for n, i, j in matches if n >= keep), least, per)
    return longest, coverage, leak


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", question_col: str = "question",
    run: int = 12, least: int = 24, per: int = 10, coverage: float | None = None, block: int = 5_000,
) -> DataFrame:
    """(doc_id, item_id, longest_run, coverage) of each document that leaks an item.

    A leak is a run of `run` words of the question, or `least` words with at most one in `per` changed,
    dropped or added, or (if given) tiles that cover the share `coverage` of the question in any order.
    Up to `block` items are sent to the tasks, and the documents read once. More are joined by their seeds instead: hashes of
    five-word runs of both sides are shuffled, copies of a document once, and the pairs that share as many as any leak
    keeps are compared. Both ways give the same rows. Null and empty texts or questions leak nothing; rows that repeat
    (same ids) give one row; null ids are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col(doc_id).alias("d"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("i"), F.col(question_col).cast("string").alias("q")).where("q is not null").distinct()
    schema = T.StructType([
        T.StructField("d", picked.schema["d"].dataType), T.StructField("i", asked.schema["i"].dataType),
        T.StructField("longest_run", T.IntegerType()), T.StructField("coverage", T.DoubleType()),
    ])

    def searcher(shared):
        held: dict = {}

        def search(batches):
            if "x" not in held:
                held["x"] = Items(shared.value)
                need = seeds_needed(run, least, per, max(map(len, held["x"].codes), default=0))
                held["need"] = need if coverage is None else 1
            x, need = held["x"], held["need"]
            get, codes = x.number.get, x.codes
            for batch in batches:
                ids, keep = batch.column("d"), ([], [], [], [])
                for row, text in enumerate(batch.column("text").to_pylist()):
                    if not text:
                        continue
                    code = np.array([get(w, 0) for w in fast_words(text)], dtype=np.int64)
                    for k, seeds in x.candidates(code).items():
                        if seeds < need:
                            continue
                        longest, share, leak = compare(codes[k], code, run, least, per)
                        if leak or coverage is not None and share >= coverage:
                            for col, v in zip(keep, (row, x.ids[k], longest, share)):
                                col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep[0], pa.int64())), pa.array(keep[1], _arrow_type(schema["i"].dataType)), pa.array(keep[2], pa.int32()), pa.array(keep[3], pa.float64())],
                    names=["d", "i", "longest_run", "coverage"],
                )

        return search

    asked = materialize(asked, "items")
    if asked.count() <= block:
        out = picked.mapInArrow(searcher(spark.sparkContext.broadcast([(r["i"], r["q"]) for r in asked.collect()])), schema)
    else:
        need = seeds_needed(run, least, per, 10 * least) if coverage is None else 1  # longer items keep more seeds, not fewer
        out = _by_seeds(picked, asked, schema, need, lambda q, d: compare(q, d, run, least, per), coverage)
    return out.groupBy("d", "i").agg(F.max("longest_run").alias("longest_run"), F.max("coverage").alias("coverage")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "longest_run", "coverage")


def _seeds(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): the distinct codes of a text's runs of SEED words, from hashes of the words."""

    def find(batches):
        number: dict[str, int] = {}
        for batch in batches:
            keys, codes = [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                if len(number) > 500_000:
                    number.clear()
                ws = fast_words(t)
                for w in ws:
                    if w not in number:
                        number[w] = xxhash.xxh3_64_intdigest(w) >> 1 | 1
                h = np.unique(Items.roll(np.array([number[w] for w in ws], dtype=np.int64))[0])
                keys += [k] * len(h)
                codes.append(h.view(np.int64))
            flat = np.concatenate([*codes, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(flat)], names=["key", "h"])

    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", picked.schema["key"].dataType), T.StructField("h", T.LongType())])
    return picked.mapInArrow(find, schema).withColumnRenamed("key", key).distinct()


def _by_seeds(picked: DataFrame, asked: DataFrame, schema: T.StructType, need: int, judge, coverage: float | None) -> DataFrame:
    """Rows of schema for all leaks, by a join of documents' and items' seeds; the items stay in a table."""
    numbered = materialize(asked.withColumn("k", F.monotonically_increasing_id()), "items")
    texts = picked.where("text <> ''").withColumn("c", F.md5("text"))
    shared = _seeds(texts, "c", "text").join(_seeds(numbered, "k", "q"), "h").groupBy("c", "k").agg(F.count("*").alias("seeds"))
    pairs = materialize(shared.where(F.col("seeds") >= need).select("c", "k"), "pairs")
    asked_of = join_checked(texts, pairs, ["c"])
    both = asked_of.join(numbered, "k").select("d", "text", "i", "q")

    def run(batches):
        for batch in batches:
            keep = ([], [], [])
            for row, (text, q) in enumerate(zip(batch.column("text").to_pylist(), batch.column("q").to_pylist())):
                number: dict[str, int] = {}
                asked_codes = np.array([number.setdefault(w, len(number) + 1) for w in fast_words(q)], dtype=np.int64)
                longest, share, leak = judge(asked_codes, np.array([number.get(w, 0) for w in fast_words(text)], dtype=np.int64))
                if leak or coverage is not None and share >= coverage:
                    for col, v in zip(keep, (row, longest, share)):
                        col.append(v)
            take = pa.array(keep[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("i").take(take), pa.array(keep[1], pa.int32()), pa.array(keep[2], pa.float64())], names=["d", "i", "longest_run", "coverage"])

    return both.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
