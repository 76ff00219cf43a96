"""Statistics of a text that tell running prose from lists, tables and junk.

A text's counts are a monoid: a chunk of a text gives the counts of the lines it holds whole, plus an open
first and an open last line, and `merge` closes the line (and the word) that the cut went through. Texts longer
than a chunk are cut, counted chunk by chunk and merged by a tree; of huge ones the parts are counted by tasks of
their own, and the tree goes on over tasks. An open line may be as long as its text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .sentences import FUNCTION_WORDS

#: Characters of a chunk. Cuts fall anywhere; results do not depend on it.
CHUNK = 8_192
#: Characters of the parts of a huge text that go to tasks of their own.
SPREAD = 1_000_000

_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_MARK = re.compile(r"^\s*(?:[-–—*•◦▪·]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))\s+\S")
_CELLS = re.compile(r"\t|;|\s?\|\s?|,(?=[^\s,])|(?<=\S) {3,}(?=\S)")
_BETWEEN = re.compile(r"\s[•·|/]\s|;\s|\s-\s")
_URL = re.compile(r"(?:https?:|www\.)\S+")
_ENDINGS, _CLOSING = frozenset(".!?…:;。！？।؟"), "»\"”’)] \t\r\u00a0\u202f"
_PARTS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_MOJIBAKE = re.compile("[ÃÂ][\x80-\xbf-\x9f§©ª«®¢¨»]|â€|Ã|ï¿½|�")
_SHAPE = [(re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"\s+"), " ")]
_BEYOND_LATIN = re.compile("[Ͱ-\u1dff\u2c00-\ud7ff]")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿ก-๿]")

#: Frequent words of further languages in Latin script, by which their prose is told from made-up words.
FURTHER_WORDS = frozenset(
    "il di che non per una sono della delle alla gli nel con os das uma em por para mais como het een van dat niet zijn met voor "
    "nie się na jest że do jak po och att som det är på inte med og ikke til af på den ja ei että on mutta hän "
    "és az hogy nem egy a să și nu este cu pe la în je že se na být jako v i li da bir ve bu için ile de da "
    "els amb per què són không là của và một có que hoc est et in non ad cum".split()
)

_FUNCTION = FURTHER_WORDS.union(*FUNCTION_WORDS.values())

LIST, TABLE, JUNK, PROSE, SHORT = range(5)
#: A text is a repetition of a few words if it has fewer distinct ones than this (and many words each). Words beyond
#: that number are not remembered, since they cannot change the answer.
DISTINCT = 60
#: Sums that a text's counts hold, in this order; then a Counter of shapes and one of words.
SUMS = ("lines", "words", "letters", "chars", "symbols", "digits", "stops", "common", "c_list", "c_table", "c_junk", "c_prose", "c_short", "n_short", "function", "latin")


@lru_cache(4)
def _with_function_words(vocabulary: frozenset[str]) -> frozenset[str]:
    return vocabulary | _FUNCTION


def line_shape(line: str) -> str:
    text = line[:70].strip()
    for p, s in _SHAPE:
        text = p.sub(s, text)
    return text[:10]


def line_kind(line: str, words: list[str], common: int, beyond: bool = True, broken: bool = True) -> int:
    """What a line looks like by itself; beyond, broken: whether its text has signs beyond Latin script, or of a wrong encoding.

    Every line goes through all tests. Counts that only bound what a pattern can find are taken first, and the pattern
    is run where the bound does not settle the test.
    """
    n, size = len(words), len(line)
    if beyond and _SPACELESS.search(line):
        return PROSE if size >= 12 else SHORT
    if broken and len(_MOJIBAKE.findall(line)) * 12 > size:
        return JUNK
    letters = sum(map(len, words))
    ink = size - line.count(" ") - line.count("\t")
    if size > 8 and letters * 10 < ink * 3 and (letters + len(_DIGIT.findall(line))) * 10 < ink * 3:
        return JUNK
    semicolons, bars = line.count(";"), line.count("|")
    if common * 5 <= n and (semicolons + bars + line.count("\t") + line.count(",") - line.count(", ") >= 2 or "   " in line):
        cells = len(_CELLS.findall(line))
        if cells >= 2 and (n + line.count(".") + 2) <= 7 * (cells + 1):
            return TABLE
    if letters * 10 < ink * 5 and size > 8 and not _MARK.match(line):
        return JUNK
    if ink > 35:
        longest = max(map(len, line.split()))
        if longest > 35 and longest * 2 > ink:
            return JUNK
    if n < 12 and ("://" in line or "www." in line) and _URL.match(line.strip()):
        return JUNK
    if n <= 16 and _MARK.match(line):
        return LIST
    if semicolons + bars + line.count("•") + line.count("·") + line.count("/") + line.count(" - ") >= 4:
        between = len(_BETWEEN.findall(line))
        if between >= 4 and n <= 7 * (between + 1):
            return LIST
    if n <= 3:
        return SHORT
    return PROSE


def count_lines(lines: list[str], vocabulary: frozenset[str]) -> tuple[list[float], Counter, set[str]]:
    """Counts of whole lines: the sums SUMS, shapes of short lines (lines, characters, kind's characters), distinct words while below DISTINCT."""
    s = [0] * len(SUMS)
    shapes: Counter = Counter()
    vocab: set[str] = set()
    further = _with_function_words(vocabulary)
    probe = "\n".join(lines)
    beyond = not probe.isascii() and _BEYOND_LATIN.search(probe) is not None
    hidden = not probe.isascii() and _HIDDEN.search(probe) is not None
    broken = any([sign in probe for sign in ("Ã", "Â", "â€", "ï¿½", "\ufffd")])
    for line in lines:
        if not line or line.isspace():
            continue
        if hidden:
            line = _HIDDEN.sub("", line)
        low = _PARTS.findall(line.lower())
        common = sum(map(vocabulary.__contains__, low))
        s[14] += common if common * 4 > len(low) else sum(map(further.__contains__, low))
        s[15] += len(low) if not (beyond and _BEYOND_LATIN.search(line)) else 0
        kind = line_kind(line, low, common, beyond, broken)
        letters = sum(map(len, low))
        digits = len(_DIGIT.findall(line)) if beyond else sum(map(line.count, "0123456789"))
        line = line.strip()
        size = len(line)
        s[0] += 1
        s[1] += len(low)
        s[2] += letters
        s[3] += size
        s[4] += max(0, size - letters - digits - line.count(" "))
        s[5] += digits
        s[6] += line.rstrip(_CLOSING)[-1:] in _ENDINGS
        s[7] += common
        s[8 + kind] += size
        s[13] += kind == SHORT
        if len(low) <= 14:
            form = line_shape(line)
            if form.strip("a ") or kind == SHORT:
                shapes[form, "n"] += 1
                shapes[form, kind] += size
        if len(vocab) < DISTINCT:
            vocab.update(low)
    return s, shapes, vocab


def verdict(s: list[float], shapes: Counter, distinct: int) -> dict:
    """Ratios and the rules' outcome of a text's counts."""
    sums = dict(zip(SUMS, s))
    prose, junk, table, items, short = (float(sums[k]) for k in ("c_prose", "c_junk", "c_table", "c_list", "c_short"))
    for (form, what), n in shapes.items():  # lines of one make, four or more, are a list
        if what in (PROSE, SHORT) and shapes[form, "n"] >= 4 and form.strip("a "):
            items += n
            if what == PROSE:
                prose -= n
            else:
                short -= n
    words, common = sums["words"], sums["common"]
    if words >= 30 and distinct * 20 < words * 3 and common * 10 < words and distinct < DISTINCT:
        junk, prose, items, short = junk + prose + items + short, 0.0, 0.0, 0.0
    least = 0.22 if not sums["stops"] and words >= 40 else 0.15
    if sums["latin"] >= 20 and sums["latin"] * 2 > words and sums["function"] < least * sums["latin"]:
        junk, prose = junk + prose, 0.0  # no language has so few of its little words: strings of keywords, invented words
    if sums["n_short"] >= 5 and short > items + table + junk and (prose == 0 or sums["n_short"] >= 8 and short > prose):
        items, short = items + short, 0.0
    n = max(words, 1)
    kinds = {"list": items, "table": table, "junk": junk, "prose": prose}
    is_prose = prose >= items + table + junk
    return {
        "n_lines": int(sums["lines"]), "n_words": int(words), "n_chars": int(sums["chars"]),
        "mean_word_length": sums["letters"] / n, "symbol_ratio": sums["symbols"] / max(sums["chars"], 1), "digit_ratio": sums["digits"] / max(sums["chars"], 1),
        "stop_share": sums["stops"] / max(sums["lines"], 1), "common_share": common / n, "prose_share": prose / max(sum(kinds.values()), 1),
        "kind": ("empty" if not sums["lines"] else "prose" if is_prose else max(("list", "table", "junk"), key=lambda k: kinds[k])),
    }


def is_junk(lines: list[str]) -> bool:
    """Whether four lines in five of a page, wherever they stand, are something no reader could read, or it repeats under 20 words.

    The look ends early only once the lines left cannot change the answer.
    """
    may_be = len(lines) // 5  # lines of other kinds that still leave four in five
    others = 0
    for line in lines:
        others += line_kind(line, _PARTS.findall(line), 0) != JUNK
        if others > may_be:
            break
    else:
        return True
    words, distinct = 0, set()
    for line in sorted(lines, key=len, reverse=True):
        low = _PARTS.findall(line.lower())
        words += len(low)
        distinct.update(low)
        if len(distinct) >= 20:
            return False
    return words >= 30 and len(distinct) * 20 < words * 3


class State:
    """The counts of a chunk: closed lines, and the open lines at its two ends (None: no line break inside)."""

    __slots__ = ("head", "sums", "shapes", "words", "tail")

    def __init__(self, text: str, vocabulary: frozenset[str], cut: bool = True):
        parts = text.split("\n")
        self.head, self.tail = (parts[0], parts[-1] if len(parts) > 1 else None) if cut else ("", "")
        self.sums, self.shapes, self.words = count_lines(parts[1:-1] if cut else parts, vocabulary)

    def row(self) -> dict:
        return {
            "head": self.head, "tail": self.tail, "sums": [float(x) for x in self.sums], "shape": [f"{k[0]}\x00{k[1]}" for k in self.shapes],
            "shape_n": [int(x) for x in self.shapes.values()], "word": list(self.words),
        }

    @classmethod
    def load(cls, r: dict) -> State:
        me = cls.__new__(cls)
        me.head, me.tail, me.sums = r["head"], r["tail"], list(r["sums"])
        keys = [k.split("\x00") for k in r["shape"]]
        me.shapes = Counter({(a, b if b == "n" else int(b)): n for (a, b), n in zip(keys, r["shape_n"])})
        me.words = set(r["word"])
        return me

    def _add(self, line: str, vocabulary: frozenset[str]) -> None:
        s, shapes, words = count_lines([line], vocabulary)
        self.sums = [a + b for a, b in zip(self.sums, s)]
        self.shapes.update(shapes)
        self.words.update(words)

    def merge(self, other: State, vocabulary: frozenset[str]) -> State:
        """This chunk followed by the other: the line the cut went through is joined, then closed if both ends are known."""
        if self.tail is None:
            joined, keep = self.head + other.head, True
        else:
            joined, keep = self.tail + other.head, False
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.shapes.update(other.shapes)
        self.words.update(other.words)
        if keep:
            self.head, self.tail = joined, other.tail
        elif other.tail is None:
            self.tail = joined
        else:
            self._add(joined, vocabulary)
            self.tail = other.tail
        return self

    def close(self, vocabulary: frozenset[str]) -> State:
        for line in (self.head, self.tail):
            if line:
                self._add(line, vocabulary)
        self.head, self.tail = "", ""
        return self


def counted(text: str, vocabulary: frozenset[str], chunk: int) -> State:
    """The open state of a text: its chunks' states, neighbours merged pair by pair until one is left."""
    states = [State(text[i : i + chunk], vocabulary) for i in range(0, max(len(text), 1), chunk)]
    while len(states) > 1:
        states = [states[i].merge(states[i + 1], vocabulary) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


OUT = T.StructType([
    T.StructField("n_lines", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("mean_word_length", T.DoubleType()), T.StructField("symbol_ratio", T.DoubleType()), T.StructField("digit_ratio", T.DoubleType()),
    T.StructField("stop_share", T.DoubleType()), T.StructField("common_share", T.DoubleType()), T.StructField("prose_share", T.DoubleType()), T.StructField("kind", T.StringType()),
])
_STATE = T.StructType([
    T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("sums", T.ArrayType(T.DoubleType())),
    T.StructField("shape", T.ArrayType(T.StringType())), T.StructField("shape_n", T.ArrayType(T.LongType())),
    T.StructField("word", T.ArrayType(T.StringType())),
])


def common_vocabulary(words: DataFrame, word_col: str = "word", limit: int = 10_000) -> frozenset[str]:
    """The frequent words of all languages in one set, without accents as well; at most `limit` rows are accepted."""
    rows = words.select(F.lower(F.col(word_col).cast("string")).alias("w")).where("w is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the list of common words has more than {limit} rows")
    found = {p for r in rows for p in re.split("['’]", r.w) if p}
    return frozenset(found | {"".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in found})


def text_statistics(
    df: DataFrame, vocabulary: frozenset[str], id_col: str = "row_id", text_col: str = "text", chunk: int = CHUNK, body_only: bool = False, spread: int = SPREAD
) -> DataFrame:
    """(id, measures, kind) of each row; kind is prose, list, table, junk or empty.

    Null, empty and blank texts have zero counts and kind `empty`. Rows that repeat give equal rows; a null id
    is kept. With body_only the page furniture is taken away first. Texts are counted by chunks of `chunk` characters;
    those of up to `spread` characters where they lie, of longer ones the parts of `spread` characters travel to tasks of
    their own and the states of the parts are merged by groups of 32, then all.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # at most the limit of common_vocabulary
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_field = T.StructField("id", picked.schema["id"].dataType)
    names = [f.name for f in OUT]

    def count(lines: list[str], v: frozenset[str]) -> dict:
        if sum(map(len, lines)) + len(lines) - 1 <= chunk:
            s, shapes, words = count_lines(lines, v)
        else:
            state = counted("\n".join(lines), v, chunk).close(v)
            s, shapes, words = state.sums, state.shapes, state.words
        return verdict(s, shapes, len(words))

    def whole(batches):
        from .boilerplate import _parts, furniture_of

        v = shared.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for a, b in _parts(texts):
                if body_only:
                    pages = [[lines[k] for k, f in zip(numbers, flag.tolist()) if not f] for lines, numbers, flag in furniture_of(texts[a:b])]
                else:
                    pages = [(t or "").split("\n") for t in texts[a:b]]
                found = [count(p, v) for p in pages]
                columns = [pa.array([f[n] for f in found]) for n in names]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], names=["id", *names])

    out_schema = T.StructType([id_field, *OUT.fields])
    short = picked.where(F.coalesce(F.length("text"), F.lit(0)) <= spread).mapInArrow(whole, out_schema)

    long = picked.where(F.length("text") > spread)
    if body_only:
        from .boilerplate import main_text

        long = main_text(long, "id", "text").withColumnRenamed("main", "text")

    def cut(batches):
        for batch in batches:
            for row, (text, code) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hash").to_pylist())):
                ids = batch.column("id").slice(row, 1)
                for k, start in enumerate(range(0, max(len(text), 1), spread)):
                    yield pa.RecordBatch.from_arrays([ids, pa.array([code]), pa.array([k], pa.int64()), pa.array([text[start : start + spread]])], names=["id", "hash", "k", "part"])

    keys = [id_field, T.StructField("hash", T.LongType()), T.StructField("k", T.LongType())]
    pieces = long.withColumn("hash", F.xxhash64("text")).mapInArrow(cut, T.StructType([*keys, T.StructField("part", T.StringType())])).repartition("hash", "k")

    def states(batches):
        v = shared.value
        for batch in batches:
            found = [counted(t, v, chunk).row() for t in batch.column("part").to_pylist()]
            columns = [pa.array([s[f.name] for s in found], _arrow(f.dataType)) for f in _STATE]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "hash", "k")] + [pa.array([1] * len(found), pa.int64()), *columns], names=["id", "hash", "k", "copies", *_STATE.names])

    keys.append(T.StructField("copies", T.LongType()))
    parts = pieces.mapInArrow(states, T.StructType([*keys, *_STATE.fields]))

    def fold(last: bool):
        def run(table: pa.Table) -> pa.Table:
            v = shared.value
            rows = sorted(table.to_pylist(), key=lambda r: r["k"])
            copies = sum(r["copies"] for r in rows if r["k"] == rows[0]["k"])  # rows that repeat have equal parts
            state = State.load(rows[0])
            for before, r in zip(rows, rows[1:]):
                if r["k"] != before["k"]:
                    state.merge(State.load(r), v)
            key = {c: rows[0][c] for c in ("id", "hash", "k")} | {"copies": copies}
            if last:
                state.close(v)
                return pa.Table.from_pylist([{"id": key["id"], **verdict(state.sums, state.shapes, len(state.words))}] * copies, schema=_arrow_schema(out_schema))
            return pa.Table.from_pylist([key | state.row()], schema=_arrow_schema(T.StructType([*keys, *_STATE.fields])))

        return run

    some = parts.groupBy("id", "hash", F.expr("k div 32")).applyInArrow(fold(False), parts.schema)
    merged = some.groupBy("id", "hash").applyInArrow(fold(True), out_schema)
    return short.unionByName(merged).withColumnRenamed("id", id_col)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _arrow_schema(t: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in t])
