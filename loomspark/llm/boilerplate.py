"""Main body or page furniture, line by line.

Flat text blocks (lines) are described by shallow features of their own and of their neighbours: word
count, density of link-like text, cue words, the distance to running text. A forest of small decision
trees, the first grown on the whole labelled table and the rest on resamples of it, classifies them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .blocks import batch_features
from .boilerplate_labels import pages
from .textstats import is_junk
from .tree import Forest

_model: list[Forest] = []


def classifier() -> Forest:
    """The forest of the labelled table; grown once a process, in a fraction of a second."""
    if not _model:
        marked = pages()
        numbers, x = batch_features([lines for lines, _ in marked])
        y = [labels[k] for n, (_, labels) in zip(numbers, marked) for k in n.tolist()]
        _model.append(Forest(25, 9, 2).fit(x, np.array(y)))
    return _model[0]


def furniture_of(texts: list[str | None], keep_junk: bool = True) -> list[tuple[list[str], list[int], np.ndarray]]:
    """For each text its lines, the numbers of those with visible signs and which of these are furniture.

    All lines of the batch are described and classified at once, long ones as any others.
    A text that is junk throughout has no furniture (keep_junk).
    """
    split = [t.split("\n") if t else [] for t in texts]
    found, x = batch_features(split)
    flag = classifier().predict(x) > 0.5 if len(x) else np.zeros(0, bool)
    out, at = [], 0
    for lines, numbers in zip(split, found):
        mine = flag[at : at + len(numbers)]
        at += len(numbers)
        numbers = numbers.tolist()
        if keep_junk and mine.any() and is_junk([lines[k] for k in numbers]):
            mine = np.zeros(len(numbers), bool)
        out.append((lines, numbers, mine))
    return out


def _parts(texts: list, lines: int = 60_000):
    """Parts of a batch with so many characters' worth of lines that features stay small in memory."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") // 30 + 1
        if size >= lines:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def furniture_lines(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, line_no) of each line with visible signs that is page furniture; lines count from 0, parted by \\n.

    Null, empty and blank texts and texts that are junk throughout give none. Rows that repeat give their
    lines again; a null id is kept. One narrow pass: no shuffle, two columns read.
    """
    ship(df.sparkSession)
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for a, b in _parts(texts):
                where, line = [], []
                for k, (_, numbers, flag) in enumerate(furniture_of(texts[a:b])):
                    hit = [n for n, f in zip(numbers, flag.tolist()) if f]
                    where += [a + k] * len(hit)
                    line += hit
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), pa.array(line, pa.int32())], names=["id", "line_no"])

    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("line_no", T.IntegerType())])
    return picked.mapInArrow(run, schema).select(F.col("id").alias(id_col), "line_no")


def main_text(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, main): each text without its furniture lines; null stays null, and other lines keep their order and form."""
    ship(df.sparkSession)
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for a, b in _parts(texts):
                kept = []
                for text, (lines, numbers, flag) in zip(texts[a:b], furniture_of(texts[a:b])):
                    drop = {n for n, f in zip(numbers, flag.tolist()) if f}
                    kept.append(None if text is None else "\n".join([x for k, x in enumerate(lines) if k not in drop]))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(kept, pa.string())], names=["id", "main"])

    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("main", T.StringType())])
    return picked.mapInArrow(run, schema).select(F.col("id").alias(id_col), "main")
