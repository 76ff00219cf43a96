"""Quality classifiers by dimension, and functions that call out of Spark."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prepare
from ..runtime import materialize, ship
from .sampling import shuffle_key


def train_dimension(df: DataFrame, text: Column, score: Column, least_score: int = 3, least_rows: int = 100, features: int = 1 << 14):
    """A linear model over words and pairs of words for score >= least_score; None with fewer than least_rows rows or one class.

    The rows are those with a score from 0 to 5; the caller bounds them.
    """
    rows = df.select(prepare(text).alias("t"), score.alias("s")).where("s between 0 and 5 and t <> ''").select("t", (F.col("s") >= least_score).cast("double").alias("label"))
    rows = materialize(rows, "labelled")
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if n["n"] < least_rows or n["k"] < 2:
        return None
    stages = [
        RegexTokenizer(inputCol="t", outputCol="w", pattern=" ", toLowercase=True), NGram(n=2, inputCol="w", outputCol="w2"),
        HashingTF(inputCol="w", outputCol="f1", numFeatures=features), HashingTF(inputCol="w2", outputCol="f2", numFeatures=features),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"), LogisticRegression(maxIter=10, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict_dimension(model, df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with `name`: the probability of the high class, rounded to 4 places."""
    scored = model.transform(df.withColumn("t", prepare(text)))
    return scored.withColumn(name, F.round(vector_to_array("probability")[1], 4)).drop("t", "w", "w2", "f1", "f2", "features", "rawPrediction", "probability", "prediction")


def split_rows(df: DataFrame, key: str, ratio: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(train, held out) by a hash of the key."""
    u = F.conv(F.substring(shuffle_key(F.col(key), "split"), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.where(u >= ratio), df.where(u < ratio)


def call_out(df: DataFrame, key: str, text: str, answer: Callable[[str], str | None], threads: int = 16) -> DataFrame:
    """(key, reply): answer() of each text, by a thread pool in each task; an error gives null, the order stays."""
    ship(df.sparkSession)

    def safe(t: str) -> str | None:
        try:
            return answer(t)
        except Exception:
            return None

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pd.DataFrame({key: pdf[key], "reply": list(pool.map(safe, pdf[text]))})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, reply string")


def translated(df: DataFrame, key: str, text: str, translate: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """(key, text): texts through a translator with their formulas kept aside and put back."""
    from ..functions.text import protect_spans_udf, restore_spans

    ship(df.sparkSession)
    held = df.select(key, protect_spans_udf()(F.col(text)).alias("p")).select(key, F.col("p.text").alias("t"), F.col("p.spans").alias("spans"))
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), batch):
                part = [t or "" for t in pdf["t"].iloc[i : i + batch]]
                out += translate(part)
            yield pd.DataFrame({key: pdf[key], "t": out, "spans": pdf["spans"]})

    done = held.mapInPandas(run, f"`{key}` {kind}, t string, spans array<string>")
    return done.select(key, restore_spans(F.col("t"), F.col("spans")).alias("text"))
