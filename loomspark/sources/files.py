"""Tolerant scans and sinks: JSON lines, text, parquet, token files, metric logs, source specs."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE


def scan_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Columns of schema, raw (the line as it is) and bad: blank lines are left out, lines that are no JSON object are bad."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw")
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    line = raw.select("raw", F.regexp_replace("raw", f"^{SPACE}+|{SPACE}+$", "").alias("line")).where("line <> ''")
    parsed = line.withColumn("j", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | ~F.col("line").startswith("{")
    return parsed.select("raw", bad.alias("bad"), *[F.when(~bad, F.col(f"j.`{f.name}`")).alias(f.name) for f in kind.fields])


def scan_txt(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, stripped, blank ones left out."""
    return spark.read.text(path).select(F.regexp_replace("value", f"^{SPACE}+|{SPACE}+$", "").alias("text")).where("text <> ''")


def scan_texts(df: DataFrame, field: str) -> DataFrame:
    """The filled texts of one field; the reader fetches that column alone."""
    return df.select(F.col(field).alias("text")).where(F.coalesce(F.col("text"), F.lit("")) != "")


def scan_metrics(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """A log with a header; each numeric column as double, with the text beside it where it is none."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(c) for c in df.columns if c not in numeric], *[x for c in numeric if c in df.columns for x in (F.expr(f"try_cast(`{c}` as double)").alias(c), F.when(F.expr(f"try_cast(`{c}` as double)").isNull(), F.col(c)).alias(f"{c}_text"))])


def scan_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(path, ids) of token files: the type named by the .dtype or .bin.meta.json beside each, else uint16."""
    metas = {}
    for r in spark.read.text([p for p in (f"{path}/*.dtype", f"{path}/*.meta.json") if _exists(spark, p)] or [], wholetext=True).select(F.input_file_name().alias("p"), "value").collect() if any(_exists(spark, p) for p in (f"{path}/*.dtype", f"{path}/*.meta.json")) else []:
        base = re.sub(r"\.bin(\.dtype|\.meta\.json)$|\.dtype$", "", r["p"].split("/")[-1])
        metas[base] = json.loads(r["value"])["dtype"] if r["p"].endswith(".json") else r["value"].strip()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            names = pdf["path"].map(lambda p: p.split("/")[-1].removesuffix(".bin"))
            yield pd.DataFrame({"path": pdf["path"], "ids": [np.frombuffer(b, dtype=metas.get(n, "uint16")).astype("int64").tolist() for n, b in zip(names, pdf["content"])]})

    return spark.read.format("binaryFile").load(f"{path}/*.bin").select("path", "content").mapInPandas(run, "path string, ids array<bigint>")


def _exists(spark: SparkSession, glob: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def write_tokens(df: DataFrame, order: str, ids: str, path: str, vocabulary: int) -> dict:
    """Write the arrays in order as one token file with both sidecars; rows pass through the driver one at a time."""
    kind = "uint16" if vocabulary <= 65535 else "uint32"
    target, n = Path(path), 0
    with target.open("wb") as f:
        for r in df.orderBy(order).select(ids).toLocalIterator():
            a = np.asarray(r[0] or [], dtype=kind)
            a.tofile(f)
            n += len(a)
    meta = {"version": 1, "vocab_size": vocabulary, "dtype": kind, "n_tokens": n}
    target.with_suffix(".dtype").write_text(kind)
    target.with_name(target.name + ".meta.json").write_text(json.dumps(meta))
    return meta


def read_token_meta(path: str) -> dict:
    """The sidecar of a token file; without one version 0, uint16, no vocabulary."""
    side = Path(path + ".meta.json")
    return json.loads(side.read_text()) if side.exists() else {"version": 0, "dtype": "uint16", "vocab_size": None}


def write_token_table(df: DataFrame, key: str, ids: str, path: str, vocabulary: int) -> None:
    """Token arrays as little-endian bytes, one record a row, written by the tasks; the type follows from the vocabulary and stands in the sidecar."""
    kind = "uint16" if vocabulary <= 65535 else "uint32"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = [None if x is None else np.asarray(x, dtype="<u2" if kind == "uint16" else "<u4").tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], names=["key", "tokens"])

    picked = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField("key", picked.schema["key"].dataType), T.StructField("tokens", T.BinaryType())])
    picked.mapInArrow(run, schema).write.parquet(f"{path}/tokens")
    n = df.agg(F.sum(F.coalesce(F.size(ids), F.lit(0)))).first()[0] or 0
    meta = json.dumps({"version": 1, "vocab_size": vocabulary, "dtype": kind, "n_tokens": int(n)})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def scan_token_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, ids) of what write_token_table wrote."""
    kind = json.loads(spark.read.text(f"{path}/meta").first()[0])["dtype"]
    table = spark.read.parquet(f"{path}/tokens")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [None if x is None else np.frombuffer(x, dtype="<u2" if kind == "uint16" else "<u4").astype("int64") for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int64()))], names=["key", "ids"])

    schema = T.StructType([T.StructField("key", table.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))])
    return table.mapInArrow(run, schema).select(F.col("key").alias(key), "ids")


def write_raw(df: DataFrame, path: str, raw: str = "raw") -> None:
    """Lines as they came in, without parsing them again."""
    df.select(F.col(raw).alias("value")).write.text(path)


def append_metrics(df: DataFrame, path: str, step: str, resume: int | None = None) -> None:
    """Add a run's rows to a log, each run a folder of its own; with `resume` rows of earlier runs after that step no longer count."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_run=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    run = 0 if found is None else len(found)
    kept = df if resume is None else df.where(F.col(step) > resume)
    kept.withColumn("_resume", F.lit(resume).cast("long")).write.parquet(f"{path}/_run={run}")


def read_metrics(spark: SparkSession, path: str, step: str, schema: T.StructType) -> DataFrame:
    """The rows of a log that still count, each step of it once a run went on from an earlier one."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_resume", T.LongType()), T.StructField("_run", T.IntegerType())])).parquet(path)
    runs = rows.groupBy("_run").agg(F.max("_resume").alias("back")).collect()  # a row a run
    keep = F.lit(True)
    for r in runs:
        if r["back"] is not None:
            keep = keep & ((F.col("_run") >= r["_run"]) | (F.col(step) <= r["back"]))
    return rows.where(keep).select(*schema.names)


def dataset_card(df: DataFrame, name: str, text: str) -> DataFrame:
    """(card): a short description of a table: its rows, columns and characters."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    columns = ", ".join(df.columns)
    return size.select(F.concat(F.lit(f"# {name}\n\n- rows: "), F.col("n").cast("string"), F.lit(f"\n- columns: {columns}\n- characters: "), F.col("chars").cast("string")).alias("card"))


def tokenized(df: DataFrame, key: str, text: str, model: str, eos: int | None = None) -> DataFrame:
    """(key, ids) by a tokenizer file (tokenizers' JSON, or a sentencepiece model), each text closed by `eos` if given; null texts as empty."""
    picked = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        encode = encoder_of(model)
        for batch in batches:
            ids = encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x + [eos] if eos is not None else x for x in ids], pa.list_(pa.int64()))], names=["key", "ids"])

    schema = T.StructType([T.StructField("key", picked.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))])
    return picked.mapInArrow(run, schema).select(F.col("key").alias(key), "ids")


def model_type(path: str) -> str:
    """What a tokenizer file holds: bpe, unigram, wordpiece or wordlevel (JSON), or spm-bpe, spm-unigram, spm-word, spm-char."""
    head = open(path, "rb").read(1)
    if head == b"{":
        return json.loads(Path(path).read_text())["model"]["type"].lower()
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(Path(path).read_bytes())
    return "spm-" + pb.TrainerSpec.ModelType.Name(m.trainer_spec.model_type).lower()


def encoder_of(path: str):
    """A function from texts to lists of ids, without special tokens."""
    if not model_type(path).startswith("spm-"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: s.encode(texts, num_threads=1)


def coerce_numbers(settings: dict) -> dict:
    """Settings in which numbers written as text (1e-4, 2000) are numbers, at any depth."""
    def one(v):
        if isinstance(v, dict):
            return {k: one(x) for k, x in v.items()}
        if isinstance(v, list):
            return [one(x) for x in v]
        if isinstance(v, str) and re.fullmatch(r"[+-]?\d+", v):
            return int(v)
        if isinstance(v, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
            return float(v)
        return v

    return one(settings)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_shards(df: DataFrame, path: str, rows: int = 500_000) -> None:
    """Parquet in files of at most `rows` rows, zstd; Spark's commit protocol stands for the two-phase rename."""
    df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Texts by split, documents parted by a blank line."""
    df.select("split", F.concat(F.col("text"), F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def keep_last(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, modificationTime, keep) of the files of a folder: the n newest are kept."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(n).select("path", F.lit(True).alias("keep"))
    return files.join(newest, "path", "left").na.fill(False, ["keep"])


def first_readable(readers: list) -> DataFrame:
    """The first source that can be opened (mirrors in order of preference)."""
    problems = []
    for make in readers:
        try:
            df = make()
            df.schema
            return df
        except Exception as e:  # the next mirror is tried
            problems.append(str(e)[:200])
    raise ValueError("no source could be read: " + "; ".join(problems))


@dataclass(frozen=True)
class SourceSpec:
    path: str
    name: str | None
    split: str
    text_field: str = "text"
    weight: float = 1.0


def parse_spec(text: str) -> SourceSpec:
    """<path>:<name>:<split>[#field][@weight], or without the name."""
    body, at, weight = text.rpartition("@") if "@" in text else (text, "", "")
    head, hash_, field = body.rpartition("#") if "#" in body else (body, "", "")
    parts = head.split(":")
    if len(parts) not in (2, 3):
        raise ValueError(f"not a source: {text!r}")
    name = parts[1] if len(parts) == 3 else None
    return SourceSpec(parts[0], name or None, parts[-1], field if hash_ else "text", float(weight) if at else 1.0)


def spec_columns(spec: Column) -> dict[str, Column]:
    """parse_spec as columns; null path where it is no source."""
    body, weight = F.regexp_replace(spec, "@[^@]*$", ""), F.nullif(F.regexp_extract(spec, "@([^@]*)$", 1), F.lit(""))
    head, field = F.regexp_replace(body, "#[^#]*$", ""), F.nullif(F.regexp_extract(body, "#([^#]*)$", 1), F.lit(""))
    parts = F.split(head, ":", -1)
    good = F.size(parts).isin(2, 3)
    return {
        "path": F.when(good, F.get(parts, F.lit(0))), "name": F.when(F.size(parts) == 3, F.nullif(F.get(parts, F.lit(1)), F.lit(""))),
        "split": F.when(good, F.get(parts, F.size(parts) - 1)), "text_field": F.coalesce(field, F.lit("text")), "weight": F.coalesce(F.try_to_number(weight, F.lit("999.999")).cast("double"), F.lit(1.0)),
    }


def union_sources(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(source, text) of several tables, each with its own text field."""
    out = None
    for source, df, field in parts:
        one = df.select(F.lit(source).alias("source"), F.col(field).alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return out


def load_settings(path: str, overrides: list[str] | None = None) -> dict:
    """Settings of a JSON or YAML file; overrides a.b=c take the type of the value they replace."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        conf = json.loads(text)
    else:
        import yaml

        conf = yaml.safe_load(text)
    for o in overrides or []:
        key, _, value = o.partition("=")
        at = conf
        *path_, last = key.split(".")
        for p in path_:
            at = at[p]
        old = at.get(last)
        at[last] = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value) if isinstance(old, (int, float)) else value
    return conf
