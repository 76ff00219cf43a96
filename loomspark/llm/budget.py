"""Token budget per source, language and site.

Tokens are counted once per content: a table (content hash, tokenizer hash, tokens) remembers what was encoded.
A new state of the corpus is compared with the old one by document and content; only contents that the table
lacks are encoded, and the cubes change by signed deltas, minus for documents that went or changed.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, ship, small
from .bpe import _groups, default_vocabulary, encoder

DIMENSIONS = ("source", "lang", "site")


def tokenizer_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.md5(f.read()).hexdigest()


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def count_contents(texts: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(content, tokenizer, tokens) of a DataFrame (content, text): the length of each text's encoding."""
    ship(texts.sparkSession)
    path = vocabulary or default_vocabulary()
    name = tokenizer_hash(path)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for a, b in _groups(rows):
                parted = [enc.split(t) if t else [] for t in rows[a:b]]
                ids = enc.known(parted)
                size = {w: len(ids[w]) for w in set(chain.from_iterable(parted))}
                n = [sum([size[w] for w in p]) for p in parted]
                yield pa.RecordBatch.from_arrays([batch.column("content").slice(a, b - a), pa.array([name] * (b - a)), pa.array(n, pa.int64())], names=["content", "tokenizer", "tokens"])

    schema = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("tokens", T.LongType())])
    return texts.select("content", "text").mapInArrow(run, schema)


def token_table(docs: DataFrame, known: DataFrame | None = None, vocabulary: str | None = None) -> DataFrame:
    """The count table of all contents of docs (id, content, text): known rows of this tokenizer, and the others encoded once each.

    Of each content that is not known one document is picked by partial minima of hashed ids, so hashes are shuffled and a
    content that is a third of all rows costs one row a task. The picked texts are found by a broadcast if they are few, else
    by a shuffled join on content and pick, which no content makes uneven.
    """
    path = vocabulary or default_vocabulary()
    pick = F.xxhash64("id") if "id" in docs.columns else F.lit(0).cast("long")  # without ids all copies are picked
    picked = docs.groupBy("content").agg(F.min(pick).alias("pick"))
    mine = None
    if known is not None:
        mine = known.where(F.col("tokenizer") == tokenizer_hash(path)).select("content", "tokenizer", "tokens")
        picked = picked.join(mine.select("content"), "content", "left_anti")
    picked = materialize(picked, "unseen")
    side = F.broadcast(picked) if small(picked) else picked.hint("shuffle_hash")
    texts = docs.select("content", pick.alias("pick"), "text").join(side, ["content", "pick"])
    new = count_contents(texts, path).dropDuplicates(["content", "tokenizer"])  # documents of one id and content
    return new if mine is None else mine.unionByName(new)


def deltas(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Rows (id, content, DIMENSIONS, sign): +1 for documents that came, -1 for those that went; a change is both.

    Documents are compared as bags of (id, content, dimensions), so that repeated rows count each.
    """
    cols = ["id", "content", *DIMENSIONS]
    plus = new.select(*cols, F.lit(1).cast("long").alias("sign"))
    if old is None:
        return plus
    both = plus.unionByName(old.select(*cols, F.lit(-1).cast("long").alias("sign")))
    return both.groupBy(*cols).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def cube(changes: DataFrame, table: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(source, lang, site, level, docs, tokens): totals of the grouping sets all, by each dimension, and by all three.

    `level` names the dimensions a row is grouped by, so that a null in one (unknown) differs from "not grouped by".
    The finest totals are built first, from partial sums, and the others from them; `before` is added.
    """
    few = changes.groupBy("content", *DIMENSIONS).agg(F.sum("sign").alias("sign")).where("sign <> 0")  # copies are summed before the join
    sized = few.join(table.select("content", "tokens"), "content")
    fine = sized.groupBy(*DIMENSIONS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    if before is not None:
        fine = fine.unionByName(before.where("level = 'source,lang,site'").select(*DIMENSIONS, "docs", "tokens"))
        fine = fine.groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
    fine = materialize(fine, "cube")
    out = None
    for level in ((), ("source",), ("lang",), ("site",), ("source", "lang"), DIMENSIONS):
        part = fine.groupBy(*level).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")) if level != DIMENSIONS else fine
        row = [F.col(d) if d in level else F.lit(None).cast("string").alias(d) for d in DIMENSIONS]
        part = part.select(*row, F.lit(",".join(level) or "all").alias("level"), F.coalesce(F.col("docs"), F.lit(0)).alias("docs"), F.coalesce(F.col("tokens"), F.lit(0)).alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


def language_code(lang: Column) -> Column:
    """Two-letter code of fr, FR, fr-FR, fra_Latn, fra and the like; others in small letters as they are; blank as null."""
    three = F.create_map(*[F.lit(x) for pair in (("fra", "fr"), ("fre", "fr"), ("eng", "en"), ("deu", "de"), ("ger", "de"), ("spa", "es"), ("ita", "it"), ("por", "pt"), ("rus", "ru"), ("zho", "zh"), ("jpn", "ja"), ("ara", "ar"), ("hin", "hi"), ("ell", "el"), ("tha", "th"), ("nld", "nl")) for x in pair])
    head = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1)
    return F.when(F.length(F.trim(lang)) == 0, F.lit(None)).otherwise(F.coalesce(F.try_element_at(three, head), F.nullif(head, F.lit("")), F.lower(F.trim(lang))))


def documents_of(df: DataFrame, id_col: str, source: Column, lang: Column, site: Column, text_col: str = "text") -> DataFrame:
    """(id, content, text, source, lang, site) for the functions above; null texts count as empty."""
    return df.select(
        F.col(id_col).alias("id"), content_hash(F.col(text_col)).alias("content"), F.col(text_col).alias("text"),
        source.cast("string").alias("source"), language_code(lang).alias("lang"), site.cast("string").alias("site"),
    )
