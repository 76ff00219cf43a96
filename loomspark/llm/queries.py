"""Queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..runtime import join_checked, materialize, read
from .boilerplate import furniture_lines
from .bpe import encode_corpus
from .budget import cube, deltas, documents_of, token_table
from .capping import cap_contributors
from .leakage import find_leaks
from .mixing import Mix
from .packing import fill_report, pack
from .repeated import repeated_lines, without_repeated_lines
from .sentences import split_sentences
from .textstats import common_vocabulary, text_statistics

MIX_CONFIG = "toile_fr"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "vesper_edu_fr").select("row_id", "url", "pedagogy")
    kept = cap_contributors(pages, site_of(F.col("url")), F.col("pedagogy"), "row_id", of_input=0.02)
    return kept.where("not kept").select("row_id")


def p1_balanced(spark: SparkSession, d: str) -> DataFrame:
    """No site above 2 % of what is kept (not of the input): the water level."""
    pages = read(spark, d, "vesper_edu_fr").select("row_id", "url", "pedagogy")
    return cap_contributors(pages, site_of(F.col("url")), F.col("pedagogy"), "row_id", max_share=0.02).select("row_id", "kept")


def _source_of(spark: SparkSession, d: str, v: DataFrame, path: str, name: str) -> DataFrame:
    """v with `source_name`: path#name of the mix, marked if the mix does not list it."""
    known = read(spark, d, "sources").select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.lit(True).alias("_known")).distinct()
    v = join_checked(v, known, v[path].eqNullSafe(F.col("_p")) & v[name].eqNullSafe(F.col("_n")), "left")
    source = F.concat_ws("#", F.coalesce(path, F.lit("?")), name)
    return v.withColumn("source_name", F.when(F.col("_known"), source).otherwise(F.concat(F.lit("unlisted:"), source))).drop("_p", "_n", "_known")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    v = _source_of(spark, d, read(spark, d, "vesper_edu_fr"), "path", "name")
    return documents_of(v, "row_id", F.col("source_name"), F.col("lang"), site_of(F.col("url")))


def _pages_as_annotated(spark: SparkSession, d: str) -> DataFrame:
    """An older state of the pages: those that were annotated, with the texts they had then, and rows that came twice."""
    seen = read(spark, d, "annotation").select(F.col("doc_id").alias("row_id"), F.col("text").alias("seen"))
    v = read(spark, d, "vesper_edu_fr").select("row_id", "path", "name", "lang", "url").join(seen, "row_id")
    return documents_of(_source_of(spark, d, v, "path", "name"), "row_id", F.col("source_name"), F.col("lang"), site_of(F.col("url")), "seen")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    v = _source_of(spark, d, read(spark, d, "documents"), "source", "config")
    return documents_of(v, "doc_id", F.col("source_name"), F.col("lang"), F.lower(F.col("site")))


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the pages, brought from the state in which some were annotated to that of today, then those of the documents.

    Contents counted for the older state are not encoded again, nor are the documents' that the pages have; rows of the older
    state that are gone or have another text today are taken out by negative signs.
    """
    old, new, docs = _pages_as_annotated(spark, d), _pages(spark, d), _documents(spark, d)
    table = materialize(token_table(old), "tokens-then")
    before = cube(deltas(old), table)
    table = materialize(token_table(new, table), "tokens-now")
    pages = cube(deltas(new, old), table, before)
    table = materialize(token_table(docs, table), "tokens-all")
    both = cube(deltas(docs), table)
    return pages.select(F.lit("vesper_edu_fr").alias("corpus"), "*").unionByName(both.select(F.lit("documents").alias("corpus"), "*"))


def p2_document_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, language and site, and how many contents they have."""
    docs = _documents(spark, d)
    return docs.groupBy("source", "lang", "site").agg(F.count("*").alias("docs"), F.countDistinct("content").alias("contents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    words = common_vocabulary(read(spark, d, "common_words"))
    stats = text_statistics(read(spark, d, "vesper_edu_fr").select("row_id", "text"), words, body_only=True)
    return stats.where(F.col("kind").isin("list", "table", "junk")).select("row_id")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    words = common_vocabulary(read(spark, d, "common_words"))
    return text_statistics(read(spark, d, "vesper_edu_fr").select("row_id", "text"), words)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture_lines(read(spark, d, "vesper_edu_fr").select("row_id", "text"))


def _capacity(spark: SparkSession, d: str, config: str) -> int:
    return read(spark, d, "data_config").where(F.col("config_name") == config).agg(F.max("seq_len")).first()[0]


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(read(spark, d, "streaming_sample").select("sample_id", "input_ids"), _capacity(spark, d, MIX_CONFIG))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for config in ("toile_fr", "raison_fr", "petit"):
        c = _capacity(spark, d, config)
        part = fill_report(pack(read(spark, d, "streaming_sample").select("sample_id", "input_ids"), c), c).select(F.lit(config).alias("config_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(read(spark, d, "vesper_edu_fr").select("row_id", "text", "url")).select("row_id", "line_no")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "vesper_edu_fr").select("row_id", "text", "url")
    return without_repeated_lines(pages, repeated_lines(pages, near=0.8))


def _mix(spark: SparkSession, d: str, total: str | None = "all") -> Mix:
    """The documents, as much as they have once over: small sources are repeated up to their cap, the others fill up by their weights."""
    docs = read(spark, d, "documents").select("doc_id", "source", "config", F.length("text").alias("size"))
    return Mix(docs, read(spark, d, "sources"), F.col("source"), F.col("config"), F.col("size"), "doc_id", total=total)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).quota_table().withColumns({"target_share": F.round("target_share", 9), "quota": F.round("quota", 3)})


def p7_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source has its share exactly; the scarcest source bounds it."""
    return _mix(spark, d, None).shares()


def p7_stream(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).stream()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "eval_items").select("item_id", "question")
    return find_leaks(docs, items).select("doc_id", "item_id")


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Also documents that hold four fifths of a question in any order."""
    docs, items = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "eval_items").select("item_id", "question")
    return find_leaks(docs, items, coverage=0.8)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(read(spark, d, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_balanced, p2_token_budget, p2_document_counts, p3_found, p3_statistics, p4_found, p5_packed, p5_fill, p6_found, p6_cleaned,
        p7_mixture, p7_shares, p7_quotas, p7_exact_shares, p7_stream, p8_ids, p9_found, p9_coverage, p10_found,
    )
    return {f.__name__: f for f in found}


_LANG = """CASE WHEN length(trim(lang)) = 0 THEN NULL ELSE coalesce(CASE regexp_extract(lower(trim(lang)), '^([a-z]+)', 1) WHEN 'fra' THEN 'fr' WHEN 'fre' THEN 'fr' WHEN 'eng' THEN 'en' WHEN 'deu' THEN 'de' WHEN 'ger' THEN 'de'
 WHEN 'spa' THEN 'es' WHEN 'ita' THEN 'it' WHEN 'por' THEN 'pt' WHEN 'rus' THEN 'ru' WHEN 'zho' THEN 'zh' WHEN 'jpn' THEN 'ja' WHEN 'ara' THEN 'ar' WHEN 'hin' THEN 'hi' WHEN 'ell' THEN 'el' WHEN 'tha' THEN 'th' WHEN 'nld' THEN 'nl' END,
 nullif(regexp_extract(lower(trim(lang)), '^([a-z]+)', 1), ''), lower(trim(lang))) END"""
_COUNTS = f"""SELECT CASE WHEN k THEN s ELSE 'unlisted:' || s END AS source, lang, site, count(*) AS docs, count(DISTINCT content) AS contents FROM
 (SELECT concat_ws('#', coalesce(d.source, '?'), d.config) AS s, EXISTS (SELECT 1 FROM sources o WHERE o.path IS NOT DISTINCT FROM d.source AND o.name IS NOT DISTINCT FROM d.config) AS k,
 {_LANG} AS lang, lower(site) AS site, md5(coalesce(text, '')) AS content FROM documents d) GROUP BY 1, 2, 3"""
_QUOTAS = """WITH s AS (SELECT path, name, max(CASE WHEN weight::VARCHAR = 'nan' THEN 0 ELSE greatest(coalesce(weight, 0), 0) END) AS weight, max(greatest(coalesce(max_repeats, 1), 0)) AS max_repeats FROM sources WHERE path IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT source, config, sum(length(text))::BIGINT AS n FROM documents WHERE length(text) > 0 GROUP BY 1, 2),
 a AS (SELECT s.*, coalesce(d.n, 0) AS available FROM s LEFT JOIN d ON s.path IS NOT DISTINCT FROM d.source AND s.name IS NOT DISTINCT FROM d.config),
 u AS (SELECT *, max_repeats * available::DOUBLE AS most, max_repeats * available / weight AS ratio, sum(weight) OVER () AS whole, sum(available) OVER () AS total FROM a WHERE weight > 0 AND available > 0),
 k AS (SELECT *, (total - coalesce(sum(most) OVER w, 0)) / (whole - coalesce(sum(weight) OVER w, 0)) AS level FROM u WINDOW w AS (ORDER BY ratio, path, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT min(level) AS level FROM (SELECT level FROM k WHERE level < ratio ORDER BY ratio, path, name LIMIT 1))
 SELECT a.path, a.name, a.weight, a.max_repeats, a.available, round(coalesce(u.weight / u.whole, 0), 9) AS target_share, round(coalesce(least(u.most, coalesce(l.level * u.weight, u.most)), 0), 3) AS quota
 FROM a CROSS JOIN l LEFT JOIN u ON a.path = u.path AND a.name IS NOT DISTINCT FROM u.name"""


def oracle_sql() -> dict[str, str]:
    """Problems whose result SQL can state over whole tables. The others are tested by brute force in tests/llm."""
    return {"p2_document_counts": _COUNTS, "p7_quotas": _QUOTAS}
