"""The library's queries over whole tables, each with the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions.urls import site_of
from ..operators import audit, dedup, filters, learning, sampling, series, windows
from ..operators.ordering import ranked
from ..runtime import materialize, read, scratch
from ..sources import files
from ..streaming import streams
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SCORES = ("coherence", "pedagogy", "linguistic", "depth", "factuality")
DIMS = ("coherence", "pedagogy", "linguistic", "code_quality", "depth", "factuality")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "vesper_edu_fr")


def _score(name: str) -> Column:
    c = F.col(f"score_{name}")
    return F.when(~F.isnan(c) & c.between(0, 1), c)


def _score_sql(name: str) -> str:
    # NaN by its text: range statistics of a file leave NaN out, and isnan may be folded away by them
    return f"CASE WHEN score_{name}::VARCHAR <> 'nan' AND score_{name} BETWEEN 0 AND 1 THEN score_{name} END"


def _nums() -> Column:
    return F.transform("embedding", lambda x: x.cast("double"))


# --- scans and sinks -------------------------------------------------------------------------------------------


@query("SELECT doc_id, text FROM documents WHERE coalesce(text, '') <> ''")
def scan_parquet_text(spark, d):
    return _docs(spark, d).where(F.coalesce(F.col("text"), F.lit("")) != "").select("doc_id", "text")


@query("SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'vesper_edu_fr', count(*) FROM vesper_edu_fr UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def count_rows(spark, d):
    return reduce(DataFrame.unionByName, [read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("documents", "vesper_edu_fr", "lineitem")])


@query("SELECT doc_id, text, false AS bad FROM documents")
def scan_jsonl(spark, d):
    """Written as JSON lines and read again."""
    path = scratch(spark, "jsonl")
    files.write_jsonl(_docs(spark, d).select("doc_id", "text"), path)
    return files.scan_jsonl(spark, path, "doc_id long, text string").select("doc_id", "text", "bad")


@query(f"SELECT {S.strip('l')} AS text FROM (SELECT unnest(string_split(replace(replace(question, chr(13), ' '), chr(11), ' '), chr(10))) AS l FROM eval_items) WHERE {S.strip('l')} <> ''")
def scan_txt(spark, d):
    path = scratch(spark, "txt")
    clean = F.replace(F.replace("question", F.lit("\r"), F.lit(" ")), F.lit("\x0b"), F.lit(" "))
    read(spark, d, "eval_items").select(clean.alias("q")).write.mode("overwrite").option("lineSep", "\n").text(path)
    return files.scan_txt(spark, path)


@query("SELECT event_id, try_cast(event_type AS DOUBLE) AS kind, CASE WHEN try_cast(event_type AS DOUBLE) IS NULL THEN event_type END AS kind_text FROM events")
def scan_metrics(spark, d):
    path = scratch(spark, "csv")
    read(spark, d, "events").select("event_id", F.col("event_type").alias("kind")).write.mode("overwrite").option("header", True).csv(path)
    m = files.scan_metrics(spark, path, ["kind"])
    return m.select(F.col("event_id").cast("long").alias("event_id"), "kind", "kind_text")


@query("SELECT sample_id, len(input_ids)::BIGINT AS n, array_to_string(input_ids, ',') AS ids FROM streaming_sample WHERE len(input_ids) > 0")
def scan_bin(spark, d):
    """Token arrays written as bytes of two or four each by the tasks, one record a sample, and read again."""
    path = scratch(spark, "bin")
    kept = read(spark, d, "streaming_sample").where(F.size("input_ids") > 0)
    files.write_token_table(kept, "sample_id", "input_ids", path, 50257)
    t = files.scan_token_table(spark, path, "sample_id")
    return t.select("sample_id", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("""SELECT spec, CASE WHEN n IN (2, 3) THEN p[1] END AS path, CASE WHEN n = 3 THEN nullif(p[2], '') END AS name, CASE WHEN n IN (2, 3) THEN p[n] END AS split,
 coalesce(nullif(regexp_extract(body, '#([^#]*)$', 1), ''), 'text') AS text_field, coalesce(try_cast(nullif(regexp_extract(spec, '@([^@]*)$', 1), '') AS DOUBLE), 1.0) AS weight
 FROM (SELECT *, string_split(regexp_replace(body, '#[^#]*$', ''), ':') AS p, len(string_split(regexp_replace(body, '#[^#]*$', ''), ':')) AS n FROM (SELECT spec, regexp_replace(spec, '@[^@]*$', '') AS body FROM
 (SELECT path || ':' || coalesce(name, '') || ':' || split || '#' || text_field || CASE WHEN isnan(weight) OR weight IS NULL THEN '' ELSE '@' || printf('%.1f', weight) END AS spec FROM sources)))""")
def parse_source_spec(spark, d):
    w = F.when(F.isnan("weight") | F.col("weight").isNull(), "").otherwise(F.concat(F.lit("@"), F.format_string("%.1f", F.col("weight"))))
    spec = read(spark, d, "sources").select(F.concat("path", F.lit(":"), F.coalesce("name", F.lit("")), F.lit(":"), "split", F.lit("#"), "text_field", w).alias("spec"))
    return spec.select("spec", *[c.alias(k) for k, c in files.spec_columns(F.col("spec")).items()])


@query("SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 500 AS shard, (row_number() OVER (ORDER BY row_id) - 1) % 500 AS row_in_shard FROM vesper_edu_fr")
def parquet_shard_plan(spark, d):
    return windows.shard_plan(_pages(spark, d), "row_id", 500)


@query("SELECT source, count(*) AS n, count(nullif(text, '')) AS filled FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', text FROM vesper_edu_fr UNION ALL SELECT 'items', question FROM eval_items) GROUP BY source")
def union_sources(spark, d):
    u = files.union_sources([("documents", _docs(spark, d), "text"), ("pages", _pages(spark, d), "text"), ("items", read(spark, d, "eval_items"), "question")])
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count(F.nullif("text", F.lit(""))).alias("filled"))


@query()
def source_smoke(spark, d):
    return reduce(DataFrame.unionByName, [read(spark, d, t).limit(3).select(F.lit(t).alias("source"), F.to_json(F.struct("*")).alias("row")) for t in ("documents", "vesper_edu_fr", "streaming_sample", "eval_items")])


@query("SELECT doc_id FROM documents WHERE length(text) >= 100")
def stream_scan(spark, d):
    """The length filter as a stream over the files that are there."""
    src, base = _docs(spark, d), scratch(spark, "stream")
    src.select("doc_id", "text").write.mode("overwrite").parquet(base + "-in")
    stream = streams.filtered(streams.file_stream(spark, base + "-in", src.select("doc_id", "text").schema), F.length("text") >= 100).select("doc_id")
    streams.run_once(stream, base + "-out", base + "-cp")
    return spark.read.schema(stream.schema).parquet(base + "-out")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    ev, base = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), scratch(spark, "win")
    ev.write.mode("overwrite").parquet(base + "-in")
    counts = streams.windowed_counts(streams.file_stream(spark, base + "-in", ev.schema), "ts", "event_type")
    counts = counts.withColumn("start", F.col("start").cast("timestamp_ntz"))
    streams.complete_into(counts, base + "-out", base + "-cp").awaitTermination()
    return spark.read.schema(counts.schema).parquet(base + "-out")


# --- text functions --------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string(list_slice({S.words('text')}, 1, 500), ' ') AS prepared FROM documents")
def prepare_text(spark, d):
    return _docs(spark, d).select("doc_id", X.prepare(F.col("text")).alias("prepared"))


@query(f"SELECT row_id AS id, {S.is_code('text')} AS code FROM vesper_edu_fr UNION ALL SELECT * FROM (SELECT -k AS id, {S.is_code('t')} FROM (VALUES (1, 'import a' || chr(10) || 'def f():' || chr(10) || '  return 1'), (2, 'a class of pupils' || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z'), (3, '')) v(k, t))")
def is_code(spark, d):
    extra = spark.createDataFrame([(-1, "import a\ndef f():\n  return 1"), (-2, "a class of pupils\nx\ny\nz"), (-3, "")], "id long, text string")
    return _pages(spark, d).select(F.col("row_id").alias("id"), "text").unionByName(extra).select("id", X.is_code(F.col("text")).alias("code"))


@query(f"SELECT doc_id, {S.prefix('text', 200)} AS p FROM documents")
def normalize_prefix(spark, d):
    return _docs(spark, d).select("doc_id", X.normalized_prefix(F.col("text"), 200).alias("p"))


@query(f"SELECT doc_id, md5(coalesce(text, '')) AS h, md5({S.prefix('text', 1000)}) AS p FROM documents")
def text_hashes(spark, d):
    return _docs(spark, d).select("doc_id", X.text_hash(F.col("text")).alias("h"), F.md5(X.normalized_prefix(F.col("text"))).alias("p"))


@query(f"SELECT row_id, {S.authority('url')} AS domain FROM vesper_edu_fr")
def extract_domain(spark, d):
    return _pages(spark, d).select("row_id", X.authority(F.col("url")).alias("domain"))


@query(f"SELECT row_id, {S.boiler('text')} AS score FROM vesper_edu_fr")
def boilerplate_score(spark, d):
    return _pages(spark, d).select("row_id", X.boilerplate_score(F.col("text")).alias("score"))


@query(f"SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS h FROM (SELECT doc_id, {S.grams('text')} AS g FROM documents)")
def ngram_fingerprint(spark, d):
    g = _docs(spark, d).select("doc_id", X.ngrams(F.col("text")).alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("h"))


@query(f"""SELECT row_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS j
 FROM (SELECT v.row_id, {S.grams('v.text')} AS a, {S.grams('x.text')} AS b FROM vesper_edu_fr v JOIN (SELECT doc_id, min(text) AS text FROM annotation GROUP BY doc_id) x ON x.doc_id = v.row_id)""")
def jaccard(spark, d):
    """Each annotated page against the text it was annotated with."""
    x = read(spark, d, "annotation").groupBy("doc_id").agg(F.min("text").alias("seen"))
    pairs = _pages(spark, d).join(x, F.col("row_id") == F.col("doc_id")).select("row_id", X.ngrams(F.col("text")).alias("a"), X.ngrams(F.col("seen")).alias("b"))
    return pairs.select("row_id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


_REPLY = "'Voici : {' || array_to_string(list_filter(['\"coherence\": ' || coherence, '\"pedagogy\": ' || pedagogy, '\"linguistic\": ' || linguistic, '\"depth\": ' || depth, '\"factuality\": ' || factuality || '.9'], lambda x: x IS NOT NULL), ', ') || '} merci'"


@query(f"""SELECT doc_id, n, CASE WHEN ok THEN c + p + l + e + f END AS total FROM (SELECT doc_id, n, c, p, l, e, f, coalesce(c BETWEEN 0 AND 5 AND p BETWEEN 0 AND 5 AND l BETWEEN 0 AND 5 AND e BETWEEN 0 AND 5 AND f9 BETWEEN 0 AND 5, false) AS ok
 FROM (SELECT doc_id, length({_REPLY}) AS n, coherence AS c, pedagogy AS p, linguistic AS l, depth AS e, factuality AS f, (factuality || '.9')::DOUBLE AS f9 FROM annotation))""")
def parse_scores(spark, d):
    fields = [F.concat(F.lit(f'"{k}": '), F.col(k).cast("string"), F.lit(".9" if k == "factuality" else "")) for k in ("coherence", "pedagogy", "linguistic", "depth", "factuality")]
    reply = F.concat(F.lit("Voici : {"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("} merci"))
    r = read(spark, d, "annotation").select("doc_id", reply.alias("r"))
    return r.select("doc_id", F.length("r").alias("n"), X.parse_scores(F.col("r"))["total"].alias("total"))


@query(f"SELECT row_id, array_to_string({S.dims('text')}, ',') AS dims FROM vesper_edu_fr")
def dims_for_doc(spark, d):
    return _pages(spark, d).select("row_id", F.array_join(X.dims_of(F.col("text")), ",").alias("dims"))


@query("SELECT doc_id, 'Note ce texte :' || chr(10) || CASE WHEN length(coalesce(text, '')) > 1500 THEN substring(text, 1, 1500) || '...' ELSE coalesce(text, '') END || chr(10) || 'Note :' AS prompt FROM documents")
def build_prompt(spark, d):
    return _docs(spark, d).select("doc_id", X.prompt("Note ce texte :\n{text}\nNote :", F.col("text")).alias("prompt"))


@query("SELECT doc_id, substring(text, 1, 300) AS preview, substring(text, 1, 150) AS short FROM documents")
def preview(spark, d):
    return _docs(spark, d).select("doc_id", F.substring("text", 1, 300).alias("preview"), F.substring("text", 1, 150).alias("short"))


_SPANS = r"\$\$(?s:.+?)\$\$|\$[^$\n]+\$|\\\[(?s:.+?)\\\]|\\\((?s:.+?)\\\)|\\boxed\{[^{}]*\}"


@query(f"SELECT doc_id, len(regexp_extract_all(text, {S.q(_SPANS)})) AS n, length(regexp_replace(text, {S.q(_SPANS)}, '', 'g')) AS rest FROM documents WHERE text IS NOT NULL")
def protect_math(spark, d):
    """How many formulas a text has, and its length without them and without their placeholders."""
    p = _docs(spark, d).where("text is not null").select("doc_id", X.protect_spans_udf()(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p.spans").cast("long").alias("n"), F.length(F.regexp_replace("p.text", " __MATH_[0-9]+__ ", "")).cast("long").alias("rest"))


@query(f"SELECT doc_id, regexp_replace(text, {S.q('(' + _SPANS + ')')}, ' \\1 ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def restore_math(spark, d):
    """Round trip over all texts: each formula comes back with the two blanks that its placeholder brought."""
    kept = _docs(spark, d).where("text is not null")
    p = kept.select("doc_id", X.protect_spans_udf()(F.col("text")).alias("p"))
    return p.select("doc_id", X.restore_spans(F.col("p.text"), F.col("p.spans")).alias("text"))


@query(f"SELECT doc_id, CASE WHEN h THEN {S.strip(chr(40) + 'regexp_extract(t, ' + S.q('(?s)^(.*)####(.*)$') + ', 1))')} ELSE {S.strip('t')} END AS body, CASE WHEN h THEN {S.strip(chr(40) + 'regexp_extract(t, ' + S.q('(?s)^(.*)####(.*)$') + ', 2))')} ELSE '' END AS final FROM (SELECT doc_id, coalesce(text, '') AS t, contains(coalesce(text, ''), '####') AS h FROM documents)")
def split_answer(spark, d):
    return _docs(spark, d).select("doc_id", X.split_answer(F.col("text")).alias("a")).select("doc_id", "a.body", "a.final")


@query("SELECT item_id, 'Q : ' || question || chr(10) || 'R :' || chr(10) || suite || CASE WHEN coalesce(answer, '') <> '' THEN chr(10) || '#### ' || answer ELSE '' END AS qa FROM eval_items")
def format_qa(spark, d):
    return read(spark, d, "eval_items").select("item_id", X.question_answer(F.col("question"), F.col("suite"), F.coalesce("answer", F.lit(""))).alias("qa"))


@query("SELECT doc_id, coalesce(nullif(site, ''), nullif(source, ''), nullif(lang, '')) AS v FROM documents")
def coalesce_field(spark, d):
    return _docs(spark, d).select("doc_id", X.first_filled(F.col("site"), F.col("source"), F.col("lang")).alias("v"))


_LINES = f"SELECT doc_id, pos, {S.strip('l')} AS line FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(text, chr(13), chr(10)), chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL) WHERE length({S.strip('l')}) >= 40"


def _lines(spark, d):
    x = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("\n")), "\n", -1)).alias("pos", "l"))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_replace("l", f"^{X.SPACE}+|{X.SPACE}+$", "").alias("line")).where(F.length("line") >= 40)


@query(_LINES)
def explode_lines(spark, d):
    return _lines(spark, d)


@query(f"SELECT doc, string_agg(line, chr(10) ORDER BY doc_id, pos) AS text FROM (SELECT *, (row_number() OVER (ORDER BY doc_id, pos) - 1) // 50 AS doc FROM ({_LINES})) GROUP BY doc HAVING count(*) = 50")
def pseudo_docs(spark, d):
    return windows.group_lines(_lines(spark, d), ["doc_id", "pos"], "line", 50)


_SIZES = "(VALUES ('1.3B'), ('350M'), ('7B'), ('64K'), ('1_300_000_000'), ('2.5b'), ('12'), (' 3 t '), ('garbage'), (''))"


@query(f"SELECT s, floor(nullif(regexp_extract(c, '^([0-9]+(?:\\.[0-9]+)?)\\s*([KMBT]?)$', 1), '')::DOUBLE * CASE regexp_extract(c, '^([0-9]+(?:\\.[0-9]+)?)\\s*([KMBT]?)$', 2) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1.0 END + 1e-6)::BIGINT AS n FROM (SELECT s, upper(replace(trim(s), '_', '')) AS c FROM {_SIZES} v(s))")
def parse_size(spark, d):
    return spark.sql(f"select * from values ('1.3B'), ('350M'), ('7B'), ('64K'), ('1_300_000_000'), ('2.5b'), ('12'), (' 3 t '), ('garbage'), ('') v(s)").select("s", N.parse_size(F.col("s")).alias("n"))


_N = "CASE WHEN n >= 1e12 THEN printf('%.2fT', n / 1e12) WHEN n >= 1e9 THEN printf('%.2fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END"


@query(f"SELECT source, n, {_N} AS shown FROM (SELECT source, coalesce(sum(n_chars), 0)::BIGINT AS n FROM documents GROUP BY source)")
def format_size(spark, d):
    t = _docs(spark, d).groupBy("source").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n"))
    return t.select("source", "n", N.format_size(F.col("n")).alias("shown"))


@query("SELECT sample_id, CASE WHEN list_max(input_ids) + 1 <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM streaming_sample WHERE len(input_ids) > 0")
def token_dtype(spark, d):
    return read(spark, d, "streaming_sample").where(F.size("input_ids") > 0).select("sample_id", N.token_dtype(F.array_max("input_ids") + 1).alias("dtype"))


@query("SELECT doc_id, replace(replace(nfc_normalize(text), '``', '\"'), '''''', '\"') AS text FROM documents")
def tok_normalize(spark, d):
    return _docs(spark, d).select("doc_id", X.nfc_udf()(F.col("text")).alias("text"))


# --- numbers and vectors ---------------------------------------------------------------------------------------


@query("SELECT event_id, round(exp(least(abs(value) / 100, 20.0)), 4) AS ppl FROM events")
def perplexity(spark, d):
    return read(spark, d, "events").select("event_id", F.round(N.perplexity(F.abs("value") / 100), 4).alias("ppl"))


@query("SELECT range AS step, round(CASE WHEN range < 100 THEN range / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (range - 100) / 900.0)) END, 6) AS f FROM range(0, 1001)")
def lr_schedule(spark, d):
    return spark.range(0, 1001).select(F.col("id").alias("step"), F.round(N.learning_rate(F.col("id"), 1e-3, 1e-4, 100, 1000), 6).alias("f"))


@query("""SELECT vec_id, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))), 5) AS lse, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) - e[label % 64 + 1], 5) AS ce
 FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")
def ce_zloss(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", _nums().alias("e"))
    lse = N.logsumexp(F.col("e"))
    return e.select("vec_id", F.round(lse, 5).alias("lse"), F.round(lse - F.element_at("e", F.col("label") % 64 + 1), 5).alias("ce"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x) / sqrt(ms + 1e-6))), 4) AS l1 FROM (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) / len(e) AS ms FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))")
def rmsnorm_vec(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", N.rms_norm(_nums()).alias("e"))
    return e.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("l1"))


_ROUTE = "SELECT vec_id, CASE WHEN e[1] >= e[2] AND e[1] >= e[3] THEN 0 WHEN e[2] >= e[3] THEN 1 ELSE 2 END AS route FROM (SELECT vec_id, embedding AS e FROM embeddings)"


def _routes(spark, d):
    e = [F.element_at("embedding", i) for i in (1, 2, 3)]
    return read(spark, d, "embeddings").select("vec_id", F.when((e[0] >= e[1]) & (e[0] >= e[2]), 0).when(e[1] >= e[2], 1).otherwise(2).alias("route"))


@query(_ROUTE)
def route_argmax(spark, d):
    return _routes(spark, d)


@query(f"""SELECT round(0.6 * ln(0.6 / greatest(a, 1e-8)) + 0.3 * ln(0.3 / greatest(b, 1e-8)) + 0.1 * ln(0.1 / greatest(c, 1e-8)), 6) AS load_balance, round(0.1 * a + 0.5 * b + c, 6) AS cost
 FROM (SELECT avg((route = 0)::INT) AS a, avg((route = 1)::INT) AS b, avg((route = 2)::INT) AS c FROM ({_ROUTE}))""")
def route_balance(spark, d):
    share = _routes(spark, d).agg(*[F.avg((F.col("route") == i).cast("int")).alias(n) for i, n in enumerate("abc")])
    kl = reduce(lambda a, b: a + b, [t * F.log(t / F.greatest(F.col(n), F.lit(1e-8))) for n, t in (("a", 0.6), ("b", 0.3), ("c", 0.1))])
    return share.select(F.round(kl, 6).alias("load_balance"), F.round(0.1 * F.col("a") + 0.5 * F.col("b") + F.col("c"), 6).alias("cost"))


@query("""WITH p AS (SELECT vec_id, i, least(greatest(1 / (1 + exp(-embedding[i]::DOUBLE)), 1e-8), 1 - 1e-8) AS p FROM embeddings, range(1, 7) t(i)),
 r AS (SELECT vec_id, i, p, coalesce(exp(sum(ln(1 - p)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS left_ FROM p),
 h AS (SELECT vec_id, i, greatest(left_ * p + CASE WHEN i = 6 THEN left_ * (1 - p) ELSE 0 END, 1e-8) AS h FROM r),
 n AS (SELECT vec_id, i, h / sum(h) OVER (PARTITION BY vec_id) AS h FROM h)
 SELECT vec_id, round(max(h), 5) AS top, round(sum(h * (ln(h) - ln(0.5 ^ i / (1 - 0.5 ^ 6)))), 5) AS kl FROM n GROUP BY vec_id""")
def halt_distribution(spark, d):
    p = F.transform(F.slice("embedding", 1, 6), lambda x: 1 / (1 + F.exp(-x.cast("double"))))
    h = read(spark, d, "embeddings").select("vec_id", N.halt_distribution(p).alias("h"))
    return h.select("vec_id", F.round(F.array_max("h"), 5).alias("top"), F.round(N.geometric_divergence(F.col("h")), 5).alias("kl"))


_LOGITS = "SELECT vec_id, i, embedding[i]::DOUBLE * 3 AS x FROM embeddings, range(1, 65) t(i)"


@query(f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS k FROM ({_LOGITS})), s AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM r WHERE k <= 20),
 c AS (SELECT vec_id, i, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
 SELECT vec_id, count(*) AS kept, sum(i)::BIGINT AS ids FROM c WHERE before <= 0.9 GROUP BY vec_id""")
def topk_topp(spark, d):
    """Top 20, then nucleus 0.9: per vector by array functions, no shuffle."""
    x = F.transform("embedding", lambda v, i: F.struct((-3 * v.cast("double")).alias("neg"), (i + 1).alias("i")))
    e = read(spark, d, "embeddings").select("vec_id", F.array_sort(x).alias("s"))
    kth = F.element_at("s", 20)["neg"]
    top = e.select("vec_id", F.filter("s", lambda v: v["neg"] <= kth).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, v: a + F.exp(-v["neg"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("ids"))
    fold = F.aggregate("s", start, lambda a, v: F.struct((a["sum"] + F.exp(-v["neg"]) / F.col("t")).alias("sum"), (a["n"] + F.when(a["sum"] <= 0.9, 1).otherwise(0)).alias("n"), (a["ids"] + F.when(a["sum"] <= 0.9, v["i"]).otherwise(0)).alias("ids")))
    return top.withColumn("t", total).select("vec_id", fold.alias("f")).select("vec_id", F.col("f.n").alias("kept"), F.col("f.ids").alias("ids"))


@query(f"SELECT vec_id, round(sum(CASE WHEN i % 5 = 0 THEN CASE WHEN x > 0 THEN x / 1.2 ELSE x * 1.2 END ELSE x END), 4) AS total FROM ({_LOGITS}) GROUP BY vec_id")
def repetition_penalty(spark, d):
    x = F.transform("embedding", lambda v, i: N.repetition_penalty(v.cast("double") * 3, (i + 1) % 5 == 0, 1.2))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("SELECT sample_id, i // 64 AS segment, count(*) AS n, (ceil(len / 64.0) * 64)::BIGINT AS padded FROM (SELECT sample_id, len(input_ids) AS len, unnest(range(0, len(input_ids))) AS i FROM streaming_sample) GROUP BY 1, 2, 4")
def segment_ids(spark, d):
    n = F.size("input_ids")
    s = read(spark, d, "streaming_sample").where(n > 0).select("sample_id", n.alias("len"), F.explode(F.sequence(F.lit(0), F.expr("(size(input_ids) - 1) div 64"))).alias("segment"))
    return s.select("sample_id", F.col("segment").cast("long").alias("segment"), F.least(F.lit(64), F.col("len") - F.col("segment") * 64).cast("long").alias("n"), (F.ceil(F.col("len") / 64) * 64).cast("long").alias("padded"))


# --- filters and labels ----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE length(text) >= 100")
def filter_min_len(spark, d):
    return _docs(spark, d).where(F.length("text") >= 100).select("doc_id")


@query(f"SELECT row_id FROM vesper_edu_fr WHERE ({' + '.join(f'coalesce({_score_sql(s)}, 0)' for s in SCORES)}) / 5 >= 0.65")
def filter_global(spark, d):
    mean = reduce(lambda a, b: a + b, [F.coalesce(_score(s), F.lit(0.0)) for s in SCORES]) / 5
    return _pages(spark, d).where(mean >= 0.65).select("row_id")


def _kept(spark, d, least=None):
    f = filters.keep_by_dimensions({s: _score(s) for s in SCORES}, X.dims_of(F.col("text")), 0.65, least)
    return _pages(spark, d).select("row_id", *[c.alias(k) for k, c in f.items()])


_PASS = " + ".join(f"coalesce((({_score_sql(s)}) >= 0.65 AND list_contains(dd, '{s}'))::INT, 0)" for s in SCORES)
_KEPT = f"SELECT row_id, r AS n_relevant, p AS n_passed, p >= {{need}} AND r > 0 AS keep FROM (SELECT row_id, {' + '.join(f'list_contains(dd, {S.q(s)})::INT' for s in SCORES)} AS r, {_PASS} AS p FROM (SELECT *, {S.dims('text')} AS dd FROM vesper_edu_fr))"


@query(_KEPT.format(need="r"))
def filter_dimensions(spark, d):
    return _kept(spark, d)


@query(_KEPT.format(need="least(3, r)"))
def filter_dimensions_some(spark, d):
    return _kept(spark, d, 3)


@query("SELECT " + ", ".join(f"round(avg((({_score_sql(s)}) >= 0.65)::INT), 6) AS {s}" for s in SCORES) + " FROM vesper_edu_fr")
def dim_pass_rates(spark, d):
    return _pages(spark, d).agg(*[F.round(F.avg((_score(s) >= 0.65).cast("int")), 6).alias(s) for s in SCORES])


@query("SELECT row_id FROM vesper_edu_fr WHERE row_id NOT IN (SELECT doc_id FROM annotation WHERE doc_id IS NOT NULL)")
def resume_anti(spark, d):
    done = read(spark, d, "annotation").select(F.col("doc_id").alias("row_id"))
    return filters.resume(_pages(spark, d).select("row_id"), done, "row_id")


@query(" UNION ALL ".join(f"SELECT '{k}' AS dim, count(*) AS n, count(CASE WHEN {k} >= 3 THEN 1 END) AS high FROM annotation WHERE {k} BETWEEN 0 AND 5" for k in DIMS))
def labels_per_dim(spark, d):
    a = read(spark, d, "annotation")
    rows = F.array(*[F.struct(F.lit(k).alias("dim"), F.count(F.when(F.col(k).between(0, 5), 1)).alias("n"), F.count(F.when(F.col(k).between(3, 5), 1)).alias("high")) for k in DIMS])
    return a.agg(rows.alias("r")).select(F.explode("r").alias("x")).select("x.*")


@query("SELECT doc_id, coherence, substring(text, 1, 200) AS t FROM (SELECT DISTINCT doc_id, coherence, text FROM annotation WHERE coherence = 0) ORDER BY doc_id, t LIMIT 5")
def examples_by_score(spark, d):
    return read(spark, d, "annotation").where("coherence = 0").select("doc_id", "coherence", "text").distinct().select("doc_id", "coherence", F.substring("text", 1, 200).alias("t")).orderBy("doc_id", "t").limit(5)


@query("SELECT doc_id, doc_id % 8 AS shard FROM documents")
def shard_modulo(spark, d):
    return _docs(spark, d).select("doc_id", F.pmod("doc_id", F.lit(8)).alias("shard"))


# --- deduplication ---------------------------------------------------------------------------------------------

_AUTH = S.authority("url")
_D1 = f"d1 AS (SELECT row_id, coalesce(url, '') AS u, md5({S.prefix('text', 1000)}) AS p FROM vesper_edu_fr QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY row_id) = 1)"
_D2 = "d2 AS (SELECT row_id, p FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY row_id) AS k FROM d1) WHERE k = 1 OR u = '')"
_D3 = "d3 AS (SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY row_id) AS k FROM d2) WHERE k = 1)"


@query(f"WITH {_D1} SELECT row_id FROM d1")
def dedup_exact(spark, d):
    return dedup.dedup(_pages(spark, d), "row_id", fuzzy_chars=None)


@query(f"WITH {_D1}, {_D2} SELECT row_id FROM d2")
def dedup_url(spark, d):
    return dedup.dedup(_pages(spark, d), "row_id", url=F.col("url"), fuzzy_chars=None)


@query(f"WITH e AS (SELECT doc_id, md5({S.prefix('text', 1000)}) AS p FROM documents QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) = 1) SELECT doc_id FROM e QUALIFY row_number() OVER (PARTITION BY p ORDER BY doc_id) = 1")
def dedup_fuzzy(spark, d):
    return dedup.dedup(_docs(spark, d), "doc_id")


@query(f"WITH {_D1}, {_D2}, {_D3} SELECT row_id FROM d3")
def dedup_full(spark, d):
    return dedup.dedup(_pages(spark, d), "row_id", url=F.col("url"))


@query(f"WITH {_D1}, {_D2}, {_D3} SELECT (SELECT count(*) FROM vesper_edu_fr) AS total, (SELECT count(*) FROM d3) AS kept, (SELECT count(*) FROM vesper_edu_fr) - (SELECT count(*) FROM d1) AS exact, (SELECT count(*) FROM d1) - (SELECT count(*) FROM d2) AS url, (SELECT count(*) FROM d2) - (SELECT count(*) FROM d3) AS fuzzy, (SELECT count(*) FROM vesper_edu_fr WHERE coalesce(text, '') = '') AS empty")
def dedup_summary(spark, d):
    levels = dedup.dedup_levels(_pages(spark, d), "row_id", url=F.col("url"))
    c = levels.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("level") == k, 1)).alias(k) for k in ("kept", "exact", "url", "fuzzy")])
    return c.crossJoin(_pages(spark, d).agg(F.count(F.when(F.coalesce(F.col("text"), F.lit("")) == "", 1)).alias("empty")))


_SETS = f"""g AS (SELECT doc_id, list_sort({S.grams('text', first=None)}) AS g FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY md5(array_to_string(g, chr(10)))) AS class FROM g WHERE len(g) > 0)"""


@query(f"""WITH {_SETS}, c AS (SELECT class AS id, any_value(g) AS g, count(*) AS members FROM k GROUP BY class), e AS (SELECT id, unnest(g) AS x FROM c), f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
 s AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM e a JOIN f USING (x) JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
 SELECT a, b, ca.members AS members_a, cb.members AS members_b, shared, round(shared / (len(ca.g) + len(cb.g) - shared), 6) AS jaccard FROM s JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE shared / (len(ca.g) + len(cb.g) - shared) >= 0.8""")
def near_dup_pairs(spark, d):
    """Pairs of classes of documents with equal sets of five-word runs, at least 0.8 alike, over whole texts."""
    p = dedup.near_pairs(_docs(spark, d), "doc_id", least=0.8, equal=True)
    return p.withColumn("jaccard", F.round("jaccard", 6)).withColumn("shared", F.col("shared").cast("long"))


@query(f"WITH {_SETS} SELECT doc_id, class FROM k")
def near_dup_classes(spark, d):
    """The class of each document that near_dup_pairs speaks of by its smallest member."""
    return dedup.gram_classes(_docs(spark, d), "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))")
def stream_dedup(spark, d):
    src, base = _docs(spark, d).select("doc_id", "text"), scratch(spark, "sd")
    src.write.parquet(base + "-in")
    streams.dedup_into(streams.file_stream(spark, base + "-in", src.schema), "doc_id", "text", base + "-store", base + "-cp").awaitTermination()
    return spark.read.parquet(base + "-store").select("doc_id")


# --- reports ---------------------------------------------------------------------------------------------------


@query("WITH v AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS k, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL) SELECT max(n) AS n, round(avg(v), 4) AS avg, min(v) AS min, max(v) AS max, max(CASE WHEN k = n // 2 THEN v END) AS median, max(CASE WHEN k = floor(n * 0.1) THEN v END) AS p10, max(CASE WHEN k = floor(n * 0.9) THEN v END) AS p90 FROM v")
def text_length_stats(spark, d):
    s = audit.nearest_ranks(_docs(spark, d), F.length("text"), {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return s.select("n", F.round("avg", 4).alias("avg"), *[F.col(c).cast("long").alias(c) for c in ("min", "max", "median", "p10", "p90")])


_B = "CASE WHEN length(text) < 500 THEN '<500' WHEN length(text) < 2000 THEN '500-2k' WHEN length(text) < 5000 THEN '2k-5k' WHEN length(text) < 10000 THEN '5k-10k' ELSE '10k+' END"


@query(f"SELECT b AS bucket, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(text) FROM vesper_edu_fr), 4) AS pct FROM (VALUES ('<500'), ('500-2k'), ('2k-5k'), ('5k-10k'), ('10k+')) v(b) LEFT JOIN (SELECT {_B} AS k, count(*) AS n FROM vesper_edu_fr WHERE text IS NOT NULL GROUP BY 1) ON k = b")
def length_buckets(spark, d):
    return audit.length_buckets(_pages(spark, d), F.length("text"))


@query(f"SELECT {_AUTH} AS domain, count(*) AS n FROM vesper_edu_fr GROUP BY 1")
def domain_counts(spark, d):
    return _pages(spark, d).groupBy(X.authority(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"SELECT {_AUTH} AS value, count(*) AS n, min(row_id) AS first_seen FROM vesper_edu_fr GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20")
def top_domains(spark, d):
    return audit.top_values(_pages(spark, d), X.authority(F.col("url")), "row_id", 20)


@query(f"SELECT sum(n)::BIGINT AS top, (SELECT count(*) FROM vesper_edu_fr) AS total, round(100.0 * sum(n) / (SELECT count(*) FROM vesper_edu_fr), 4) AS pct, 100.0 * sum(n) > 50.0 * (SELECT count(*) FROM vesper_edu_fr) AS flagged FROM (SELECT count(*) AS n, min(row_id) AS f FROM vesper_edu_fr GROUP BY {_AUTH} ORDER BY n DESC, f LIMIT 10)")
def domain_concentration(spark, d):
    return audit.concentration(_pages(spark, d), X.authority(F.col("url")))


@query()
def site_counts(spark, d):
    """Sites, over which spellings of a host are one; compared with a plain parser in tests."""
    return _pages(spark, d).groupBy(site_of(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


@query(f"SELECT count(CASE WHEN b = 0 THEN 1 END) AS clean, count(CASE WHEN b = 1 THEN 1 END) AS mild, count(CASE WHEN b >= 2 THEN 1 END) AS bad, round(100.0 * count(CASE WHEN b >= 2 THEN 1 END) / count(*), 4) AS pct_bad FROM (SELECT {S.boiler('text')} AS b FROM vesper_edu_fr)")
def boilerplate_hist(spark, d):
    b = _pages(spark, d).select(X.boilerplate_score(F.col("text")).alias("b"))
    bad = F.count(F.when(F.col("b") >= 2, 1))
    return b.agg(F.count(F.when(F.col("b") == 0, 1)).alias("clean"), F.count(F.when(F.col("b") == 1, 1)).alias("mild"), bad.alias("bad"), F.round(100.0 * bad / F.count("*"), 4).alias("pct_bad"))


@query(f"SELECT row_id, {S.boiler('text')} AS score FROM vesper_edu_fr ORDER BY score DESC, row_id LIMIT 3")
def worst_boilerplate(spark, d):
    return _pages(spark, d).select("row_id", X.boilerplate_score(F.col("text")).alias("score")).orderBy(F.desc("score"), "row_id").limit(3)


@query(" UNION ALL ".join(f"SELECT '{k}' AS dim, count({k}) AS n, round(avg({k}), 6) AS avg FROM annotation WHERE {k} BETWEEN 0 AND 5" for k in DIMS))
def dim_averages(spark, d):
    s = audit.column_stats(read(spark, d, "annotation"), {k: F.when(F.col(k).between(0, 5), F.col(k)) for k in DIMS})
    return s.select("dim", "n", F.round("avg", 6).alias("avg"))


@query("SELECT dim, s::INT AS score, count(v) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS dim, s, v FROM range(0, 6) t(s) LEFT JOIN (SELECT {k} AS v FROM annotation) ON v = s" for k in DIMS) + " UNION ALL SELECT 'total', s, v FROM range(0, 26) t(s) LEFT JOIN (SELECT total AS v FROM annotation) ON v = s) GROUP BY dim, s")
def score_hist(spark, d):
    a = read(spark, d, "annotation")
    return audit.histogram(a, {k: F.col(k) for k in DIMS}, 0, 5).unionByName(audit.histogram(a, {"total": F.col("total")}, 0, 25))


@query(" UNION ALL ".join(f"SELECT '{s}' AS dim, count(x) AS n, round(avg(x), 6) AS avg, min(x) AS min, max(x) AS max FROM (SELECT {_score_sql(s)} AS x FROM vesper_edu_fr)" for s in SCORES))
def score_stats(spark, d):
    return audit.column_stats(_pages(spark, d), {s: _score(s) for s in SCORES}).withColumn("avg", F.round("avg", 6))


@query("SELECT count(*) AS n, round(avg(total), 4) AS avg, round(100.0 * avg((total >= 15)::INT), 4) AS good, round(100.0 * avg((total >= 20)::INT), 4) AS excellent, round(100.0 * avg((total < 10)::INT), 4) AS poor, CASE WHEN avg((total < 10)::INT) > 0.2 THEN 'lenient' WHEN avg((total >= 15)::INT) > 0.6 THEN 'ok' ELSE 'mixed' END AS verdict, " + ", ".join(f"count(CASE WHEN {k} BETWEEN 0 AND 1 THEN 1 END) AS {k}_low, count(CASE WHEN {k} BETWEEN 2 AND 3 THEN 1 END) AS {k}_mid, count(CASE WHEN {k} BETWEEN 4 AND 5 THEN 1 END) AS {k}_high" for k in DIMS) + " FROM annotation WHERE total BETWEEN 0 AND 25")
def rescore_bands(spark, d):
    a = read(spark, d, "annotation").where("total between 0 and 25")
    rate = lambda c: F.avg(c.cast("int"))
    t = F.col("total")
    bands = [F.count(F.when(F.col(k).between(*r), 1)).alias(f"{k}_{n}") for k in DIMS for n, r in (("low", (0, 1)), ("mid", (2, 3)), ("high", (4, 5)))]
    verdict = F.when(rate(t < 10) > 0.2, "lenient").when(rate(t >= 15) > 0.6, "ok").otherwise("mixed")
    return a.agg(F.count("*").alias("n"), F.round(F.avg("total"), 4).alias("avg"), F.round(100 * rate(t >= 15), 4).alias("good"), F.round(100 * rate(t >= 20), 4).alias("excellent"), F.round(100 * rate(t < 10), 4).alias("poor"), verdict.alias("verdict"), *bands)


@query(f"SELECT round(c / greatest(1, w), 6) AS ratio, CASE WHEN c / greatest(1, w) >= 5 THEN 'exceptional' WHEN c / greatest(1, w) >= 4.5 THEN 'excellent' WHEN c / greatest(1, w) >= 4 THEN 'ok' ELSE 'low' END AS verdict FROM (SELECT sum(length(text))::BIGINT AS c, sum(len({S.words('text')}))::BIGINT AS w FROM documents)")
def chars_per_token(spark, d):
    t = _docs(spark, d).agg(F.sum(F.length("text")).alias("c"), F.sum(F.size(X.words(F.col("text")))).alias("w"))
    r = F.col("c") / F.greatest(F.lit(1), F.col("w"))
    return t.select(F.round(r, 6).alias("ratio"), F.when(r >= 5, "exceptional").when(r >= 4.5, "excellent").when(r >= 4, "ok").otherwise("low").alias("verdict"))


@query("SELECT doc_id, floor(length(text) / 4.5)::DOUBLE AS estimate FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.floor(F.length("text") / 4.5).cast("double").alias("estimate"))


@query("SELECT sample_id, len(input_ids) AS n, coalesce(list_min(list_filter(range(1, least(len(input_ids), len(targets)) + 1), lambda i: input_ids[i] <> targets[i])), least(len(input_ids), len(targets)) + 1) - 1 AS first_diff, len(list_filter(range(1, least(len(input_ids), len(targets)) + 1), lambda i: input_ids[i] = targets[i])) AS same FROM streaming_sample WHERE len(input_ids) > 0 AND targets IS NOT NULL")
def encoding_diff(spark, d):
    s = read(spark, d, "streaming_sample").where("size(input_ids) > 0 and targets is not null")
    n = F.least(F.size("input_ids"), F.size("targets"))
    z = F.slice(F.arrays_zip(F.col("input_ids").alias("a"), F.col("targets").alias("b")), F.lit(1), n)
    first = F.array_position(F.transform(z, lambda x: x["a"] != x["b"]), True)
    same = F.size(F.filter(z, lambda x: x["a"] == x["b"]))
    return s.select("sample_id", F.size("input_ids").cast("long").alias("n"), F.when(first == 0, n).otherwise(first - 1).cast("long").alias("first_diff"), same.cast("long").alias("same"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, sum(length({c}))::BIGINT AS chars FROM {t}" for t, c in (("documents", "text"), ("vesper_edu_fr", "text"), ("annotation", "text"))))
def shard_totals(spark, d):
    return reduce(DataFrame.unionByName, [read(spark, d, t).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).select(F.lit(t).alias("t"), "n", "chars") for t in ("documents", "vesper_edu_fr", "annotation")])


_TRUTH = "(SELECT a.t, (v.score_pedagogy >= 0.65) AS g FROM (SELECT doc_id, max(pedagogy) >= 3 AS t FROM annotation WHERE pedagogy BETWEEN 0 AND 5 GROUP BY doc_id) a JOIN vesper_edu_fr v ON v.row_id = a.doc_id WHERE v.score_pedagogy::VARCHAR <> 'nan' AND v.score_pedagogy BETWEEN 0 AND 1)"
_CM = f"SELECT count(CASE WHEN t AND g THEN 1 END) AS tp, count(CASE WHEN NOT t AND g THEN 1 END) AS fp, count(CASE WHEN t AND NOT g THEN 1 END) AS fn, count(CASE WHEN NOT t AND NOT g THEN 1 END) AS tn FROM {_TRUTH}"


@query(f"SELECT label, n, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT label, n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT 'high' AS label, tp + fn AS n, tp, fp, fn FROM ({_CM}) UNION ALL SELECT 'low', tn + fp, tn, fn, fp FROM ({_CM}) UNION ALL SELECT 'all', tp + tn + fp + fn, tp + tn, fp + fn, fp + fn FROM ({_CM})))")
def classifier_metrics(spark, d):
    truth = read(spark, d, "annotation").where("pedagogy between 0 and 5").groupBy("doc_id").agg((F.max("pedagogy") >= 3).alias("t"))
    j = _pages(spark, d).join(truth, F.col("row_id") == F.col("doc_id")).select("t", (_score("pedagogy") >= 0.65).alias("g"))
    r = filters.classifier_report(j, F.col("t"), F.col("g"))
    return r.select("label", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- order, windows, samples, mixtures -------------------------------------------------------------------------


@query("WITH s AS (SELECT doc_id, length(trim(coalesce(text, ''))) + 2 AS size, coalesce(sum(length(trim(coalesce(text, ''))) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, coalesce(sum(length(trim(coalesce(text, ''))) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS b2, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT doc_id, size, CASE WHEN k > 1 AND b2 >= 450000 THEN 'val' ELSE 'train' END AS split FROM s WHERE b < 500000")
def char_budget_split(spark, d):
    return windows.budget_split(_docs(spark, d), "doc_id", F.length(F.trim(F.coalesce("text", F.lit("")))) + 2, 500_000, 0.1)


@query("""WITH t AS (SELECT sample_id, list_append(coalesce(input_ids, []::BIGINT[]), 50256::BIGINT) AS t FROM streaming_sample), o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t),
 e AS (SELECT off + pos AS g, tok FROM (SELECT off, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM o)), c AS (SELECT (g // 513)::BIGINT AS chunk, list(tok ORDER BY g) AS f FROM e GROUP BY 1 HAVING count(*) >= 2),
 p AS (SELECT chunk, list_concat(f, list_transform(range(0, 513 - len(f)), lambda i: 50256::BIGINT)) AS f FROM c)
 SELECT chunk, array_to_string(list_slice(f, 1, 512), ',') AS input_ids, array_to_string(list_slice(f, 2, 513), ',') AS targets FROM p""")
def pack_tokens(spark, d):
    p = windows.pack_stream(read(spark, d, "streaming_sample"), "sample_id", "input_ids", 512, 50256)
    return p.select("chunk", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("targets", ",").alias("targets"))


@query("""SELECT sample_id, w AS "window", least(w * 48, n - 65) AS start, array_to_string(list_slice(input_ids, least(w * 48, n - 65) + 1, least(w * 48, n - 65) + 64), ',') AS input_ids, array_to_string(list_slice(input_ids, least(w * 48, n - 65) + 2, least(w * 48, n - 65) + 65), ',') AS targets
 FROM (SELECT sample_id, input_ids, len(input_ids) AS n, unnest(range(0, greatest(1, (len(input_ids) - 65) // 48 + 1))) AS w FROM streaming_sample WHERE len(input_ids) >= 65)""")
def strided_windows(spark, d):
    w = windows.strided_windows(read(spark, d, "streaming_sample").select("sample_id", "input_ids"), "sample_id", "input_ids", 64, 48)
    return w.select("sample_id", F.col("window").cast("long").alias("window"), F.col("start").cast("long").alias("start"), F.array_join("input_ids", ",").alias("input_ids"), F.array_join("targets", ",").alias("targets"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def head_n(spark, d):
    return windows.head(_docs(spark, d), "doc_id", 10).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 10")
def tail_n(spark, d):
    return windows.tail(_docs(spark, d), "doc_id", 10).select("doc_id", "lang")


_SUM = " + ".join(f"coalesce({_score_sql(s)}, 0)" for s in SCORES)


def _summed(spark, d):
    return _pages(spark, d).select("row_id", F.round(reduce(lambda a, b: a + b, [F.coalesce(_score(s), F.lit(0.0)) for s in SCORES]), 6).alias("s"))


@query(f"SELECT row_id, round({_SUM}, 6) AS s FROM vesper_edu_fr ORDER BY s DESC, row_id LIMIT 20")
def best_n(spark, d):
    return _summed(spark, d).orderBy(F.desc("s"), "row_id").limit(20)


@query(f"SELECT row_id, round({_SUM}, 6) AS s FROM vesper_edu_fr ORDER BY s, row_id LIMIT 20")
def worst_n(spark, d):
    return _summed(spark, d).orderBy("s", "row_id").limit(20)


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 200")
def sample_n(spark, d):
    return sampling.sample(_docs(spark, d), "doc_id", 200).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM eval_items)")
def sample_by_index(spark, d):
    wanted = read(spark, d, "eval_items").select(F.col("item_id").alias("doc_id")).distinct()
    return _docs(spark, d).select("doc_id", "lang").join(wanted, "doc_id", "left_semi")


@query("SELECT row_id, CASE WHEN row_number() OVER (ORDER BY md5(row_id || '-42'), row_id) <= floor((SELECT count(*) FROM vesper_edu_fr) * 0.1) THEN 'val' ELSE 'train' END AS split FROM vesper_edu_fr")
def train_val_split(spark, d):
    return sampling.train_val(_pages(spark, d), "row_id", 0.1)


@query(f"SELECT sample_id, n, CASE WHEN n > 512 THEN input_ids[floor({S.unit('sample_id', S.q('crop'))} * (n - 511))::BIGINT + 1] ELSE input_ids[1] END AS first_id, least(n, 512) AS kept FROM (SELECT sample_id, input_ids, len(input_ids) AS n FROM streaming_sample WHERE len(input_ids) > 0)")
def crop_tokens(spark, d):
    s = read(spark, d, "streaming_sample").where(F.size("input_ids") > 0)
    c = s.select("sample_id", F.size("input_ids").cast("long").alias("n"), sampling.crop(F.col("input_ids"), F.col("sample_id"), 512, "crop").alias("c"))
    return c.select("sample_id", "n", F.col("c")[0].alias("first_id"), F.size("c").cast("long").alias("kept"))


@query("SELECT doc_id, buffer, row_number() OVER (PARTITION BY buffer ORDER BY md5(doc_id || '-buf'), doc_id) AS place FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS buffer FROM documents)")
def shuffle_buffer(spark, d):
    return sampling.buffer_shuffle(_docs(spark, d).select("doc_id"), "doc_id", 100, "buf").select("doc_id", "buffer", "place")


@query("SELECT path, name, weight, round(weight / sum(weight) OVER (), 8) AS prob FROM (SELECT path, name, max(weight) AS weight FROM sources WHERE weight > 0 AND weight::VARCHAR <> 'nan' GROUP BY path, name)")
def mix_probs(spark, d):
    return sampling.mix_probabilities(read(spark, d, "sources")).withColumn("prob", F.round("prob", 8))


def _interleaved(strategy: str):
    """Sources are the languages, weighted by the square root of their sizes; as many draws as it takes to exhaust them."""
    pick, most = ("max", 40) if strategy == "all_exhausted" else ("min", 20)
    return f"""WITH n AS (SELECT lang, count(*) AS size, sqrt(count(*)::DOUBLE) AS weight FROM documents WHERE lang IS NOT NULL GROUP BY lang),
 t AS (SELECT sum(weight) AS total FROM n), b AS (SELECT lang, size, (sum(weight) OVER (ORDER BY lang)) / total AS upto, coalesce(sum(weight) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS low, row_number() OVER (ORDER BY lang DESC) = 1 AS final FROM n, t),
 r AS (SELECT range AS draw, {S.unit('range', S.q('mix'))} AS u FROM range(0, {most} * (SELECT count(*) FROM documents))),
 k AS (SELECT draw, lang AS source, size, row_number() OVER (PARTITION BY lang ORDER BY draw) AS k FROM r JOIN b ON u >= low AND (u < upto OR final)),
 e AS (SELECT {pick}(draw) AS last FROM k WHERE k = size) SELECT draw, source, k, (k - 1) % size AS item FROM k, e WHERE draw <= last"""


def _interleave(spark, d, strategy):
    import math

    sizes = {r["lang"]: r["n"] for r in _docs(spark, d).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    return sampling.interleave_all(spark, [(n, math.sqrt(k)) for n, k in sizes.items()], sizes, strategy)


@query(_interleaved("all_exhausted"))
def weighted_interleave(spark, d):
    return _interleave(spark, d, "all_exhausted")


@query(_interleaved("first_exhausted"))
def weighted_interleave_first(spark, d):
    return _interleave(spark, d, "first_exhausted")


# --- tokens ----------------------------------------------------------------------------------------------------

_WORDS = f"SELECT w, count(*) AS n FROM (SELECT unnest({S.words('lower(text)')}) AS w FROM documents) GROUP BY w"


def _word_counts(spark, d):
    return _docs(spark, d).select(F.explode(X.words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query(f"SELECT substring(w, i, 1) AS a, substring(w, i + 1, 1) AS b, sum(n)::BIGINT AS n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM ({_WORDS})) GROUP BY 1, 2")
def bpe_pair_counts(spark, d):
    """One round of pair counts over the words' characters: word counts first, then their pairs."""
    p = _word_counts(spark, d).where(F.length("w") > 1).select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    return p.groupBy(F.expr("substring(w, i, 1)").alias("a"), F.expr("substring(w, i + 1, 1)").alias("b")).agg(F.sum("n").alias("n"))


@query(f"""WITH v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS id FROM ({_WORDS})), s AS (SELECT id, w, unnest(range(1, length(w))) AS i FROM v WHERE length(w) > 1)
 SELECT s.id AS piece, l.w AS l, r.w AS r, l.id AS lid, r.id AS rid FROM s JOIN v l ON l.w = substring(s.w, 1, s.i) JOIN v r ON r.w = substring(s.w, s.i + 1)""")
def bpe_merge_extract(spark, d):
    """Every cut of a piece whose halves are pieces too."""
    v = ranked(_word_counts(spark, d).select("w", (-F.col("n")).alias("neg")), ["neg", "w"]).select("w", F.col("rank").alias("id"))
    v = materialize(v, "pieces")
    s = v.where(F.length("w") > 1).select(F.col("id").alias("piece"), "w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    s = s.select("piece", F.expr("substring(w, 1, i)").alias("l"), F.expr("substring(w, i + 1)").alias("r"))
    return s.join(v.select(F.col("w").alias("l"), F.col("id").alias("lid")), "l").join(v.select(F.col("w").alias("r"), F.col("id").alias("rid")), "r").select("piece", "l", "r", "lid", "rid")


# --- logs ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS delta FROM events")
def step_rates(spark, d):
    e = series.step_rates(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("event_id", "user_id", F.round("delta", 3).alias("delta"))


@query("SELECT user_id, block, count(value) AS n, round(avg(value), 5) AS avg, min(value) AS lo, max(value) AS hi FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS block FROM events) GROUP BY user_id, block")
def metrics_rollup(spark, d):
    return series.rollup(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value"), 10).withColumn("avg", F.round("avg", 5))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, ln(greatest(value, 1e-8)) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
 e AS (SELECT user_id, event_id, k, x AS ema FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.event_id, s.k, e.ema + 2.0::DOUBLE / 11 * (s.x - e.ema) FROM e JOIN s ON s.user_id = e.user_id AND s.k = e.k + 1) SELECT user_id, event_id, round(ema, 5) AS ema FROM e""")
def ema_log_loss(spark, d):
    e = series.moving_log_loss(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value"), 10)
    return e.select("user_id", "event_id", F.round("ema", 5).alias("ema"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, value AS v, value IS NULL OR NOT isfinite(value) AS odd, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 e AS (SELECT user_id, event_id, k, odd AS skipped, CASE WHEN odd THEN NULL ELSE v END AS prev, CASE WHEN odd THEN 0 ELSE 1 END AS step, CASE WHEN odd THEN 1 ELSE 0 END AS streak, false AS rollback FROM s WHERE k = 1
 UNION ALL SELECT user_id, event_id, k, skip, CASE WHEN skip THEN prev ELSE v END, step + (NOT skip)::INT, CASE WHEN NOT skip OR streak = 9 THEN 0 ELSE streak + 1 END, skip AND streak = 9
 FROM (SELECT s.*, e.prev, e.step, e.streak, s.odd OR coalesce(e.step > 5 AND s.v > e.prev * 1.5, false) AS skip FROM e JOIN s ON s.user_id = e.user_id AND s.k = e.k + 1))
 SELECT user_id, event_id, skipped, rollback FROM e""")
def spike_guard(spark, d):
    return series.guarded(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", after=5).drop("ts")


@query()
def lvs_controller(spark, d):
    """Each user's events as a run's log."""
    e = series.controlled(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 20_000, 50_257)
    return e.select("user_id", "event_id", F.round("lr_scale", 8).alias("lr_scale"), F.round("momentum_scale", 8).alias("momentum_scale"))


_RATE = "SELECT user_id, event_id, n, t FROM (SELECT user_id, event_id, row_number() OVER w - 1 AS n, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"SELECT user_id, event_id, n, round(CASE WHEN t > 0 THEN n * 512.0 / t END, 6) AS rate, round(CASE WHEN t > 0 AND n > 0 THEN greatest(0, 1000 - n) / (n / t) END, 2) AS eta FROM ({_RATE})")
def run_progress(spark, d):
    """Tokens a second (512 a step) and seconds left to a thousand steps, of each user's events as a run."""
    p = series.progress(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(512.0), 1000)
    return p.select("user_id", "event_id", "n", F.round("rate", 6).alias("rate"), F.round("eta", 2).alias("eta"))


@query("WITH b AS (SELECT event_type, block, avg(value) AS avg FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS block FROM events) GROUP BY 1, 2) SELECT event_type, block, round(avg, 5) AS avg, round(avg - min(avg) OVER (PARTITION BY block), 5) AS lead FROM b")
def compare_runs(spark, d):
    c = series.compare_runs(read(spark, d, "events"), "event_type", ["ts", "event_id"], F.col("value"), 50)
    return c.select("event_type", "block", F.round("avg", 5).alias("avg"), F.round("lead", 5).alias("lead"))


@query("SELECT event_id, value FROM events")
def metrics_resume(spark, d):
    """A log written up to a step, gone on with from an earlier one: later rows of the old log give way to those of the new."""
    path, e = scratch(spark, "log"), read(spark, d, "events").select("event_id", "value")
    middle, back = e.agg(F.expr("percentile_approx(event_id, 0.6)"), F.expr("percentile_approx(event_id, 0.5)")).first()
    files.append_metrics(e.where(F.col("event_id") <= middle).withColumn("value", F.when(F.col("event_id") > back, F.lit(-1.0)).otherwise(F.col("value"))), path, "event_id")
    files.append_metrics(e.where(F.col("event_id") > back), path, "event_id", resume=back)
    return files.read_metrics(spark, path, "event_id", e.schema)


# --- learning and calls ----------------------------------------------------------------------------------------


@query()
def quality_classifier(spark, d):
    """One model a dimension, scored on rows held out by a hash: precision, recall and F1 of both classes and of all."""
    a = read(spark, d, "annotation").dropDuplicates(["doc_id"])
    train, held = learning.split_rows(a, "doc_id", 0.2)
    out = None
    for k in DIMS:
        model = learning.train_dimension(train, F.col("text"), F.col(k))
        if model is None:
            continue
        scored = learning.predict_dimension(model, held.where(F.col(k).between(0, 5)).select("doc_id", "text", k), F.col("text"), "p")
        r = filters.classifier_report(scored, F.col(k) >= 3, F.col("p") >= 0.5).select(F.lit(k).alias("dim"), "label", "n", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])
        out = r if out is None else out.unionByName(r)
    return out if out is not None else spark.createDataFrame([], "dim string, label string, n long, precision double, recall double, f1 double")


def _stub_score(text: str) -> str:
    """A stand-in for a model: scores that depend on the text alone."""
    import hashlib

    h = hashlib.md5((text or "").encode()).digest()
    return "Scores: {" + ", ".join(f'"{k}": {h[i] % 6}' for i, k in enumerate(X.TEXT_DIMS)) + "}"


@query("SELECT row_id, " + " + ".join(f"(('0x' || substring(md5(coalesce(text, '')), {2 * i + 1}, 2))::INT % 6)" for i in range(5)) + " AS total FROM vesper_edu_fr")
def model_scores(spark, d):
    r = learning.call_out(_pages(spark, d), "row_id", "text", _stub_score)
    return r.select("row_id", X.parse_scores(F.col("reply"))["total"].alias("total"))


@query("SELECT item_id, question AS text FROM eval_items")
def translate_identity(spark, d):
    t = learning.translated(read(spark, d, "eval_items"), "item_id", "question", lambda part: part)
    return t.select("item_id", "text")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Full deduplication of the pages in order, the length filter, and lengths by language."""
    pages = _pages(spark, d)
    kept = pages.select("row_id", "lang", F.length("text").alias("n")).join(dedup.dedup(pages, "row_id", url=F.col("url")), "row_id", "left_semi")
    return kept.where("n >= 100").groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg("n"), 4).alias("avg_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"))


@query(f"WITH {_D1}, {_D2}, {_D3} SELECT lang, count(*) AS docs, round(avg(length(text)), 4) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM vesper_edu_fr JOIN d3 USING (row_id) WHERE length(text) >= 100 GROUP BY lang")
def pipeline(spark, d):
    return flagship(spark, d)


# --- further operators of scans, sinks, records and tokens -----------------------------------------------------


@query("SELECT text FROM (SELECT doc_id, text FROM documents WHERE coalesce(text, '') <> '' ORDER BY doc_id LIMIT 500)")
def scan_first_texts(spark, d):
    """A text scan with a row cap, which is the operator: the first 500 filled texts in order."""
    return files.scan_texts(windows.head(_docs(spark, d).where("coalesce(text, '') <> ''"), "doc_id", 500), "text")


@query("SELECT text FROM documents WHERE coalesce(text, '') <> ''")
def scan_jsonl_texts(spark, d):
    path = scratch(spark, "jsonl-texts")
    files.write_jsonl(_docs(spark, d).select("text"), path)
    return files.scan_texts(files.scan_jsonl(spark, path, "text string").where("not bad"), "text")


@query("SELECT doc_id, md5(to_json({'doc_id': doc_id, 'lang': coalesce(lang, '')})) AS h FROM documents WHERE doc_id % 2 = 0")
def pass_through_raw(spark, d):
    """Lines that a filter keeps are written as the bytes they came in; every second document stays."""
    path, kept = scratch(spark, "raw"), scratch(spark, "raw-kept")
    files.write_jsonl(_docs(spark, d).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), path)
    files.write_raw(files.scan_jsonl(spark, path, "doc_id long").where("doc_id % 2 = 0"), kept)
    return files.scan_jsonl(spark, kept, "doc_id long").select("doc_id", F.md5("raw").alias("h"))


@query("WITH s AS (SELECT doc_id, length(trim(text)) + 2 AS size FROM documents WHERE length(trim(text)) >= 200), b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS b2, row_number() OVER (ORDER BY doc_id) AS k FROM s) SELECT doc_id, size, CASE WHEN k > 1 AND b2 >= 450000 THEN 'val' ELSE 'train' END AS split FROM b WHERE b < 500000")
def char_budget_long(spark, d):
    """Texts under 200 characters are left out before the budget is counted."""
    t = F.trim(F.col("text"))
    return windows.budget_split(_docs(spark, d).where(F.length(t) >= 200), "doc_id", F.length(t) + 2, 500_000, 0.1)


@query("SELECT doc_id, total FROM annotation WHERE length(trim(coalesce(text, ''))) > 0 AND total IS NOT NULL")
def valid_records(spark, d):
    """Records with a text and a total."""
    return read(spark, d, "annotation").where(filters.has_fields("text", "total")).select("doc_id", "total")


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM vesper_edu_fr) WHERE k > 300")
def resume_skip(spark, d):
    """A run that starts after its first 300 rows."""
    return filters.skip_first(_pages(spark, d).select("row_id"), ["row_id"], 300)


@query(f"SELECT row_id, {', '.join(f'round({_score_sql(s)}, 3) AS {s}' for s in SCORES)} FROM vesper_edu_fr")
def rounded_scores(spark, d):
    return _pages(spark, d).select("row_id", *[F.round(_score(s), 3).alias(s) for s in SCORES])


@query("SELECT '# ' || 'vesper_edu_fr' || chr(10) || chr(10) || '- rows: ' || count(*) || chr(10) || '- columns: ' || 'row_id, text, url' || chr(10) || '- characters: ' || sum(length(text))::BIGINT AS card FROM vesper_edu_fr")
def dataset_card(spark, d):
    return files.dataset_card(_pages(spark, d).select("row_id", "text", "url"), "vesper_edu_fr", "text")


@query("SELECT doc_id, (k - 1) // 64 AS batch, count(*) OVER (PARTITION BY (k - 1) // 64) AS batch_size FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents)")
def fixed_batches(spark, d):
    """Batches of 64 documents in order, the last one shorter."""
    return windows.batches(_docs(spark, d).select("doc_id"), "doc_id", 64)


@query("SELECT sample_id, i AS pos, greatest(0, i - 255) AS first_seen, i - greatest(0, i - 255) + 1 AS n_seen FROM (SELECT sample_id, unnest(range(0, len(input_ids))) AS i FROM streaming_sample)")
def window_mask(spark, d):
    """Of each position the first it attends to under a causal mask with a window of 256, and how many it sees."""
    return windows.causal_window(read(spark, d, "streaming_sample"), "sample_id", "input_ids", 256)


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings")
def decode_greedy(spark, d):
    return read(spark, d, "embeddings").select("vec_id", N.greedy_token(F.col("embedding")).alias("token"))


@query(f"""WITH p AS (SELECT vec_id, i, exp(embedding[i]::DOUBLE * 3 - 3 * list_max(embedding)::DOUBLE) AS w FROM embeddings, range(1, 65) t(i)), c AS (SELECT vec_id, i, sum(w) OVER (PARTITION BY vec_id ORDER BY i) / sum(w) OVER (PARTITION BY vec_id) AS upto FROM p)
 SELECT vec_id, coalesce(min(i) FILTER (WHERE upto > {S.unit('vec_id', S.q('draw'))}), 64) - 1 AS token FROM c GROUP BY vec_id""")
def decode_sampled(spark, d):
    """One draw from each vector's softmax at temperature 1/3, by a chance hashed from its id."""
    x = F.transform("embedding", lambda v: v.cast("double") * 3)
    return read(spark, d, "embeddings").select("vec_id", N.sampled_token(x, N.hash_unit(F.col("vec_id"), F.lit("draw"))).alias("token"))


@query("SELECT name, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'str' END AS kind, try_cast(v AS DOUBLE) AS number FROM (SELECT * FROM (VALUES ('lr', '3e-4'), ('steps', '2000'), ('name', 'vingt'), ('warmup', '.5'), ('decay', '1.')) t(name, v))")
def coerce_settings(spark, d):
    """Settings whose numbers are written as text."""
    got = files.coerce_numbers({"lr": "3e-4", "steps": "2000", "name": "vingt", "warmup": ".5", "decay": "1."})
    return spark.createDataFrame([(k, type(v).__name__, None if isinstance(v, str) else float(v)) for k, v in got.items()], "name string, kind string, number double")


@query(f"SELECT doc_id, md5(coalesce(text, '')) AS h, {S.is_code('text')} AS code FROM documents")
def registered_functions(spark, d):
    """The text functions by their SQL names."""
    X.register(spark)
    _docs(spark, d).createOrReplaceTempView("_loomspark_documents")
    return spark.sql("SELECT doc_id, text_hash(text) AS h, is_code(text) AS code FROM _loomspark_documents")
