"""The library's own operators against plain loops over small tables, and every query against its SQL on the smallest tables."""

import hashlib
import math
import random
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import numbers as N
from loomspark.functions import text as X
from loomspark.functions.urls import host_of, site_of
from loomspark.operators import audit, dedup, filters, sampling, series, windows
from loomspark.operators.ordering import running
from loomspark.plans import registry
from loomspark.sources import files

SMALL = "/root/testdata/sf0.001"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_sites(spark):
    cases = {
        "https://www.Foo-Bar.example/a?b": "foo-bar.example", "  HTTP://u:p@cours.foo.test:8080/x ": "foo.test", "//a.b.invalid.": "b.invalid", "foo.test/x/y": "foo.test",
        "https://écolemarine.invalid/": "xn--colemarine-96a.invalid", "https://xn--colemarine-96a.invalid": "xn--colemarine-96a.invalid", "mailto:redaction": None, "about:blank": None,
        "/chemin/seul.html": None, "": None, None: None, "n/a": None, "fichier local": None, "http:///sans/hote": None, "http://intranet/x": "intranet", "foo.test:80": "foo.test", "http://[bad": None,
    }
    assert column(spark, list(cases), site_of) == list(cases.values())
    assert column(spark, ["https://a.b.c.test."], host_of) == ["a.b.c.test"]


def test_text_functions(spark):
    texts = ["a b c\x1cd  ", "", None, "LÉGALES x"]
    assert column(spark, texts, lambda c: X.prepare(c, 3)) == ["a b c", "", "", "LÉGALES x"]
    assert column(spark, ["MENTIONS LÉGALES", "accepter les\ncookies", "accepter les cookies", "x" * 2000 + "powered by", None], X.boilerplate_score) == [1, 0, 1, 0, 0]
    code = ["import a\ndef f():\n  return 1", "class x\n" + "a\n" * 9, "def f\ndef g\ndef h\n" + "x\n" * 6 + "x", "", None]
    assert column(spark, code, X.is_code) == [True, False, False, False, False]
    urls = ["http://www.a.www.b.test:80/x", "//u@h/p", "mailto:x", "", None, "ftp://x"]
    assert column(spark, urls, X.authority) == [urlparse(u or "").netloc.replace("www.", "") for u in urls]
    assert column(spark, ["a b c d e f", "a b c d", None, "A a a a a a a"], lambda c: X.ngrams(c)) == [["a b c d e", "b c d e f"], [], [], ["a a a a a"]]
    replies = ['ok {"coherence": 3, "pedagogy": 2.9, "linguistic": 0, "depth": 5, "factuality": 1} {"x": 1}', '{"coherence": 6, "pedagogy": 2, "linguistic": 0, "depth": 5, "factuality": 1}', '{"coherence": 1}', "none", None, "{bad"]
    assert [r and r["total"] for r in column(spark, replies, lambda c: X.parse_scores(c))] == [11, None, None, None, None, None]
    assert [tuple(r) for r in column(spark, ["x #### 4 ", "a #### b #### c", "no", None], X.split_answer)] == [("x", "4"), ("a #### b", "c"), ("no", ""), ("", "")]


def test_spans_round_trip(spark):
    texts = ["a $x^2$ b $$y$$ \\(z\\) \\[w\\] \\boxed{4} $open", " ".join(f"${i}$" for i in range(12)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    p = df.select("i", X.protect_spans_udf()("t").alias("p")).select("i", "p.spans", X.restore_spans(F.col("p.text"), F.col("p.spans")).alias("t"), F.col("p.text").alias("held"))
    got = {r.i: r for r in p.collect()}
    assert "$" not in got[0].held.replace("$open", "") and len(got[1].spans) == 12
    assert [" ".join(got[i].t.split()) if got[i].t is not None else None for i in range(4)] == [" ".join(t.split()) if t is not None else None for t in texts]


def test_numbers(spark):
    assert column(spark, ["1.3B", "350M", "64k", "1_300_000_000", "garbage", None], N.parse_size) == [1_300_000_000, 350_000_000, 64_000, 1_300_000_000, None, None]
    assert column(spark, [1_300_000_000, 350_000_000, 64_000, 12], N.format_size, "long") == ["1.30B", "350.0M", "64.0K", "12"]
    assert column(spark, [1000, 65535, 65536], N.token_dtype, "int") == ["uint16", "uint16", "uint32"]
    dist = column(spark, [[0.2, 0.5, 0.9]], N.halt_distribution, "array<double>")[0]
    assert abs(sum(dist) - 1) < 1e-9 and abs(dist[1] - 0.4) < 1e-6 and abs(dist[2] - 0.4) < 1e-6


@pytest.mark.parametrize("n", [30, 1000])
def test_dedup_like_a_loop(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["alpha " * 8 + str(rng.randrange(6)), "beta", "", None, "Beta "]), rng.choice(["", "u1", "u2", "u3", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, text string, url string").repartition(4)
    seen, kept, levels = [set(), set(), set()], [], {}
    for i, t, u in rows:
        t, u = t or "", u or ""
        for level, name, key in ((0, "exact", t), (1, "url", u), (2, "fuzzy", " ".join(t.lower().split())[:n])):
            if level == 1 and not u:
                continue
            if key in seen[level]:
                levels[i] = name
                break
            seen[level].add(key)
        else:
            levels[i] = "kept"
            kept.append(i)
    got = sorted(r.seq for r in dedup.dedup(df, "seq", url=F.col("url"), fuzzy_chars=n).collect())
    assert got == kept
    assert {r.seq: r.level for r in dedup.dedup_levels(df, "seq", url=F.col("url"), fuzzy_chars=n).collect()} == levels


def test_near_pairs_like_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(12)]
    texts = [t if rng.random() < 0.4 else " ".join(w if rng.random() < 0.95 else "z" for w in t.split()) for t in base * 4] + ["a b", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4))

    classes: dict = {}
    for i, t in enumerate(texts):
        if grams(t):
            classes.setdefault(grams(t), []).append(i)
    reps = {v[0]: k for k, v in classes.items()}
    want = {(a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) > 0.5}
    assert {(r.a, r.b) for r in dedup.near_pairs(df, "id").collect()} == want and want


def test_running_totals_over_ranges(spark):
    rows = [(i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    got = {r.i: (r["rank"], r.s) for r in running(df, ["i"], {"s": F.col("v")}, per_range=60).collect()}
    total = 0
    for i, v in rows:
        assert got[i] == (i + 1, total)
        total += v


def test_packing_like_a_loop(spark):
    docs = [[1] * 5, [], None, [2] * 9, [3], [4] * 20]
    df = spark.createDataFrame(list(enumerate(docs)), "i long, ids array<bigint>")
    for length in (3, 7, 40):
        flat = [t for d in docs for t in [*(d or []), 0]]
        want = []
        for s in range(0, len(flat), length + 1):
            c = flat[s : s + length + 1]
            if len(c) >= 2:
                c += [0] * (length + 1 - len(c))
                want.append((c[:-1], c[1:]))
        got = [(r.input_ids, r.targets) for r in windows.pack_stream(df, "i", "ids", length, 0).orderBy("chunk").collect()]
        assert got == want
    w = windows.strided_windows(spark.createDataFrame([(1, list(range(11))), (2, list(range(5))), (3, [1])], "i long, ids array<bigint>"), "i", "ids", 4, 3).orderBy("i", "window").collect()
    assert [(r.i, r.start) for r in w] == [(1, 0), (1, 3), (1, 6), (2, 0)]


def test_budget_split_like_a_loop(spark):
    sizes = [7, 3, 12, 1, 1, 9, 4, 30, 2]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    for target, ratio in ((30, 0.5), (1000, 0.1), (10, 0.9)):
        total, want, val, train = 0, {}, False, int(target * (1 - ratio))
        for i, n in enumerate(sizes):
            if total >= target:
                break
            want[i] = "val" if val else "train"
            val = val or total >= train
            total += n
        got = {r.i: r.split for r in windows.budget_split(df, "i", F.col("n"), target, ratio).collect()}
        assert got == want


def test_series(spark):
    rows = [("a", i, 2.0 + math.sin(i)) for i in range(50)] + [("b", 0, None), ("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    got = {(r.s, r.i): r.ema for r in series.moving_log_loss(df, "s", ["i"], F.col("v"), 10, chunk=7).collect()}
    e = None
    for s, i, v in rows[:50]:
        e = math.log(v) if e is None else e + 2 / 11 * (math.log(v) - e)
        assert abs(got[s, i] - e) < 1e-9
    assert abs(got["b", 1]) < 1e-12
    g = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0, None, 1.2])], "s string, i long, v double")
    assert [r.skipped for r in series.guarded(g, "s", ["i"], "v", after=2).orderBy("i").collect()] == [False, False, False, True, True, False]
    c = series.Controller(20_000, 50_257)
    scales = [c.update(3.0 * math.exp(-k / 500) + 2, k) for k in range(3000)]
    assert all(0.7 <= m <= 1.3 and 0.9 <= s <= 1.43 for s, m in scales)


def test_filters_and_reports(spark):
    df = spark.createDataFrame([(1, 0.65, 0.9), (2, 0.64, 0.9), (3, None, None)], "i int, a double, b double")
    f = filters.keep_by_dimensions({"a": F.col("a"), "b": F.col("b")}, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    assert [r.keep for r in df.select("i", *[c.alias(k) for k, c in f.items()]).orderBy("i").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        filters.keep_by_dimensions({}, F.array())
    s = audit.nearest_ranks(spark.createDataFrame([(x,) for x in [5, 1, 9, 9, 2, None]], "v int"), F.col("v"), {"median": 0.5, "p90": 0.9}).first()
    assert (s.n, s.min, s.max, s.median, s.p90) == (5, 1, 9, 5, 9)
    assert audit.nearest_ranks(df.limit(0), F.col("i"), {"m": 0.5}).first().n == 0
    assert sum(r.n for r in audit.length_buckets(df, F.lit(600)).collect()) == 3
    assert sampling.sample(df, "i", 10).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"text": "x", "url": "u"}\n\n  \n{bad\n[1]\n3\n{"url": null}\n{"text": "\xff"}\n')
    rows = files.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "text string, url string").collect()
    assert len(rows) == 6 and sum(r.bad for r in rows) == 3 and rows[0].text == "x"
    (tmp_path / "t.txt").write_text("a\n\n  b \n \n")
    assert [r.text for r in files.scan_txt(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]
    for spec, want in {"p:n:train#content@2.5": ("p", "n", "train", "content", 2.5), "p:train": ("p", None, "train", "text", 1.0), "p::s": ("p", None, "s", "text", 1.0)}.items():
        s = files.parse_spec(spec)
        assert (s.path, s.name, s.split, s.text_field, s.weight) == want
        row = spark.createDataFrame([(spec,)], "s string").select(*[c.alias(k) for k, c in files.spec_columns(F.col("s")).items()]).first()
        assert tuple(row) == want
    with pytest.raises(ValueError):
        files.parse_spec("a:b:c:d")
    tokens = spark.createDataFrame([(2, [5, 6]), (1, [70000]), (3, None)], "i int, ids array<bigint>")
    (tmp_path / "bin").mkdir()
    meta = files.write_tokens(tokens, "i", "ids", str(tmp_path / "bin/t.bin"), 100_000)
    assert meta["dtype"] == "uint32" and files.read_token_meta(str(tmp_path / "bin/t.bin")) == meta and files.read_token_meta("none")["version"] == 0
    assert files.scan_tokens(spark, f"file://{tmp_path}/bin").first().ids == [70000, 5, 6]
    files.write_shards(spark.range(25).coalesce(1), str(tmp_path / "shards"), 10)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 3


def rows(df: pd.DataFrame) -> list[str]:
    from tests.verify import rows as shown

    return shown(df)


QUICK = [n for n in registry.oracle_sql() if n not in ("near_dup_pairs", "jaccard", "ngram_fingerprint", "stream_windows")]


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    got, want = registry.queries()[name](spark, SMALL).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_hash_unit_is_md5(spark):
    u = column(spark, ["7"], lambda c: N.hash_unit(c, F.lit("mix")))[0]
    assert u == int(hashlib.md5(b"7-mix").hexdigest()[:8], 16) / 2**32
