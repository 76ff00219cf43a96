"""Sinks, tokenizers, logs and rewritten operators against plain loops."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import dedup, ordering, sampling, series, windows
from loomspark.runtime import join_checked, materialize, shared_dir, small
from loomspark.sources import files

tokenizers = pytest.importorskip("public_tokenizers")


def test_formulas_like_one_pattern_after_the_other():
    patterns, rng = [re.compile(p) for p in X.MATH_SPANS], random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["$", "$$", "\\[", "\\]", "\\(", "\\)", "\\boxed{", "}", "{", "a", "b ", "\n", "x"]) for _ in range(rng.randrange(0, 16)))
        held, now = [], t
        for p in patterns:
            pieces, at = [], 0
            for m in p.finditer(now):
                pieces += [now[at : m.start()], f" __MATH_{len(held)}__ "]
                held.append(m.group())
                at = m.end()
            now = "".join(pieces) + now[at:]
        table = X._span_table(t)
        assert X._with_placeholders(t, 0, len(t), table) == now
        assert [X._with_placeholders(t, a, b, [q for q in table[:i] if a <= q[0] and q[1] <= b]) for a, b, i in table] == held


def test_controller_in_parts_like_at_once():
    rng = np.random.default_rng(3)
    for steps in (300, 3000, 20_000):
        loss = np.exp(np.cumsum(rng.normal(0, 0.001, 2500))) * 3 + rng.normal(0, 0.001, 2500)
        loss[rng.integers(0, 2500, 30)] = np.nan
        whole = series.control(steps, 50_257)(loss)
        part = series.control(steps, 50_257)
        for a in range(0, 2500, 97):
            got = part(loss[a : a + 97])
            for k in ("lr_scale", "momentum_scale"):
                assert np.allclose(got[k], whole[k][a : a + 97], atol=1e-12)
        assert whole["lr_scale"].max() <= 1.43 + 1e-9 and whole["lr_scale"].min() >= 0.9 - 1e-9
    # momentum follows its goal by a fiftieth a step: a loss at four fifths of the entropy asks for 1, one at a fifth for 0.8
    low = series.control(1000, 50_257)(np.full(40, 0.2 * math.log(50_257)))
    assert abs(low["momentum_scale"][0] - 0.98) < 1e-9 and abs(low["momentum_scale"][-1] - 0.8) < 1e-6


def test_numbers_and_previous_rows_over_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, float(rng.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    got = {r.i: r.p for r in ordering.with_previous(df, "s", ["i"], F.col("v"), "p", per_range=30).collect()}
    last: dict = {}
    for s, i, v in rows:
        assert got[i] == last.get(s)
        last[s] = v
    count: dict = {}
    numbers = {r.i: r.n for r in ordering.numbered(df, "s", ["i"]).collect()}
    for s, i, _ in rows:
        assert numbers[i] == count.get(s, 0)
        count[s] = count.get(s, 0) + 1
    assert ordering.with_previous(df.limit(0), "s", ["i"], F.col("v"), "p").count() == 0


def test_guard_in_batches(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([1.0, 1.1, 2.5, None]), rng.choice([None, 1.0, 500.0])) for s in ("a", "b", "c") for i in range(60)]
    df = spark.createDataFrame(rows, "s string, i long, v double, g double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.s, r.i): (r.skipped, r.rollback) for r in series.guarded(df, "s", ["i"], "v", "g", after=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state: dict = {}
    for s, i, v, g in rows:
        prev, streak, step = state.get(s, (None, 0, 0))
        skip = v is None or (g or 0) > 100 or prev is not None and step > 3 and v > 1.5 * prev
        streak = streak + 1 if skip else 0
        assert got[s, i] == (skip, streak == 10)
        state[s] = (prev if skip else v, 0 if streak == 10 else streak, step + (not skip))


def test_near_pairs_like_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(4, 260))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(4):
            t = list(b)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [texts[0], None, "", "un deux"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    sets: dict = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        g = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        if g:
            sets.setdefault(g, []).append(i)
    want = {(min(sets[a]), min(sets[b])): len(a & b) / len(a | b) for a in sets for b in sets if min(sets[a]) < min(sets[b]) and len(a & b) / len(a | b) >= 0.8}
    got = {(r.a, r.b): r.jaccard for r in dedup.near_pairs(df, "i", least=0.8, equal=True).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r["i"]: r["class"] for r in dedup.gram_classes(df, "i").collect()} == {i: min(m) for m in sets.values() for i in m}
    assert dedup.near_pairs(df.limit(0), "i", least=0.8, equal=True).count() == 0


def test_interleave_ends_when_the_last_source_does(spark):
    sizes, weights = {"a": 5, "b": 40, "c": 0}, [("a", 9.0), ("b", 1.0), ("c", 3.0)]
    rows = sampling.interleave_all(spark, weights, sizes).orderBy("draw").collect()
    assert {r.source for r in rows} == {"a", "b"} and rows[-1].source == "b" and rows[-1].k == 40 and [r.draw for r in rows] == list(range(len(rows)))
    first = sampling.interleave_all(spark, weights, sizes, "first_exhausted").orderBy("draw").collect()
    assert first[-1].source == "a" and first[-1].k == 5
    assert sampling.interleave_all(spark, [], {}).count() == 0


def test_logs_that_go_on(spark, tmp_path):
    schema = "step long, loss double"
    log = lambda rows: spark.createDataFrame(rows, schema)
    path = f"file://{tmp_path}/log"
    files.append_metrics(log([(i, 1.0) for i in range(10)]), path, "step")
    files.append_metrics(log([(i, 2.0) for i in range(4, 9)]), path, "step", resume=5)
    files.append_metrics(log([(i, 3.0) for i in range(9)]), path, "step", resume=7)
    got = {r.step: r.loss for r in files.read_metrics(spark, path, "step", log([]).schema).collect()}
    assert got == {**{i: 1.0 for i in range(6)}, 6: 2.0, 7: 2.0, 8: 3.0}


def test_tokenizer_files(spark):
    assert files.model_type(tokenizers.path("byte_bpe_50k.json")) == "bpe" and files.model_type(tokenizers.path("piece_bpe_32k.model")) == "spm-bpe"
    df = spark.createDataFrame([(1, "L'été <|endoftext|>"), (2, None), (3, "")], "i long, text string")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        encode = files.encoder_of(tokenizers.path(name))
        got = {r.i: r.ids for r in files.tokenized(df, "i", "text", tokenizers.path(name), eos=7).collect()}
        assert got == {1: encode(["L'été <|endoftext|>"])[0] + [7], 2: [7], 3: [7]}


def test_token_records(spark, tmp_path):
    df = spark.createDataFrame([(1, [5, 70_000]), (2, []), (3, None)], "i long, ids array<long>")
    files.write_token_table(df, "i", "ids", f"file://{tmp_path}/t", 100_000)
    assert {r.i: r.ids for r in files.scan_token_table(spark, f"file://{tmp_path}/t", "i").collect()} == {1: [5, 70_000], 2: [], 3: None}
    assert json.loads((next((tmp_path / "t/meta").glob("part-*"))).read_text())["n_tokens"] == 2


def test_settings():
    assert files.coerce_numbers({"a": {"b": ["1e-4", "x", "12", "-3.", True]}, "c": "1e", "d": None}) == {"a": {"b": [1e-4, "x", 12, -3.0, True]}, "c": "1e", "d": None}


def test_batches_and_windows(spark):
    df = spark.createDataFrame([(i * 3, list(range(i))) for i in range(7)], "i long, ids array<long>")
    assert [(r.batch, r.batch_size) for r in windows.batches(df.select("i"), "i", 3).orderBy("i").collect()] == [(0, 3)] * 3 + [(1, 3)] * 3 + [(2, 1)]
    got = {(r.i, r.pos): (r.first_seen, r.n_seen) for r in windows.causal_window(df, "i", "ids", 3).collect()}
    assert got == {(i * 3, p): (max(0, p - 2), min(3, p + 1)) for i in range(7) for p in range(i)}


def test_sides_are_broadcast_by_size(spark):
    df = materialize(spark.range(1000))
    assert small(df) and not small(df, limit=999) and not small(df, most=10)
    assert join_checked(spark.range(10), spark.range(5), ["id"]).count() == 5 and shared_dir(spark)
