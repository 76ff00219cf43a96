"""Registered queries over small tables of hard rows, against plain loops."""

import random

import numpy as np

from loomspark.llm import leakage, repeated
from loomspark.plans import registry
from tests.llm.test_operators import edit_passage


def loop(rows, chars=None, url=True):
    """Ids kept by one pass in order: equal text, then equal raw url, then equal normalised prefix."""
    seen, kept = [set(), set(), set()], []
    for i, u, t in rows:
        t, u = t or "", u or ""
        keys = [(0, t), *([(1, u)] if url and u else []), *([(2, " ".join(t.lower().split())[:chars])] if chars else [])]
        for level, key in keys:
            if key in seen[level]:
                break
            seen[level].add(key)
        else:
            kept.append(i)
    return kept


def pages(spark, folder):
    """Different pages of one host, one url crawled twice, copies, and rows without a url."""
    text = lambda k: f"page {k} " + " ".join(random.Random(k).choices("abcdefghij", k=400))
    rows = [(k, f"https://www.site.fr/{k % 30}", text(k)) for k in range(40)]
    rows += [(40, None, text(40)), (41, "", text(41)), (42, "https://other.fr/", text(3)), (43, "http://site.fr/0", text(43))]
    spark.createDataFrame([(i, u, t, "fr") for i, u, t in rows], "row_id long, url string, text string, lang string").write.parquet(f"{folder}/vesper_edu_fr.parquet")
    return rows


def test_url_is_the_key_not_its_host(spark, tmp_path):
    rows = pages(spark, tmp_path)
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    want = loop(rows)
    assert sorted(r.row_id for r in run("dedup_url")) == want and len(want) == 33
    assert sorted(r.row_id for r in run("dedup_full")) == want
    s = run("dedup_summary")[0]
    assert (s.total, s.kept, s.exact, s.url, s.fuzzy) == (44, 33, 1, 10, 0)
    assert [r.docs for r in run("pipeline")] == [33]


def test_texts_that_open_alike_are_kept(spark, tmp_path):
    """A common title of 300 characters is no copy; 1,000 equal characters are, whatever their case and blanks."""
    title, body = "Conditions of use and privacy notice " * 8, "same words again " * 80
    rows = [(k, f"https://a.fr/{k}", title + f"text {k} " * 30) for k in range(5)]
    rows += [(5, "https://a.fr/5", body + "one end"), (6, "https://a.fr/6", body.upper().replace(" ", "  ") + "another end")]
    spark.createDataFrame([(i, u, t, "fr") for i, u, t in rows], "row_id long, url string, text string, lang string").write.parquet(f"{tmp_path}/vesper_edu_fr.parquet")
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    want = loop(rows, 1000)
    assert want == [0, 1, 2, 3, 4, 5] and loop(rows, 30) == [0, 5] and loop(rows, 200) == [0, 5]
    assert sorted(r.doc_id for r in run("dedup_fuzzy")) == want
    assert sorted(r.row_id for r in run("dedup_full")) == want
    assert run("dedup_summary")[0].fuzzy == 1 and [r.docs for r in run("pipeline")] == [6]


def leaks(q, d):
    items = leakage.Items([(1, " ".join(q))])
    code = np.array([items.number.get(w, 0) for w in d], dtype=np.int64)
    return items.candidates(code).get(0, 0) >= leakage.seeds_needed(12, 24, 10, len(q)) and leakage.compare(items.codes[0], code)[2]


def test_edited_questions_whose_parts_stand_twice():
    q = [f"w{i}" for i in range(30)]
    edited = [*q[:6], "x", *q[7:18], "y", *q[19:]]
    assert leaks(q, [*q[:11], "elsewhere", *edited])
    assert leaks(q, [*edited, "elsewhere", *q[:11]])
    short = q[:24]
    assert leaks(short, [*short[:2], "x", *short[3:12], "y", *short[13:]])
    rng = random.Random(195)
    found = 0
    for _ in range(80):
        q = [f"w{i}" for i in rng.sample(range(300), rng.choice([24, 27, 30, 34]))]
        part = list(q)
        for _ in range(rng.choice([2, 3, 4])):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([["zz"], [], [part[k], "yy"]])
        d = []
        for _ in range(rng.choice([1, 2])):
            s = rng.randrange(len(q) - 6)
            d += [*q[s : s + rng.choice([6, 9, 11])], "aa"]
        d = [*d, *part, "bb"] if rng.random() < 0.5 else [*part, "bb", *d]
        run = any(q[i : i + 12] == d[j : j + 12] for i in range(len(q) - 11) for j in range(len(d) - 11))
        want = run or edit_passage(q, d)
        assert leaks(q, d) == want, (q, d)
        found += want and not run
    assert found


def linked_lines(rows, near, least=4, percent=5):
    """Brute force: (id, line) of lines linked over a site's other lines at least `near` alike, rows summed per linked cluster."""
    by_site, out = {}, set()
    for i, text, url in rows:
        by_site.setdefault(url.split("/")[2], []).append((i, text.split("\n")))
    for docs in by_site.values():
        rows_of = {}
        for i, lines in docs:
            for line in lines:
                rows_of.setdefault(line, set()).add(i)
        runs = {x: {tuple(x.split()[k : k + 5]) for k in range(max(1, len(x.split()) - 4))} for x in rows_of}
        left = set(rows_of)
        while left:
            todo, cluster = [left.pop()], []
            while todo:
                cluster.append(x := todo.pop())
                linked = {y for y in left if len(runs[x] & runs[y]) >= near * len(runs[x] | runs[y])}
                left -= linked
                todo += linked
            n = sum(len(rows_of[x]) for x in cluster)
            if n >= least and n * 100 >= percent * len(docs):
                out |= {(i, k) for i, lines in docs for k, line in enumerate(lines) if line in cluster}
    return out


def test_near_lines_are_linked_before_rows_are_counted(spark):
    """Four variants that stand once each, and chains of which the ends are unlike each other."""
    rng = random.Random(216)
    word = lambda: "".join(rng.choices("bcdfghklmnprstvz", k=6))
    rows = []
    for s in range(40):
        base = [word() for _ in range(24)]
        if s % 2:
            variants = [" ".join([*base[:22], word(), base[23]]) for _ in range(4)]
        else:  # each is two words further along the same text
            more = base + [word() for _ in range(6)]
            variants = [" ".join(more[2 * k : 2 * k + 24]) for k in range(4)]
        rows += [(s * 10 + k, "\n".join([*variants[k : k + 1], " ".join(word() for _ in range(9))]), f"https://s{s}.test/{k}") for k in range(10)]
    want = linked_lines(rows, 0.8)
    found = repeated.repeated_lines(spark.createDataFrame(rows, "row_id long, text string, url string"), near=0.8).collect()
    got = {(r.row_id, r.line_no) for r in found}
    print("recall", len(got & want), "of", len(want))
    assert len(want) == 160 and not got - want and len(got) >= 0.85 * len(want)
    assert {r.rows for r in found} == {4}


def test_texts_with_formulas_are_restored(spark, tmp_path):
    texts = ["plain text", "Soit $x^2$ et $$a+b$$ fin", r"par \(n!\) et \[k\] ou \frac{1}{2}", "prix 5 $", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in registry.queries()["restore_math"](spark, str(tmp_path)).collect()}
    assert {k: "".join(t.split()) for k, t in got.items()} == {k: "".join(t.split()) for k, t in enumerate(texts) if t is not None}
