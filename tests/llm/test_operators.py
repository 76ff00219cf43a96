"""The operators for training data against brute force, round trips and held-out labels, with nulls, ties, copies, empty tables and clashing names."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.urls import site_of
from loomspark.llm import boilerplate, bpe, budget, capping, leakage, mixing, packing, queries, repeated, sentences, textstats
from loomspark.llm.boilerplate_labels import pages
from loomspark.llm.blocks import page_features
from loomspark.llm.tree import Forest

from . import blind_pages


def brute_bpe(enc: bpe.ByteBPE, word: str) -> list[int]:
    parts = [bytes([b]) for b in word.encode()]
    while True:
        found = [(enc.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in enc.ranks]
        if not found:
            return [enc.ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_encoding_equals_exact_merging():
    enc = bpe.ByteBPE(bpe.default_vocabulary())
    rng = random.Random(1)
    words = ["".join(rng.choice("aabcdeinorst' éàœ你好🙂\n\t0123<|>") for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    for text in [*words, " l'été  où\r\n\r\nl’on  va…", "<|endoftext|>", "a" * 5000]:
        got = enc.encode(text)
        assert got == [t for w in enc.split(text) for t in brute_bpe(enc, w)]
        assert b"".join(enc.token[t] for t in got).decode() == text
    assert enc.exact_words > 0


def test_many_distinct_words_after_a_warm_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1000)
    enc = bpe.ByteBPE(bpe.default_vocabulary())
    enc.lists(["un deux trois " + " ".join(map(str, range(990)))])
    texts = ["un deux " + " ".join(str(i * 7919) for i in range(12_500)), None, "un deux trois"]
    for _ in range(3):
        for text, got in zip(texts, enc.lists(texts)):
            assert list(map(list, got)) == [brute_bpe(enc, w) for w in enc.split(text or "")]
    assert 0 < enc.exact_words < enc.all_words


def test_compatible_pairs_like_merging():
    enc = bpe.ByteBPE(bpe.default_vocabulary())
    rng = random.Random(5)
    some = [t for t in rng.sample(sorted(enc.token), 1500)] + sorted(enc.token)[:700]
    pairs = [(rng.choice(some), rng.choice(some)) for _ in range(6000)] + [(t, t) for t in some]
    pairs += [tuple(enc.ranks[x] for x in (w[:k], w[k:])) for t in some if len(w := enc.token[t]) > 1 for k in range(1, len(w)) if w[:k] in enc.ranks and w[k:] in enc.ranks]
    first, second = (np.array(c, dtype=np.int64) for c in zip(*pairs))
    want = [enc.merge(enc.token[a] + enc.token[b]) == [a, b] for a, b in pairs]
    assert enc.compatible(first, second).tolist() == want and 0 < sum(want) < len(want)


def test_encoding_of_a_table(spark):
    rows = [(1, "été", "x"), (1, "été", "y"), (None, "a", None), (3, None, None), (4, "", None), (5, "mot " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column named like the result
    out = bpe.encode_corpus(df)
    got = [(r.doc_id, list(r.ids)) for r in out.collect()]
    enc = bpe.encoder(bpe.default_vocabulary())
    assert sorted(map(str, got)) == sorted(str((i, enc.encode(t))) for i, t, _ in rows)
    assert out.columns == ["doc_id", "ids"] and bpe.encode_corpus(df.limit(0)).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------

MODEL = [("fr", "A", a) for a in ("m", "etc", "av", "env", "vol", "p", "art", "cf", "dr")] + [("fr", "S", s) for s in ("le", "la", "l'", "vers", "il")] + [("fr", "2", "av j"), ("de", "A", "z"), ("de", "2", "z b"), ("de", "S", "der"), ("de", "A", "usw"), ("hi", "A", "डॉ"), ("en", "N", "no"), ("en", "A", "mrs")]


@pytest.mark.parametrize("units", [
    ["Selon M. Durand, le vin et la bière sont chers.", "La suite vient."],
    ["Le blé, le sel, etc. ont baissé pour le roi.", "Le blé, le sel, etc.", "Vers 200 av. J.-C., env. 3 km au nord, il vit."],
    ["« Regardez bien. Rien ne bouge », disait-on à la cour.", "« Il vient ! » s'exclama le roi.", "Il dit : « Oui. »", "Le roi rit."],
    ["(La farine est chère.)", "Le prix monte de 3.5 % pour le sel…", "Il dort ?!", "La fin.[12]", "Le roi 🙂 rit.🙂", "Il sort."],
    ["那一天，他来了。", "老师说：“好！”", "真的吗？", "约占57.7%……", "他走了"],
    ["「水位は。忘れないで」と先生は言った。", "毎朝、歩く！"],
    ["Γιατί ο δάσκαλος; ", "Το έργο."],
    ["क्या यह है?", "डॉ. तरनेल आए।", "वे गए।"],
    ["Am 21. Mai kam der Mann z. B. mit der Bahn, und die Frau usw.", "Der Mann und die Frau sind da."],
    ["He saw no. 8 of the list by Mrs. Miller.", "32 of the men left."],
])
def test_units_of_hard_cases(units):
    text = "".join(u if u[-1] in "。？！”…" and not u.isascii() and u[0] > "　" or u.startswith(("那", "老", "真", "约", "「")) else u.strip() + " " for u in units).strip()
    got = [text[a:b] for a, b in sentences.Splitter(MODEL).units(text)]
    assert got == [u.strip() for u in units]


def test_units_by_lines():
    text = "Titre\n\nIl faut pour le gâteau :\n- du sel ;\n- du\n  sucre.\n1) a\n\n \t\nLe roi\nvient. Il rit\r\n\r\nR :\n\n  "
    got = [text[a:b] for a, b in sentences.Splitter(MODEL).units(text)]
    assert got == ["Titre", "Il faut pour le gâteau :", "- du sel ;", "- du\n  sucre.", "1) a", "Le roi\nvient.", "Il rit", "R :"]
    thai = "ในฤดูหนาว ทุกเช้า\n\nบท 3"
    assert [thai[a:b] for a, b in sentences.Splitter([]).units(thai)] == ["ในฤดูหนาว", "ทุกเช้า", "บท 3"]


def test_abbreviations_are_learned(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("aeiou" if k % 2 else "bdfglmnprst") for k in range(8)).title() for _ in range(300)]
    verbs = ["voit la mer", "prend le pain", "chante dans la rue", "quitte la ville"]
    texts = [" ".join(f"Le docteur et Mgr. {rng.choice(names)} {rng.choice(verbs)} avec la foule. La nuit tombe sur le port. Il pense au vin, cf. page {rng.randrange(99)}." for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "Le roi. La reine."), (97, None), (98, " \n ")], "doc_id long, text string")
    model = sentences.boundary_model(sentences.boundary_counts(df))
    known = {(r.kind, r.key) for r in model.collect()}
    assert ("A", "mgr") in known and ("A", "cf") in known and ("S", "la") in known and not {("A", "port"), ("A", "foule")} & known
    got = sentences.split_sentences(df)
    assert got.where("doc_id = 0").count() == 18 and got.where("doc_id is null").count() == 2 and got.where("doc_id = 98").count() == 0
    assert sentences.split_sentences(df.limit(0)).count() == 0
    assert sorted(map(str, sentences.split_sentences(df, model_rows=1).collect())) == sorted(map(str, got.collect()))  # refused before, now joined


# --- 9 ---------------------------------------------------------------------------------------------------------


def edit_passage(q, d, least=24, per=10):
    """Brute force: some passage of q of at least `least` words within one edit in `per` of some run of d."""
    for i in range(len(q)):
        for j in range(i + least, len(q) + 1):
            p, most = q[i:j], (j - i) // per
            row = [0] * (len(d) + 1)  # free start in d
            for a in range(1, len(p) + 1):
                new = [a]
                for b in range(1, len(d) + 1):
                    new.append(min(row[b] + 1, new[b - 1] + 1, row[b - 1] + (p[a - 1] != d[b - 1])))
                row = new
            if min(row) <= most:
                return True
    return False


def test_leaks_like_brute_force():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(60):
        q = rng.sample(vocabulary, rng.choice([20, 30, 45]))
        part = list(q[(s := rng.randrange(0, 6)) : s + rng.choice([11, 12, 23, 24, 30, 40])])
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            k = rng.randrange(len(part))
            what = rng.randrange(3)
            part[k : k + 1] = [["zz"], [], [part[k], "yy"]][what]
        d = ["aa", "bb", *part, "cc"] * 1
        items = leakage.Items([(1, " ".join(q))])
        code = np.array([items.number.get(w, 0) for w in d], dtype=np.int64)
        longest = max((n for n in range(len(q) + 1) for i in range(len(q) - n + 1) if any(q[i : i + n] == d[j : j + n] for j in range(len(d) - n + 1))), default=0)
        want = longest >= 12 or edit_passage(q, d)
        seeds = items.candidates(code).get(0, 0)
        got = seeds >= leakage.seeds_needed(12, 24, 10, len(q)) and leakage.compare(items.codes[0], code)[2]
        assert got == want, (q, d)


def test_leaks_in_a_table(spark):
    q = "Une bergère de Favigne tond trois cents béliers et tire de chacun cinq boisseaux de laine claire"
    docs = spark.createDataFrame([(1, "x " + q.upper().replace("É", "E&#769;") + " y", 5), (1, "x " + q + " y", 5), (2, "rien", None), (3, None, None), (4, "", None), (None, q, 1), (6, "  ".join(reversed([q[:48], q[48:]])), 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, q, "a"), (7, q, "b"), (8, None, None), (9, "", None)], "item_id long, question string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items, block=1).collect()}
    assert got == {(1, 7), (None, 7)}
    assert (6, 7) in {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items, coverage=0.8).collect()}
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 == leakage.find_leaks(docs.limit(0), items).count()


# --- 4, 3 ------------------------------------------------------------------------------------------------------


def test_boilerplate_on_held_out_pages():
    marked = pages()
    hits = total = 0
    for fold in range(5):
        train = [p for k, p in enumerate(marked) if k % 5 != fold]
        x, y = [], []
        for lines, labels in train:
            numbers, f = page_features(lines)
            x += f
            y += [labels[n] for n in numbers]
        model = Forest(15, 9, 2).fit(np.array(x), np.array(y))
        for lines, labels in (p for k, p in enumerate(marked) if k % 5 == fold):
            numbers, f = page_features(lines)
            guess = model.predict(np.array(f)) > 0.5
            hits += sum(g == labels[n] for g, n in zip(guess.tolist(), numbers))
            total += len(numbers)
    assert hits / total > 0.88
    assert sum(len(x) for x, _ in marked) < 420


def test_boilerplate_on_pages_of_other_sites():
    """Pages written apart from the labelled table: most furniture is found, little else is taken."""
    found = true = both = 0
    for lines, labels in blind_pages.pages():
        ((_, numbers, flag),) = boilerplate.furniture_of(["\n".join(lines)])
        found += int(flag.sum())
        true += sum(labels)
        both += sum(labels[n] for n, f in zip(numbers, flag.tolist()) if f)
    assert both / true > 0.9 and both / found > 0.95


def test_long_lines_are_judged_like_others():
    consent = "Nous utilisons des cookies avec nos partenaires pour mesurer l'audience du site et vous proposer des publicités adaptées ; vous pouvez accepter ou refuser ces cookies, ou modifier vos préférences à tout moment dans notre politique de confidentialité."
    legal = "Tous droits réservés. Toute reproduction des textes de ce site est interdite sans l'accord écrit de l'éditeur ; les conditions générales d'utilisation et les mentions légales sont en bas de page, avec la politique de confidentialité et le plan du site."
    menu = " | ".join(f"{w} {v}" for w in "Cours Exercices Annales Fiches".split() for v in ("sixième", "cinquième", "seconde", "terminale"))
    body = "La lumière se propage en ligne droite tant que le milieu reste le même, et c'est pourquoi les ombres ont des bords nets près de l'objet qui les porte au soleil du matin."
    page = [menu, "La lumière", body, body.replace("La", "Une"), consent, legal]
    assert all(len(x.split()) >= 28 for x in (consent, legal, menu, body))
    ((_, numbers, flag),) = boilerplate.furniture_of(["\n".join(page)])
    assert [n for n, f in zip(numbers, flag.tolist()) if f] == [0, 4, 5]


def test_boilerplate_of_a_table(spark):
    body = "La lumière se propage en ligne droite tant que le milieu reste le même, et c'est pourquoi les ombres ont des bords nets près de l'objet qui les porte au soleil."
    page = f"Accueil | Cours | Contact\r\nSe connecter\n\nLa lumière\n{body}\nPublicité\n{body}\n© 2020 Le Site – Tous droits réservés"
    junk = "\n".join("u8ZDeo2RfmAt6MrScvj6tIDCFyZ5sTkOsqBZShB01Lz3GZN29hx3NhlVVj0w" for _ in range(9))
    rows = [(1, page, 0), (1, page, 0), (None, "Menu\nConnexion", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (5, junk, 0), (6, (body + "\n") * 4000 + "Partager cet article", 0)]
    df = spark.createDataFrame(rows, "row_id long, text string, line_no int")
    got = Counter((r.row_id, r.line_no) for r in boilerplate.furniture_lines(df).collect())
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, n): 2 for n in (0, 1, 5, 7)}
    assert not any(k[0] in (2, 3, 4, 5) for k in got) and (6, 4000) in got and (None, 0) in got
    main = {r.row_id: r.main for r in boilerplate.main_text(df).collect()}
    assert main[1] == f"\nLa lumière\n{body}\n{body}" and main[2] is None and main[3] == ""
    assert boilerplate.furniture_lines(df.limit(0)).count() == 0


VOCABULARY = frozenset("le la les de des du et un une est dans pour que qui sur the of and to in is der die das und".split())


def kinds(texts):
    return [textstats.verdict(s, sh, len(w))["kind"] for s, sh, w in (textstats.count_lines((t or "").split("\n"), VOCABULARY) for t in texts)]


def test_kinds_of_text():
    prose = "Le roi de la ville est dans la cour et la reine, qui est sur le pont, voit les gens du port."
    assert kinds([prose, prose.upper(), prose.lower().replace(",", "").replace(".", ""), "\n".join(prose[i : i + 40] for i in range(0, len(prose), 40)), None, " \n"]) == ["prose"] * 4 + ["empty"] * 2
    assert kinds(["\n".join(f"- {i} kg de sel de Mer" for i in range(9)), "\n".join(f"{i}h30 : salle {n}, {n[::-1].lower()}" for i, n in enumerate("Morel Petit Roux Blanc Duval Garnier Faure Henry".split())), "\n".join("Brest Rennes Nantes Vannes Redon Fougères".split())]) == ["list"] * 3
    assert kinds(["ville;sel;3,5\n" * 6, "| a | b | 3 |\n" * 5, "ville\tsel\t3\n" * 5]) == ["table"] * 3
    assert kinds(["sel sucre sel Nantes sucre sel " * 10, "[20:53:41] ERR 0xbb63 mod_b.c:642 code=270\n" * 5, "%%##@@!!((&&))--==++^^\n" * 5, "savi casekavevo gofono lekitoga covemasa rage zu vu " * 6]) == ["junk"] * 4
    assert kinds(["毎朝、港の倉庫は土の温度をはっきり示している。村の市場は弦の響きを大きく左右する。", "Il ponte spiega il suono delle corde con poche eccezioni e la cooperativa sostituisce l'ordine delle carte nel paese."]) == ["prose"] * 2


@pytest.mark.parametrize("chunk", [3, 17, 64])
def test_statistics_do_not_depend_on_cuts(spark, chunk):
    rng = random.Random(chunk)
    texts = ["Le roi de la ville est là.\n- sel fin ;\n- sel gris ;\n- sel noir ;\n- sel bleu ;\n\nLa fin…", "mot" * 40, "\n\n", "a\n" * 30, "x;y;3\n" * 9 + "Le roi", None, ""]
    texts += ["".join(rng.choice("le la;\n 3é-") for _ in range(150)) for _ in range(6)]
    rows = [(i, t, 0, "z") for i, t in enumerate(texts)] + [(0, texts[0], 1, "z"), (None, texts[4], 1, "z")]
    df = spark.createDataFrame(rows, "row_id long, text string, kind int, id string")
    whole = sorted(map(str, textstats.text_statistics(df, VOCABULARY).collect()))
    assert sorted(map(str, textstats.text_statistics(df, VOCABULARY, chunk=chunk).collect())) == whole and len(whole) == len(rows)
    assert sorted(map(str, textstats.text_statistics(df, VOCABULARY, chunk=chunk, spread=3 * chunk + 1).collect())) == whole
    assert textstats.text_statistics(df.limit(0), VOCABULARY).count() == 0


def test_junk_is_judged_by_all_lines_in_any_order():
    rng = random.Random(4)
    menu = [f"Rubrique {w} du site" for w in "un deux trois quatre".split()]
    noise = ["".join(rng.choice("#%&$@{}<>=*~^") for _ in range(30)) for _ in range(20)]
    for order in range(6):
        lines = menu + noise if not order else rng.sample(menu + noise, 24)
        assert textstats.is_junk(lines) and not textstats.is_junk(lines + [f"Une phrase de plus, numéro {i}, pour voir." for i in range(3)])
    long_menu = [f"Une phrase de plus, {a}{b}teau du port, pour voir." for a in "abcdefgh" for b in "eiouaré"]
    for lines in (long_menu + noise * 2, noise * 2 + long_menu):
        assert not textstats.is_junk(lines)
    assert textstats.is_junk(noise * 12 + long_menu) and textstats.is_junk(long_menu + noise * 12)


def test_a_row_of_cells_is_no_prose():
    row = " • ".join("le sel de la mer et du port".split() * 2 + ["u8ZDeo2RfmAt6M"] * 2)
    assert textstats.line_kind(row, textstats._PARTS.findall(row.lower()), 12) == textstats.LIST
    assert textstats.line_kind("#%& " * 40 + "le la de " * 6, ["le", "la", "de"] * 6, 18) == textstats.JUNK


# --- 6 ---------------------------------------------------------------------------------------------------------


def test_line_forms():
    same = ["Publié le 3 mai 2021 à 10h", "publie le 12 JANVIER 2019 a 9h !", "Publi&eacute; le lundi 1er décembre à", "Pu\xadblié le à — 12/03/2020"]
    assert len({repeated.form(x) for x in same}) == 1
    assert repeated.form("12/03/2020") == repeated.form("— … —") == repeated.form("le 3 mai").replace("le", "") == ""


def test_repeated_lines_like_brute_force(spark):
    rng = random.Random(6)
    menu = ["Accueil | Cours", "Lire la suite", "© {} Site", "Publié le {} mai", "Suivez notre lettre pour tout savoir des cours du soir de {}"]
    rows = []
    for i in range(260):
        site = rng.choice(["big.test", "big.test", "mid.test", "small.test", None, "one.test" if i == 5 else "mid.test"])
        lines = [m.format(rng.randrange(99)) for m in menu if rng.random() < 0.3] + [f"phrase {rng.choice('abcdefghijklmnop') * 3} unique {rng.choice('qrstuv') * 4}" for _ in range(4)]
        rng.shuffle(lines)
        rows.append((i, None if i % 40 == 0 else "\n".join([*lines, *lines[:1]]), site and f"https://www.{site}/p{i}", 0, "x"))
    rows += rows[:5] + [(None, "Accueil | Cours", "https://big.test/", 0, "x")]
    df = spark.createDataFrame(rows, "row_id long, text string, url string, line_no int, site string")
    site = {r.url: r.s for r in df.select("url", site_of(F.col("url")).alias("s")).distinct().collect()}
    n, seen, lines = Counter(), Counter(), []
    for i, t, u, *_ in rows:
        if site[u] is None:
            continue
        n[site[u]] += 1
        forms = [(k, repeated.form(x)) for k, x in enumerate((t or "").split("\n"))]
        for f in {f for _, f in forms if f}:
            seen[site[u], f] += 1
        lines += [(i, k, site[u], f) for k, f in forms if f]
    want = Counter((i, k) for i, k, s, f in lines if seen[s, f] >= 4 and seen[s, f] * 20 >= n[s])
    got = repeated.repeated_lines(df)
    assert Counter((r.row_id, r.line_no) for r in got.collect()) == want and want
    near = Counter((r.row_id, r.line_no) for r in repeated.repeated_lines(df, near=0.8).collect())
    assert not want - near
    clean = {r.row_id: r.text for r in repeated.without_repeated_lines(df.where("row_id > 5"), got).collect()}
    t = dict((r[0], r[1]) for r in rows if r[0] and r[0] > 5)
    assert all(clean[i] == (None if t[i] is None else "\n".join(x for k, x in enumerate(t[i].split("\n")) if (i, k) not in want)) for i in clean)
    assert repeated.repeated_lines(df.limit(0)).count() == 0


def test_repeated_lines_come_out_of_clusters(spark, tmp_path):
    """Lines alike but for a name are one cluster; rows are counted once for each, and only forms in enough rows of their own are found."""
    notice = "Merci de lire les cours du soir de {} avant de venir en salle et de noter chaque point utile dans le carnet de bord"
    rows = [(i, notice.format("Aline" if i < 6 else "Berthe" if i < 12 else f"C{'abcdefgh'[i - 12] * 3}"), "https://a.test/") for i in range(20)]
    rows += [(20 + i, f"phrase {c * 4} seule", "https://b.test/") for i, c in enumerate("abcdefghij")]
    rows[20] = (20, "\n".join(notice.format(n) for n in ("Aline", "Berthe", "Claire", "Denise", "Emma")), "https://b.test/")  # one row alone
    df = spark.createDataFrame(rows, "row_id long, text string, url string")
    found = repeated.repeated_lines(df).collect()
    assert {(r.row_id, r.line_no) for r in found} == {(i, 0) for i in range(12)} and {r.rows for r in found} == {6}
    assert len({r.cluster for r in found}) == 1
    near = repeated.repeated_lines(df, near=0.8).collect()
    assert {(r.row_id, r.line_no) for r in near} == {(i, 0) for i in range(20)} and {r.rows for r in near} == {20}
    assert {r.cluster for r in near} == {r.cluster for r in found}
    df.write.parquet(f"{tmp_path}/vesper_edu_fr.parquet")
    assert {tuple(r) for r in queries.queries()["p6_found"](spark, str(tmp_path)).collect()} == {(i, 0) for i in range(12)}


def test_repeated_lines_are_linked_from_forms_in_enough_rows_on(spark, monkeypatch):
    """Texts are compared for clusters with such a form only, over all forms of these; labels are those of all clusters."""
    rng = random.Random(63)
    word = lambda: "".join(rng.choices("bcdfghklmnprstvz", k=6))
    more = [word() for _ in range(32)]
    chain = [" ".join(more[2 * k : 2 * k + 24]) for k in range(5)]  # its ends are unlike, and only they stand in enough rows
    rows = [(i, chain[0 if i < 6 else 4 if i < 12 else min(i - 11, 3)] if i < 15 else word(), "https://a.test/") for i in range(40)]
    notice = "Merci de lire les cours du soir de {} avant de venir en salle et de noter chaque point utile dans le carnet de bord"
    rows += [(40 + i, notice.format(word().capitalize()), "https://b.test/") for i in range(30)]  # enough rows together, one each
    df = spark.createDataFrame(rows, "row_id long, text string, url string")
    tables, write = {}, repeated.materialize

    def kept(table, name):
        tables[name] = write(table, name)
        return tables[name]

    monkeypatch.setattr(repeated, "materialize", kept)
    found = {(r.row_id, r.line_no): (r.cluster, r.rows) for r in repeated.repeated_lines(df).collect()}
    assert set(found) == {(i, 0) for i in range(12)} and {n for _, n in found.values()} == {6}
    assert tables["runs"].count() == len(chain)
    near = {(r.row_id, r.line_no): r.cluster for r in repeated.repeated_lines(df, near=0.8).collect()}
    assert set(near) == {(i, 0) for i in [*range(15), *range(40, 70)]} and tables["runs"].count() == len(chain) + 30
    assert len({c for c, _ in found.values()}) == 1 and all(near[k] == c for k, (c, _) in found.items())


def test_codes_of_a_line_like_its_words():
    rng = random.Random(64)
    parts = ["a", "É", "e\u0301", "\u0301", "\u00ad", "\u200b", "&eacute;", "&nbsp;", "&#10;", "&shy;", "&", "_", "'", " ", " ", " ", "\u00a0", "\u2028", "\x1c", "\r", "1", "½", "Ⅳ", "ß", "ŉ", "ﬁ", "İ", "ǅ"]
    parts += ["mai", "Mai", " jan ", "sept", "SEPT", "er", "3mai", "12", "A", "BC", "d", "中文", "ก้", "´", "٣", " 3 ", "."]
    for _ in range(5000):
        line = "".join(rng.choices(parts, k=rng.randrange(1, 40)))
        out, low = repeated._words(repeated._clean(line))
        codes = [repeated.xxhash.xxh3_64_intdigest(w) for w in repeated.masked(out, low)] if low else []
        assert repeated.line_codes(line) == (repeated.form(line), codes), repr(line)


def test_components_of_few_and_of_many_links(spark):
    rng = random.Random(61)
    pairs = {(f"s{rng.randrange(3)}", rng.randrange(60), rng.randrange(60)) for _ in range(110)} | {("chain", k, k + 1) for k in range(40)}
    rows = [(s, bytes([x]), bytes([y])) for s, a, b in pairs if a != b for x, y in ((a, b), (b, a))]
    links = repeated.materialize(spark.createDataFrame(rows, "site string, set binary, other binary"), "links")
    few, many = ({tuple(map(str, r)) for r in repeated._components(links, n).collect()} for n in (1000, 0))
    assert few == many and len(few) == len({r[:2] for r in rows}) and len({r[2] for r in few if r[0] == "chain"}) == 1


# --- 1 ---------------------------------------------------------------------------------------------------------


def test_water_level():
    rng = random.Random(2)
    for _ in range(300):
        counts = [rng.choice([1, 2, 5, 40, 200, 900]) for _ in range(rng.randrange(1, 40))]
        s = Fraction(rng.choice(["0.5", "0.2", "0.05", "0.34"]))
        c = capping.water_fill(sorted(counts, reverse=True)[: int(1 / s) + 2], sum(counts), s)
        if c is None:
            assert max(counts) <= s * sum(counts)
            continue
        fits = [k for k in range(1, max(counts) + 1) if k <= s * sum(min(n, k) for n in counts)]
        assert c == (max(fits) if fits else 1)


@pytest.mark.parametrize("few", [True, False])
def test_caps_like_brute_force(spark, few):
    rng = random.Random(few)
    rows = [(None if rng.random() < 0.02 else rng.randrange(-10**12, 10**12) if rng.random() < 0.9 else 7, rng.choice([None, "a", "a", "a", "b", "c", "d"]), rng.choice([None, 0, 1, 3, 5, 5, 9, -1]), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id long, site string, pedagogy int, kept int")
    for cap in (1, 37, 300, 5000):
        out = capping.cap_contributors(df.withColumnRenamed("kept", "n"), F.col("site"), F.col("pedagogy"), "row_id", max_count=cap)
        got = {r.n: r.kept for r in out.collect()}
        rank = lambda r: (5 - r[2] if r[2] is not None and 0 <= r[2] <= 5 else 6, 2**63 - 1 if r[0] is None else r[0])
        for site in "abcd":
            mine = sorted((r for r in rows if r[1] == site), key=rank)
            assert sum(got[r[3]] for r in mine) == min(cap, len(mine))
            edge = rank(mine[min(cap, len(mine)) - 1])
            assert all(got[r[3]] == (rank(r) < edge) for r in mine if rank(r) != edge) or cap >= len(mine)
        assert all(got[r[3]] for r in rows if r[1] is None) and len(got) == len(rows)
    assert capping.cap_contributors(df.limit(0), F.col("site"), F.col("pedagogy"), "row_id", of_input=0.02).count() == 0


def test_kth_smallest(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(-(2**60), 2**60)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v long")
    want = {g: sorted(v for a, v in rows if a == g)[k - 1] for g, k in (("a", 1), ("b", 77))}
    assert capping.kth_smallest(df, "g", "v", {"a": 1, "b": 77}, buckets=16) == want


# --- 2 ---------------------------------------------------------------------------------------------------------


def test_budget_by_deltas(spark):
    enc = bpe.encoder(bpe.default_vocabulary())
    old = [(1, "le roi", "s", "fr"), (2, "la reine dort", "s", "FR"), (3, "the king", "t", "eng"), (4, None, None, None), (5, "le roi", "t", "fr")]
    new = [old[0], (2, "la reine", "s", "FR"), old[3], old[4], (6, "", "u", " "), (6, "", "u", " ")]

    def docs(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
        return budget.documents_of(df, "doc_id", F.col("source"), F.col("lang"), F.lit(None).cast("string"))

    def want(rows):
        c = Counter()
        for _, t, s, _lang in rows:
            c[s] += len(enc.encode(t))
        return dict(c)

    table = budget.token_table(docs(old).select("content", "text"))
    first = budget.cube(budget.deltas(docs(old)), table)
    table2 = budget.token_table(docs(new).select("content", "text"), known=table)
    second = budget.cube(budget.deltas(docs(new), docs(old)), table2, before=first)
    fresh = budget.cube(budget.deltas(docs(new)), budget.token_table(docs(new).select("content", "text")))
    show = lambda df: sorted(map(str, df.where("docs <> 0").collect()))
    assert show(second) == show(fresh)
    assert {r.source: r.tokens for r in fresh.where("level = 'source'").collect()} == want(new)
    assert {r.lang for r in fresh.where("level = 'lang'").collect()} == {"fr", None}
    assert table2.count() == 5 and table2.select("content").distinct().count() == 5
    empty = budget.cube(budget.deltas(docs(old).limit(0)), table)
    assert [(r.level, r.tokens) for r in empty.collect()] == [("all", 0)]


# --- 5 ---------------------------------------------------------------------------------------------------------


def test_plans_fill_bins():
    rng = random.Random(5)
    for _ in range(150):
        cap = rng.choice([7, 20, 64, 101])
        count = Counter(rng.randrange(1, cap) for _ in range(rng.randrange(1, 200)))
        patterns = packing.plan(dict(count), cap)
        used = Counter()
        for p, n in patterns:
            assert sum(w * k for w, k in p) <= cap
            for w, k in p:
                used[w] += k * n
        assert used == count
        bins, bound = sum(n for _, n in patterns), -(-sum(w * n for w, n in count.items()) // cap)
        greedy: list[int] = []
        for w in sorted(count.elements(), reverse=True):
            fit = [r for r in greedy if r >= w]
            if fit:
                greedy.remove(min(fit))
                greedy.append(min(fit) - w)
            else:
                greedy.append(cap - w)
        assert bound <= bins <= len(greedy) + 1


def test_packing_of_a_table(spark):
    rng = random.Random(55)
    rows = [(i if i % 17 else None, [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 5, 5, 9, 31, 32, 33, 100]))] if i % 13 else None, 9, "x") for i in range(220)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "sample_id long, input_ids array<long>, length int, part string")
    got = packing.pack(df, 32, per_task=40).collect()
    assert all(len(r.input_ids) == r.n_tokens <= 32 for r in got) and len({r.sequence for r in got}) == len(got)
    parts = Counter()
    for r in got:
        assert [p.offset for p in r["items"]] == [sum(p.length for p in r["items"][:k]) for k in range(len(r["items"]))]
        for p in r["items"]:
            parts[p.sample_id, p.start, tuple(r.input_ids[p.offset : p.offset + p.length])] += 1
    want = Counter((i, s, tuple(t[s : s + 32])) for i, t, *_ in rows if t for s in range(0, len(t), 32))
    assert parts == want
    report = packing.fill_report(packing.pack(df, 32), 32).first()
    assert report.sequences <= report.least_sequences * 1.05 + 1
    assert packing.pack(df.limit(0), 32).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


# --- 7 ---------------------------------------------------------------------------------------------------------


def test_splitting_tree():
    uses = np.array([1000, 37, 5, 0])
    out = mixing.splitting_tree(uses, 8, np.random.default_rng(1))
    assert (out.sum(axis=0) == uses).all() and out.shape == (8, 4) and abs(out.sum(axis=1) - uses.sum() / 8).max() <= 8


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, *rng.choices([("a", "x"), ("b", None), ("c", "y"), ("zz", "q"), (None, None)], [70, 8, 20, 1, 1])[0], rng.choice([None, 0, 5, 10, 50]), "w") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, p string, n string, size int, source string")
    sources = spark.createDataFrame([("a", "x", 50.0, 2), ("b", None, 30.0, 5), ("b", None, 30.0, 5), ("c", "y", 20.0, None), ("d", "e", 9.0, 3), ("f", None, 0.0, 1), ("g", None, None, None), ("h", None, float("nan"), 1)], "path string, name string, weight double, max_repeats int")
    m = mixing.Mix(df, sources, F.col("p"), F.col("n"), F.col("size"), "doc_id")
    chosen = m.chosen().collect()
    assert len({r.doc_id for r in chosen}) == len(chosen)
    caps, size = {"a": 2, "b": 5, "c": 1}, {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in chosen:
        assert 1 <= r.uses <= caps[r.path] and r.size == size[r.doc_id] and len(r.shards) == r.uses
        taken[r.path] += r.uses * r.size
    total = sum(taken.values())
    for path, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(taken[path] / total - share) < 0.002
    shares = {(r.path, r.name): r for r in m.shares().collect()}
    assert abs(shares["b", None].share - 0.3) < 0.002 and shares["d", "e"].taken == 0 and len(shares) == 7
    stream = m.stream().collect()
    assert len(stream) == sum(r.uses for r in chosen)
    per = Counter(r.shard for r in stream)
    assert len(per) == 8 and max(per.values()) < 1.3 * min(per.values())
    assert mixing.Mix(df.limit(0), sources, F.col("p"), F.col("n"), F.col("size"), "doc_id").chosen().count() == 0
    fixed = mixing.Mix(df, sources, F.col("p"), F.col("n"), F.col("size"), "doc_id", total=10**9)
    assert {r.path: r.max_uses for r in fixed.shares().where("taken > 0").collect()} == caps
    every = mixing.Mix(df, sources, F.col("p"), F.col("n"), F.col("size"), "doc_id", total="all")
    reached = {r.path: r for r in every.shares().collect()}
    usable = sum(r[3] or 0 for r in rows if r[1] in caps)
    assert sum(r.taken for r in reached.values()) >= usable - 3 * 50 and all(abs(r.taken - r.quota) <= 50 for r in reached.values())
    assert all(r.max_uses <= caps.get(r.path, 0) for r in reached.values())
    keys = every.stream().select("shard", "order_key").collect()
    assert keys == sorted(keys)


def test_quotas_fill_up():
    rng = random.Random(8)
    for _ in range(300):
        k = rng.randrange(1, 6)
        size, weight, cap = {i: rng.choice([0, 3, 50, 900]) for i in range(k)}, {i: rng.choice([0.0, 1.0, 7.5]) for i in range(k)}, {i: rng.choice([1, 2, 9]) for i in range(k)}
        usable = [i for i in range(k) if size[i] and weight[i]]
        most = sum(cap[i] * size[i] for i in usable)
        total = rng.choice([1, 40, 1000, 5000])
        got = mixing.quotas(size, weight, cap, total)
        assert sorted(got) == usable and abs(sum(got.values()) - min(total, most)) < 1e-6 or not usable
        open_ = [got[i] / weight[i] for i in usable if got[i] < cap[i] * size[i] - 1e-9]
        full = [got[i] / weight[i] for i in usable if got[i] >= cap[i] * size[i] - 1e-9]
        assert not open_ or max(open_) - min(open_) < 1e-6 and all(f <= open_[0] + 1e-6 for f in full)


def test_a_model_too_large_to_send_gives_the_same_units(spark):
    texts = ["Selon M. Durand, le vin est cher. La suite vient. M. Petit dort, etc. Le roi rit. L'art. 5 dit non. Vers 200 av. J.-C. on vit.", None, " ", "Rien. Tout.", "Le roi dort à 9 h. Il rit."] + [f"Selon M. Durand, l'art. {i} dit non. La reine, cf. p. {i}, lit." for i in range(40)]
    df = spark.createDataFrame([(i % 37, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, model string")
    rows = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in MODEL], "lang string, kind string, key string, score double")
    for model in (None, rows):
        sent = sorted(map(str, sentences.split_sentences(df, model=model).collect()))
        assert sorted(map(str, sentences.split_sentences(df, model=model, model_rows=0).collect())) == sent and len(sent) > 80


def test_rows_of_a_model_have_the_same_numbers_in_both_engines(spark):
    df = spark.createDataFrame(MODEL, "lang string, kind string, key string")
    for r in df.select("*", F.xxhash64("lang", "kind", "key").alias("c")).collect():
        assert sentences.row_code(r.lang, r.kind, r.key) == r.c % 2**64
    codes = sentences.Codes(np.array([r[0] for r in df.select(F.xxhash64("lang", "kind", "key")).collect()], dtype=np.int64))
    assert all(m in codes for m in MODEL) and ("fr", "A", "zzz") not in codes


def test_items_by_seeds_like_items_sent(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    items = [(i % 25, " ".join(rng.choice(words) for _ in range(rng.choice([11, 14, 30, 60])))) for i in range(40)]
    docs = []
    for i in range(120):
        q = rng.choice(items)[1].split()
        part = q[: rng.choice([11, 12, 24, 40])]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            part[rng.randrange(len(part))] = "zz"
        docs.append((i % 100, " ".join(["aa"] * 5 + part + ["bb"] * 3)))
    docs += [docs[0]] * 9 + [(None, docs[1][1]), (7, None), (8, "")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string")
    for coverage in (None, 0.8):
        sent = sorted(map(str, leakage.find_leaks(d, t, coverage=coverage).collect()))
        assert sorted(map(str, leakage.find_leaks(d, t, coverage=coverage, block=3).collect())) == sent and len(sent) > 20
