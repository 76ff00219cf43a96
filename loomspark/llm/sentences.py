"""Sentence boundaries across languages and scripts.

Abbreviations and sentence starters are learned without labels, per language, from counts over all
documents: a type is an abbreviation if a log-likelihood ratio ties it to a following period, a word is
a starter if one ties its capitalised form to positions after a sentence end; a pair of an abbreviation
and the word after it that no chance explains (a collocation) is never parted. Each end mark is then
judged by these tables and by what stands around it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, ship

#: Frequent function words that tell languages in Latin script apart.
FUNCTION_WORDS = {
    "fr": "le la les des du une est et dans pour que qui sur avec par au".split(),
    "en": "the of and to in is that for it with was on as by from".split(),
    "de": "der die das und ist von den mit zu ein eine des im nicht wie".split(),
    "es": "el los las del una que por con es para como su al y en".split(),
    "it": "il gli della dei una che per con di non come nel sono i è".split(),
    "pt": "os das uma que não com para em um do da por mais como ao".split(),
    "nl": "het een van en de dat op te zijn met voor niet aan er om".split(),
}
_SCRIPTS = [
    ("th", re.compile("[ก-๛]")), ("zh", re.compile("[一-鿿]")), ("ja", re.compile("[぀-ヿ]")),
    ("ko", re.compile("[가-힯]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")),
    ("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽἀ-῿]")), ("he", re.compile("[֐-׿]")),
]
_BEYOND_LATIN = re.compile("[Ͱ-\u1fff\u2e80-\ufaff]")
_FUNCTION_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}

_CLOSERS = "»”“’\"')\\]」』】》）〉›"
_OPENERS = "«“„\"'(\\[「『【《（〈‹¿¡‘"
_MARKS = "!?…。！？｡؟۔।॥։"
_EMOJI = "\U0001f300-\U0001faff☀-➿️‍"
_FOOT = "(?:\\[\\d{1,3}\\]|[¹²³⁰⁴-⁹*†‡](?!\\w))"
_SPACE = re.compile(r"\s*")
_CANDIDATE = re.compile(f"(?:[.{_MARKS}]+)(?:[^\\S\\n]?[»](?!\\w)|[{_CLOSERS}])*(?:{_FOOT}|[{_EMOJI}])*")
_CANDIDATE_GREEK = re.compile(f"(?:[.;{_MARKS}]+)(?:[^\\S\\n]?[»](?!\\w)|[{_CLOSERS}])*(?:{_FOOT}|[{_EMOJI}])*")
_CJK_END = re.compile("[。！？｡]|(?<=[぀-ヿ一-鿿%％\\d])…")
_CJK = re.compile("[　-ヿ㐀-鿿＀-￯]")
_PARTICLE = re.compile("[とっはがをにものでやな、，,。]")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_BULLET = re.compile("[^\\S\\n]*(?:([•◦▪‣·●○■□►➤✓*])|[-–—]|\\(?\\d{1,3}[.)]|\\(?[A-Za-z]\\)|[ivxIVX]{1,5}[.)])[^\\S\\n]+(?=\\S)")
_ENDED = re.compile(r"[:;.!?…؟。！？।]\W*$")
_PAIRED = re.compile("[«»“”„\"「」『』()\\[\\]（）【】《》]")
_CLOSE_OF = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》"}
_OPEN_OF = {"»": "«", "”": "“", "」": "「", "』": "『", ")": "(", "]": "[", "）": "（", "】": "【", "》": "《"}
_NO_TOKEN = frozenset("«»“”„\"([「『/")
_NEXT = re.compile(f"[{_OPENERS}\\s]*")
_WORD = re.compile(r"[^\W\d_]+['’]?")
_ELISION = re.compile(r"[^\W\d_]{1,6}['’](?=[^\W\d_])")
_DOTTED = re.compile(r"(?:[^\W\d_]{1,3}[.\-]+)+[^\W\d_]{1,3}$")
_THAI_GAP = re.compile("(?<=[ก-๏])\\s+(?=[ก-๏])")
_THAI = re.compile("[ก-๏]")
_STRIP = "«»“”„\"'()[]「」『』（）,;:!?…¿¡*-–—"


def language(text: str) -> str:
    """A guess from scripts and function words of the whole text: the key under which statistics are kept."""
    if _BEYOND_LATIN.search(text):
        found = [(len(p.findall(text)), k) for k, p in _SCRIPTS]
        n, best = max(found)
        if n * 3 > len(text.replace(" ", "")):
            return "ja" if best == "zh" and dict((k, c) for c, k in found)["ja"] * 10 > n else best
    words = set(text.split())
    score = {k: len(f & words) for k, f in _FUNCTION_SETS.items()}
    best = max(score, key=lambda k: (score[k], k))
    if not score[best] and text.isupper():
        return language(text.lower())
    return best if score[best] else "xx"


def _token_before(text: str, end: int) -> str:
    """The run of signs before `end` without blanks, opening quotes, brackets and slashes."""
    at = end
    while at and (ch := text[at - 1]) not in _NO_TOKEN and not ch.isspace():
        at -= 1
    return text[at:end]


def _letter(ch: str) -> bool:
    return ch.isalpha() or "\u0900" <= ch <= "\u0dff"


#: Letters up to which a type before a period counts as one that may be an abbreviation, with what stands after it.
ABBREVIATION = 8
_LAST = frozenset(".!?…»”\"“’')]」』؟।。！？")


class _Tally:
    """Counts of one language in one task: tokens, pairs of a token that may end a sentence and the next, first tokens of blocks."""

    def __init__(self):
        self.tokens: Counter = Counter()
        self.pairs: Counter = Counter()
        self.firsts: Counter = Counter()

    def add(self, text: str) -> None:
        tokens = text.split()
        self.tokens.update(tokens)
        self.pairs.update([(a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] in _LAST])
        self.firsts.update([block.split(None, 1)[0] for block in _BLANK.split(text) if not block.isspace() and block])

    def counts(self, lang: str) -> Counter:
        """By kind: w, d: uses of a type without and with a period; C, S: capitalised uses, uses at a start;
        n, g: periods before a small letter or a sign, before a digit; 2: type, period, capitalised word."""
        c: Counter = Counter()
        for token, n in self.tokens.items():
            core = token.strip(_STRIP)
            if not core:
                continue
            head = _ELISION.match(core)
            if head:
                c[lang, "w", head.group().lower()] += n
                if core[0].isupper():
                    c[lang, "C", head.group().lower()] += n
                core = core[head.end() :]
            bare = core.rstrip(".")
            if bare and _letter(bare[0]):
                low = bare.lower()
                c[lang, "d" if bare != core else "w", low] += n
                if bare[0].isupper() and not head:
                    c[lang, "C", low] += n
                if bare != core and token[-1] in ",;:":
                    c[lang, "n", low] += n
        for (a, b), n in self.pairs.items():
            end = a.rstrip("»”\"“’')]」』")
            if not end or end[-1] not in ".!?…":
                continue
            core = end.strip(_STRIP)
            head = _ELISION.match(core)
            bare = (core[head.end() :] if head else core).rstrip(".")
            nxt = b.lstrip("«“„\"'([「『¿¡‘")
            m = _WORD.match(nxt)
            initial = m and len(m.group()) == 1 and nxt[1:2] in (".", "-")
            if m and m.group()[0].isupper() and not initial and (end[-1] != "." or len(bare) > 1 and _letter(bare[-1])):
                c[lang, "S", m.group().lower()] += n
            if end[-1] != "." or end.endswith("..") or a != end and a[-1] != ")" or not 0 < len(bare) <= ABBREVIATION or not _letter(bare[-1]):
                continue
            low = bare.lower()
            if nxt and nxt[0].isdigit():
                c[lang, "g", low] += n
            elif m and nxt[0].islower():
                c[lang, "n", low] += n
            elif m and nxt[0].isupper():
                c[lang, "2", f"{low} {m.group().lower()}"] += n
        for token, n in self.firsts.items():
            m = _WORD.match(token.lstrip("«“„\"'([「『¿¡‘"))
            if m and m.group()[0].isupper():
                c[lang, "S", m.group().lower()] += n
        return c


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])


def boundary_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, kind, key, n) over all texts; partial sums are made in each task before the shuffle."""
    ship(df.sparkSession)

    def flush(tallies: dict[str, _Tally]) -> pa.RecordBatch:
        c: Counter = Counter()
        for lang, t in tallies.items():
            c.update(t.counts(lang))
        tallies.clear()
        keys = list(c)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(c.values()), pa.int64())], names=["lang", "kind", "key", "n"])

    def run(batches):
        tallies: dict[str, _Tally] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not t.isspace():
                    lang = language(t)
                    if lang not in tallies:
                        tallies[lang] = _Tally()
                    tallies[lang].add(t)
            if sum(len(t.tokens) + len(t.pairs) for t in tallies.values()) > 600_000:
                yield flush(tallies)
        if tallies:
            yield flush(tallies)

    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, _COUNTS)
    return parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _xlogx(p: Column, k: Column, n: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def boundary_model(counts: DataFrame, abbreviation_score: float = 3.0, starter_score: float = 20.0, unfinished: float = 0.3) -> DataFrame:
    """(lang, kind, key, score) of accepted abbreviations (A, and N before digits), starters (S) and collocations (2).

    All four are log-likelihood ratios. An abbreviation's compares "nearly always with a period" to the
    language's base rate and falls with its length; besides, at least the share `unfinished` of its periods
    (0.7 for more than four letters) must stand before a small letter, a sign, a digit or a word that is no starter. That share tells nothing
    where periods end few sentences (base rate below 0.02), and is not asked for there. A starter's ratio compares its
    share of starts among capitalised uses with the language's; a word often written small starts too.
    """
    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in "wdnCSg"]
    counts = materialize(counts, "boundary-counts")  # read several times below
    words = materialize(counts.where("kind <> '2'").groupBy("lang", "key").agg(*kinds), "boundary-words")
    base = words.groupBy("lang").agg(*[F.sum(f"n_{k}").alias(f"all_{k}") for k in "wdCSg"])
    t = words.join(F.broadcast(base), "lang")  # a row a language, of which `language` knows a fixed number
    q0 = _ratio(F.col("all_S"), F.col("all_C"))
    starts = F.least(F.col("n_S"), F.col("n_C"))
    mine = _ratio(starts, F.col("n_C"))
    starter = F.when(mine > q0, 2 * (_xlogx(mine, starts, F.col("n_C")) - _xlogx(q0, starts, F.col("n_C"))))
    lowered = F.col("n_w") + F.col("n_d") - F.col("n_C")  # the word is written small as well: no name
    is_starter = (F.col("n_C") > 0) & ((starter >= starter_score) & (mine >= 0.5) | (lowered >= F.greatest(F.lit(3), 2 * (F.col("n_C") - starts))))
    starters = t.where(is_starter).select("lang", F.lit("S").alias("kind"), "key", F.coalesce(starter, F.lit(0.0)).alias("score"))

    pairs = counts.where("kind = '2'").select("lang", F.split("key", " ")[0].alias("a"), F.split("key", " ")[1].alias("b"), "n")
    known = starters.select("lang", F.col("key").alias("b"), F.lit(True).alias("starts"))
    names = pairs.join(known, ["lang", "b"], "left").groupBy("lang", F.col("a").alias("key")).agg(F.sum(F.when(F.col("starts").isNull(), F.col("n")).otherwise(0)).alias("n_x"))
    t = t.join(names, ["lang", "key"], "left").na.fill(0, ["n_x"])
    total = F.col("n_w") + F.col("n_d")
    p0 = _ratio(F.col("all_d"), F.col("all_w") + F.col("all_d"))
    llr = 2 * (_xlogx(F.lit(0.99), F.col("n_d"), total) - _xlogx(p0, F.col("n_d"), total))
    inner = F.length(F.regexp_replace("key", r"[.\-]", ""))
    score = llr * (1 + F.length("key") - inner) * F.exp(-inner / 2.0)
    open_share = _ratio(F.col("n_n") + F.col("n_g") + F.col("n_x"), F.col("n_d"))
    is_short = (F.col("n_d") > 0) & (score >= abbreviation_score) & ((p0 < 0.02) | (open_share >= F.when(inner <= 4, unfinished).otherwise(F.greatest(F.lit(unfinished), F.lit(0.7)))))
    g0 = _ratio(F.col("all_g"), F.col("all_d"))
    g = F.least(F.col("n_g"), F.col("n_d"))
    before_digit = (g * 2 >= F.col("n_d")) & (2 * (_xlogx(_ratio(g, F.col("n_d")), g, F.col("n_d")) - _xlogx(g0, g, F.col("n_d"))) >= abbreviation_score)
    abbreviations = t.where(is_short).select("lang", F.lit("A").alias("kind"), "key", score.alias("score"))
    numeric = t.where((F.col("n_d") > 0) & before_digit).select("lang", F.lit("N").alias("kind"), "key", F.col("n_g").cast("double").alias("score"))

    firsts = t.select("lang", F.col("key").alias("a"), F.col("n_d").alias("n_a"))
    seconds = t.select("lang", F.col("key").alias("b"), F.col("n_C").alias("n_b"), (F.col("all_w") + F.col("all_d")).alias("all"))
    c = pairs.join(known, ["lang", "b"], "left_anti").join(firsts, ["lang", "a"]).join(seconds, ["lang", "b"])
    p, p1 = _ratio(F.col("n_b"), F.col("all")), F.least(F.lit(1.0), _ratio(F.col("n"), F.col("n_a")))
    bound = F.when(p1 > p, 2 * (_xlogx(p1, F.col("n"), F.col("n_a")) - _xlogx(p, F.col("n"), F.col("n_a"))))
    together = c.where((F.length("a") <= 4) & (F.col("n") >= 3) & (F.col("n") * 2 >= F.col("n_a")) & (bound >= starter_score)).select("lang", F.lit("2").alias("kind"), F.concat_ws(" ", "a", "b").alias("key"), bound.alias("score"))
    return abbreviations.unionByName(numeric).unionByName(starters).unionByName(together)


def row_code(lang: str, kind: str, key: str) -> int:
    """The number of a row of the model, as xxhash64 gives it for the three columns."""
    h = 42
    for part in (lang, kind, key):
        h = xxhash.xxh64_intdigest(part.encode(), h)
    return h


class Codes:
    """The model as sorted 64-bit numbers of its rows: eight bytes each, searched, and answers remembered."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes.view(np.uint64) if codes.dtype == np.int64 else codes.astype(np.uint64))
        self.seen: dict[tuple[str, str, str], bool] = {}

    def __contains__(self, row: tuple[str, str, str]) -> bool:
        found = self.seen.get(row)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            code = np.uint64(row_code(*row))
            at = int(np.searchsorted(self.codes, code))
            found = self.seen[row] = at < len(self.codes) and self.codes[at] == code
        return found


class Splitter:
    """Judges the end marks of a text by a learned model: anything that says whether it holds a (lang, kind, key)."""

    def __init__(self, rows):
        self.has = {(a, b, c) for a, b, c in rows} if isinstance(rows, list) else rows

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of each unit, end exclusive, trimmed; none for null and blank texts."""
        if not text or text.isspace():
            return []
        lang, out, at = language(text), [], 0
        for gap in _BLANK.finditer(text):
            self._block(text, at, gap.start(), lang, out)
            at = gap.end()
        self._block(text, at, len(text), lang, out)
        return out

    def _block(self, text: str, start: int, end: int, lang: str, out: list) -> None:
        at, line, item = start, start, True
        while 0 <= (br := text.find("\n", line, end)):
            m = _BULLET.match(text, br + 1, end)
            now = bool(m) and (bool(m.group(1)) or item and _BULLET.match(text, line, br) is not None or _ENDED.search(text, line, br) is not None)
            if now:
                self._piece(text, at, br, lang, out)
                at = br + 1
            item = now or item and line == start
            line = br + 1
        self._piece(text, at, end, lang, out)

    def _emit(self, text: str, a: int, b: int, out: list) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def _nested(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Spans between a quote or bracket and its partner; one that a cut-off text leaves open reaches to the end."""
        stack: list[tuple[str, int]] = []
        spans = []
        straight = text.count('"', start, end) % 2 == 0
        for m in _PAIRED.finditer(text, start, end):
            ch, i = m.group(), m.start()
            if ch == '"':
                if straight:
                    if any(o == '"' for o, _ in stack):
                        while stack[-1][0] != '"':
                            stack.pop()
                        spans.append((stack.pop()[1], i))
                    else:
                        stack.append((ch, i))
            elif ch == "“" and any(o == "„" for o, _ in stack):
                while stack[-1][0] != "„":
                    stack.pop()
                spans.append((stack.pop()[1], i))
            elif ch in _CLOSE_OF:
                stack.append((ch, i))
            elif any(o == _OPEN_OF[ch] for o, _ in stack):
                while stack[-1][0] != _OPEN_OF[ch]:
                    stack.pop()
                spans.append((stack.pop()[1], i))
        if stack and not _ENDED.search(text[max(start, end - 6) : end].rstrip()):
            spans.append((stack[0][1], end))
        return spans

    def _piece(self, text: str, start: int, end: int, lang: str, out: list) -> None:
        m = _BULLET.match(text, start, end)
        first = m.end() if m else start
        spans = self._nested(text, start, end) if _PAIRED.search(text, start, end) else []
        cuts = []
        for c in (_CANDIDATE_GREEK if lang == "el" else _CANDIDATE).finditer(text, first, end):
            p = c.end()
            if p < end and not (spans and any([a < c.start() and p <= b for a, b in spans])) and self._ends(text, c, end, lang):
                cuts.append(p)
        if lang == "th" or _THAI.search(text, start, end):
            cuts = sorted(set(cuts) | {g.start() for g in _THAI_GAP.finditer(text, first, end) if not any(a < g.start() <= b for a, b in spans)})
        at = start
        for p in cuts:
            self._emit(text, at, p, out)
            at = p
        self._emit(text, at, end, out)

    def _ends(self, text: str, c: re.Match, end: int, lang: str) -> bool:
        p, marks = c.end(), c.group()
        q = p
        while q < end and text[q].isspace():
            q += 1
        if q == end:
            return True
        nxt = text[q]
        if nxt.islower() and q > p:
            return False
        if marks[0] in "。！？｡…" and _CJK_END.search(text, c.start(), p):
            closed = any(x in marks for x in "」』")
            return not (closed and _PARTICLE.match(nxt)) and nxt not in "、，,；;"
        r = q if nxt.isupper() else _NEXT.match(text, q, end).end()
        follow = text[r] if r < end else ""
        word = _WORD.match(text, r, end)
        if q == p:  # no space after the mark
            before = text[max(0, c.start() - 1) : c.start()]
            if not (follow.isupper() and (before.isdigit() or before.isalpha() and not before.isupper())):
                return marks[-1] in "?!؟۔।॥" and not follow.islower() and follow.isalpha() and len(marks) == 1 and not _CJK.match(follow)
            token = _token_before(text, c.start())
            unit = len(token) == 1 and text[max(0, c.start() - 3) : c.start() - 1].strip()[-1:].isdigit()  # 2 h.
            if word is None or not (len(token) > 1 or unit) or re.search(r"[./@\\_:]|^www$", token):
                return False
            if word.end() - r == 1 and word.group()[-1] not in "'’":
                return False
            return not (marks[0] == "." and (lang, "A", token.lower()) in self.has) or (lang, "S", word.group().lower()) in self.has
        if follow.islower() or nxt in ",;:)]%" or not follow:
            return False
        if nxt in "-–—":
            rest = _NEXT.match(text, _SPACE.match(text, q + 1, end).end(), end).end()
            return not (rest < end and text[rest].islower())
        if marks[0] != "." or marks.startswith("..") or len(marks) > 1 and marks[1] in ".?!…":
            return True
        token = _token_before(text, c.start()).lstrip("'’-–—")
        low = token.lower()
        key = low
        if "'" in low or "’" in low:
            key = re.split("['’]", low)[-1]
        starter = word is not None and (lang, "S", word.group().lower()) in self.has and not (len(word.group()) == 1 and text[word.end() : word.end() + 1] in (".", "-"))
        if word is not None and (lang, "2", f"{key} {word.group().lower()}") in self.has:
            return False
        if token.isdigit():
            return starter or lang != "de" or len(token) > 2 or not follow.isalpha()
        if follow.isdigit() and (lang, "N", key) in self.has:
            return False
        initial = len(key) == 1 and key.isalpha() and token[-1].isupper()
        if not (initial or _DOTTED.match(token) or (lang, "A", key) in self.has or (lang, "A", low) in self.has):
            return True
        if not follow.isupper() or initial:
            return False
        return starter


def _asked(text: str) -> set[tuple[str, str, str]]:
    """All rows of a model that splitting this text may look at: an upper bound, taken at every end mark."""
    lang, out = language(text), set()
    for c in (_CANDIDATE_GREEK if lang == "el" else _CANDIDATE).finditer(text):
        token = _token_before(text, c.start())
        low = token.lstrip("'’-–—").lower()
        keys = {token.lower(), low, re.split("['’]", low)[-1]}
        word = _WORD.match(text, _NEXT.match(text, c.end()).end())
        if word:
            first = word.group().lower()
            out.add((lang, "S", first))
            out.update((lang, "2", f"{k} {first}") for k in keys)
        out.update((lang, kind, k) for k in keys for kind in "AN")
    return out


def _by_join(picked: DataFrame, learned: DataFrame, run, schema: T.StructType) -> DataFrame:
    """Splitting without sending the model: each text's own rows of it are joined to the text, by its hash and one of a few salts."""
    salts = 16  # a text that stands in a third of all rows is split over so many tasks
    texts = picked.where(F.length(F.trim("text")) > 0).withColumn("h", F.md5("text"))

    def ask(batches):
        for batch in batches:
            h, keys = [], []
            for code, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                found = _asked(text)
                h += [code] * len(found)
                keys += found
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), *columns], names=["h", "lang", "kind", "key"])

    asked = texts.select("h", "text").mapInArrow(ask, "h string, lang string, kind string, key string").distinct()
    held = asked.join(learned, ["lang", "kind", "key"]).groupBy("h").agg(F.collect_list(F.struct("lang", "kind", "key")).alias("model"))  # rows of one text
    held = materialize(held, "model-by-text").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = texts.withColumn("salt", F.expr(f"pmod(xxhash64(id), {salts})").cast("int")).join(held, ["h", "salt"], "left")
    return placed.select("id", "text", "model").mapInArrow(run, schema)


def split_sentences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: DataFrame | None = None, model_rows: int = 10_000_000
) -> DataFrame:
    """(id, start_pos, end_pos) of each sentence, heading, label, item or cut-off piece.

    Positions count code points, end exclusive; no unit has white space at an end. Null, empty and blank
    texts have no unit; equal rows give equal units once each; a null id is kept. The statistics come from
    all texts of df unless a model is given. A model of up to model_rows rows is sent to the tasks as eight bytes a
    row; with a larger one each text is joined with the rows it asks for, to the same result.
    """
    spark = df.sparkSession
    ship(spark)
    learned = boundary_model(boundary_counts(df, text_col)) if model is None else model
    learned = materialize(learned.select("lang", "kind", "key").distinct(), "boundary-model")
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = learned.count() <= model_rows
    shared = spark.sparkContext.broadcast(learned.select(F.xxhash64("lang", "kind", "key").alias("c")).toArrow().column("c").to_numpy()) if sent else None
    held: dict = {}

    def run(batches):
        if "s" not in held and shared is not None:
            held["s"] = Splitter(Codes(shared.value))
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            if shared is not None:
                found = [held["s"].units(t) for t in texts]
            else:
                models = batch.column("model").to_pylist()
                found = [Splitter([(r["lang"], r["kind"], r["key"]) for r in m or []]).units(t) for t, m in zip(texts, models)]
            place = np.repeat(np.arange(len(texts)), [len(x) for x in found])
            flat = np.array([u for x in found for u in x], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["id", "start_pos", "end_pos"])

    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])
    units = picked.mapInArrow(run, schema) if sent else _by_join(picked, learned, run, schema)
    return units.select(F.col("id").alias(id_col), "start_pos", "end_pos")
