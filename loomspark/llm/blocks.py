"""Shallow features of the lines (flat text blocks) of a page, and cue words of page furniture."""

from __future__ import annotations

import html
import re
import unicodedata
from itertools import chain

import numpy as np

HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_SPACES = re.compile(r"[^\S\n]+")

#: Stems and phrases that furniture uses, without accents, in several languages. Each begins
#: at a word's start; those with a final | also end at a word's end, and those with a ~ are common words besides, which
#: count in lines of at most LABEL words only.
CUES = {
    "consent": "cookie; temoin de connexion; traceur; j'ai compris; continuer sans accepter; consent; vie privee; confidentialite; donnees personnelles; mesure d'audience; tout accepter; tout refuser; mes choix; j'accepte; accept all; accept cookies; reject all; privacy; alle akzeptieren; datenschutz; akzeptieren; privacidad; aceptar; accetta; rgpd|; gdpr|; vos preferences",
    "account": "se connecter; connexion; identifiez; identifiant; mot de passe; creer un compte; mon compte; s'inscrire; inscrivez; deconnexion; sign in; log in; login; sign up; register~; create an account; my account; password; anmelden; registrieren; konto|; iniciar sesion; registrarse; accedi|; registrati; devez etre membre",
    "news": "newsletter; lettre d'information; lettre de~; abonne|; abonnez; abonnement; m'abonne; s'abonner; adresse e-mail; adresse email; votre courriel; recevoir les; recevez~; alertes~; ne manquez; subscribe; subscription; abonnieren; rundbrief; suscrib; boletin; iscriviti; fil rss; rss|; faire un don; donate; spenden; sans engagement",
    "share": "partager; partagez; partage|~; partages|~; j'aime; tweet; facebook; twitter; whatsapp; linkedin; envoyer a un ami; imprimer; version pdf; en pdf; copier le lien; signaler; share this; share on; print this; copy link; beitrag teilen; teilen|; drucken; compartir; condividi; suivez|; retrouvez-nous; follow us; vous a plu; noter ce",
    "ads": "publicite; annonce|~; annonces|~; contenu sponsorise; sponsored content; sponsor; nos partenaires; partenaire~; advertis; anzeige|; werbung; publicidad; pubblicita; suite apres; est offert",
    "legal": "mentions legales; conditions generales d'utilisation; droit reserve; droits reserves; copyright; toute reproduction; reproduction interdite; reproduction soumise; propriete intellectuelle; intellectual property; tous droits; plan du site; titre indicatif; n'engagent; heberge par; hebergee par; hebergement; site realise; all rights; terms of; imprint|; impressum; alle rechte; aviso legal; derechos reservados; diritti riservati; commission de presse; non conforme|; accessibilite; sitemap; ©; (c)|",
    "nav": "accueil|; menu|~; navigation|~; aller au contenu; passer au contenu; rechercher; recherche|~; toutes les rubriques; nos categories; nos dossiers; categories|; rubrique~; retour en haut; haut de page; page precedente; page suivante; precedent|~; suivant|~; vous etes ici; lire la suite; en savoir plus; voir plus; contact|~; contacter; nous ecrire; qui sommes; a propos|; home|~; back to top; skip to; next page; previous|~; read more; about us; contact us; search|~; startseite; nach oben; weiterlesen; kontakt|; suche|~; uber uns; inicio|; leer mas; contacto|; leggi tutto; boutique|~; forum|~; agenda|~; portail~; se desabonner",
    "related": "a lire; lire aussi; voir aussi; sur le meme; dans la meme; autres articles; articles recents; autres dossiers; les plus lus; plus lus; pourraient vous; notre selection; en ce moment; dernieres parutions; a decouvrir; decouvrez; you may also; related|; most read; recommended; see also; das konnte; mehr zum thema; auch interessieren; te puede interesar; potrebbe interessarti; mots-cles; mots cles; tag|~; tags|; etiquettes; classe dans; schlagworter; filed under; etiquetas; popular articles; mediatheque",
    "meta": "publie le; ajoute le; poste le; mis en ligne; mis a jour; mise a jour; modifie le~; redige par; ecrit par; posted on; posted by; published~; updated~; written by; veroffentlicht; publicado; pubblicato; consulte~; commentaire; reactions a; derniere visite; reponses a; replies to; comments|; a comment|; add comment; 1 comment|; kommentar; comentario; repondre|; reply|; a propos de l'auteur; l'auteur :; about the author; auteur de|; autrice de|; auteur du|; autrice du|; journaliste~; redacteur; redactrice; blogueu; freelance; is the author; is a writer; is an editor; is a journalist; minutes de lecture; min read; temps de lecture",
}
_SHORT_CUE = re.compile(r"^(?:vue?|lue?) \d+ fois|\bfois depuis\b|^ref\. ?\d|^citer\W*$|^\d+ (?:vues|views|likes)\b")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in CUES.items():
        for phrase in phrases.split("; "):
            weak = phrase.endswith("~")
            phrase = phrase.rstrip("~")
            whole = phrase.endswith("|")
            phrase = phrase.rstrip("|")
            a.add_word(phrase, (kind, len(phrase), whole, len(phrase.split()), weak))
    a.make_automaton()
    return a


_cues: list = []
#: A date, a byline, a counter or a common word that furniture uses too is, in a line of more words, part of what the line says.
LABEL = 18


def cue_hits(text: str, n: int) -> tuple[int, int]:
    """(families of cues in a text of n words, words that cues cover), a cue inside another not counted, nor one that comes again."""
    if not _cues:
        _cues.append(_automaton())
    spans: list[tuple[int, tuple]] = []  # of cues inside cues the outer ones, which end last
    for end, cue in _cues[0].iter(text):
        start = end - cue[1] + 1
        if start and text[start - 1].isalnum() or cue[2] and end + 1 < len(text) and text[end + 1].isalnum() or n > LABEL and cue[4]:
            continue
        while spans and spans[-1][0] >= start:
            spans.pop()
        spans.append((start, cue))
    short = len(text) < 60 and (text[-1].isdigit() or "fois" in text or "cit" in text or text[0].isdigit() or text.startswith("ref")) and _SHORT_CUE.search(text)
    if not spans:
        return (1, 1) if short else (0, 0)
    kinds, seen, words = set(), set(), 0
    for start, (kind, size, _, count, _) in spans:
        kinds.add(kind)
        phrase = text[start : start + size]
        if phrase not in seen:
            seen.add(phrase)
            words += count
    if short:
        kinds.add("meta")
        words += 1
    return len(kinds), words


#: Words that speak to or of the reader or the writer, without accents.
ADDRESS = "vous votre vos you your sie ihr ihre usted je nous notre nos we our us wir unsere nuestro merci please bitte".split()
_ADDRESS = frozenset(a + w + z for w in ADDRESS for a in ("", "(", '"') for z in ("", ",", ".", ";", ":", "!", "?", ")", "...", "…"))
_IMPERATIVE = re.compile(r"(?:^|\s)(?!(?:ch|ass|n|r)ez\b)\w+ez\b")
_DATE = re.compile(
    r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}(?:er|\.)? (?:janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre|januar|februar|marz|april|juni|juli|august|september|oktober|november|dezember|january|february|march|may|june|july|october|december|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?: \d{4})?|(?:january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2},? \d{4})\b"
)
_BYLINE = re.compile(r"\b(?:par|by|von|por|di) [a-z]\. ?[a-z]|(?:^|[|,–-] ?)(?:par|by|von|por|di) [a-z'-]+ [a-z'-]+(?: [a-z'-]+)?$|^[a-z]\. [a-z'-]{3,} |, (?:pour|for|fur) |\| [a-z]\. ")
_SEPARATOR = re.compile(r"\s(?:[|·•/›»>–—\\]\s|\s*\t\s*|(?<=\t)\s*|(?<= ) +|[»›>])")
_DASH = re.compile(r"\s[–—-]\s")
_LEAD = re.compile(
    r"^\W{0,2}(?:lire aussi|voir aussi|a lire aussi|a lire|a voir|a decouvrir|lire la suite|sur le meme sujet|see also|read also|read more|siehe auch|mehr dazu|lea tambien|leggi anche)\s?:|"
    r"^(?:[»›>←→▸▶◄]+|>>|<<|\[\+\]|\+ )\s*"
)
_TRAIL = re.compile(r"(?:\(\d+\)|[→»›]|lire la suite ?(?:\.\.\.|…)?|read more|\[\.\.\.\]|\bsuite ?(?:\.\.\.|…))\s*$")
_HANDLE = re.compile(r"^\W{0,2}(?:[a-z][a-z.-]*[\d_]+\w*|[a-z]+_[a-z]\w*|@\w+)\s?: |^(?:de |from |@)[a-z]\w+ ")
_MARK = re.compile(r"^(?:[-–—*•◦▪]|\(?\d{1,3}[.)]|\(?[a-z]\))\s")
_STOP = re.compile(r"[.!?…][»\"”)\]\s]*(?:\[\d+\])?$")
_MAY_PART = (" |", " ·", " •", " /", " ›", " »", " >", " –", " —", " \\", "\t", "  ")
_TRAILS = (")", "]", "→", "»", "›", "...", "…", "lire la suite", "read more")
_DIGIT = re.compile(r"\d")


_COMBINING = re.compile("[̀-ͯ]+")


def plain(lines: list[str]) -> list[str]:
    """Lines without entities, invisible signs, accents and case, single-spaced except for wide gaps; all brought over at once."""
    for k, line in enumerate(lines):
        if "&" in line and _ENTITY.search(line):
            lines[k] = html.unescape(line).replace("\n", " ")
    text = "\n".join(lines)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", HIDDEN.sub("", text).replace("’", "'")))
    return [line.strip() for line in text.lower().split("\n")]


_SHAPE = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"\s+"), " ")]


def shape(text: str) -> str:
    """What kinds of signs open a line: words a, numbers 9, the rest as it is; the kinds of its first 60 signs, 12 at most."""
    text = text[:60]
    for pattern, sign in _SHAPE:
        text = pattern.sub(sign, text)
    return text.replace("a'a", "a").replace("a-a", "a")[:12]


_COLUMNS = re.compile(r"(?<=\S) {3,}(?=\S)")
#: The order of a line's own features; those of the page around it follow, see page_features.
OWN = ("words", "stop", "link", "cue", "cue_share", "address", "date", "byline", "digits", "mark", "handle", "sign", "upper")
#: Lines of so many words have one shape, "long": what signs open a paragraph says nothing of it. All other features are theirs as any line's.
LONG = 28


def own_features(text: str, upper: bool = False) -> tuple[tuple[float, ...], str]:
    """OWN features of a line given by plain(), and its shape. Every sign of the line counts, however long it is."""
    words = text.split()
    n, size = len(words), len(text)
    ascii_ = text.isascii()
    if size > 12 * n + 30 and not ascii_:
        n = max(n, size // 4)  # a script without spaces
    wide = text.count("  ")
    if wide and n > 2 and wide >= n - 1 and max(map(len, re.findall(" +", text))) == 2:
        text, wide = " ".join(words), 0  # single words, each two blanks apart, are one piece
    number = sum(map(text.count, "0123456789")) if ascii_ else len(_DIGIT.findall(text))
    digits = number / max(size - text.count(" "), 1)
    pieces: list[str] | tuple[str] = (text,)
    for sign in _MAY_PART:
        if sign in text:
            pieces = [p for p in _SEPARATOR.split(text) if p and p.strip()]
            break
    bar = text[0] == "|"
    many = len(pieces) >= 2 and n / len(pieces) <= 4
    cells = many and digits > 0.1 or bar
    if many and len(pieces) >= 3 and not cells:
        link = 1.0
    elif not bar and (_LEAD.match(text) or text.endswith(_TRAILS) and (text[-1] != "»" or "«" not in text) and (n < LONG or text[-1] != ")") and _TRAIL.search(text, max(0, size - 60))):
        link = 0.9
    else:
        link = 0.5 if len(pieces) >= 2 and n <= 14 and not cells and not (len(pieces) == 2 and _DASH.search(text)) else 0.0
    kinds, hit = cue_hits(text, n)
    real = max(1, sum([w.isalnum() or any(map(str.isalnum, w)) for w in words])) if n < LONG else n
    share = min(1.0, hit / real)
    address = len(_ADDRESS.intersection(words)) + (" j'" in text or text.startswith("j'")) + (" m'" in text)
    if "ez" in text and _IMPERATIVE.search(text):
        address += 1
    date = byline = False
    if real <= LABEL:
        date, byline = number > 0 and bool(_DATE.search(text)), ("." in text or ", " in text or n <= 10 and ("par " in text or "by " in text or "von " in text or "por " in text or "di " in text)) and bool(_BYLINE.search(text))
    handle = (": " in text or real <= LABEL and text.startswith(("de ", "from ", "@"))) and bool(_HANDLE.match(text))
    sign = (link >= 0.9) + (share >= 0.45) + (address > 0 and kinds > 0 and share >= 0.06) + (date and (byline or kinds > 0)) + (kinds >= 3 and share >= 0.1) + handle
    if n >= LONG:
        form = "long"
    else:
        form = "columns|" if text.count("\t") >= 2 or wide and len(_COLUMNS.findall(text)) >= 2 else shape(text)
    return (
        float(min(n, 60)), float(n > 3 and (text[-1] in ".!?…" or text[-1] in "»\"”)]" and _STOP.search(text, max(0, size - 40)) is not None)), link, kinds * min(1.0, share * 10), share, float(min(address, 3)), float(date),
        float(byline), digits, float(_MARK.match(text) is not None), float(handle), float(sign), float(upper),
    ), form


#: Features of a line's surroundings, after OWN.
AROUND = ("body", "run", "short_run", "before_words", "after_words", "before_link", "after_link", "links", "to_body_before", "to_body_after")
NAMES = OWN + AROUND

#: Lines whose features a worker remembers (furniture repeats); it forgets all when full. No effect on results.
CACHE_LINES = 100_000
_seen: dict[str, tuple[tuple[float, ...], int] | None] = {}
_forms: dict[str, int] = {"columns|": 0}
_telling: list[bool] = [True]  # of a form's number: whether it has more than words and blanks


def _form_number(form: str) -> int:
    k = _forms.get(form)
    if k is None:
        k = _forms[form] = len(_forms)
        _telling.append(bool(form.strip("a ")))
    return k


def _describe(lines: list[str]) -> dict[str, tuple[tuple[float, ...], int] | None]:
    """OWN features and number of the form of each line, None for one without visible signs."""
    if len(_seen) + len(lines) > CACHE_LINES or len(_forms) > CACHE_LINES:
        _seen.clear()
    out = {}
    new = []
    for line in lines:
        found = _seen.get(line, 0)
        if found == 0:
            new.append(line)
        else:
            out[line] = found
    for line, text in zip(new, plain(list(new)) if new else ()):
        if text and not text.isspace():
            f, form = own_features(text, len(line) > 4 and line.isupper())
            got = (f, _form_number(form))
        else:
            got = None
        out[line] = got
        if len(line) <= 120:
            _seen[line] = got
    return out


def _shifted(a: np.ndarray, by: int, same: np.ndarray, fill: float) -> np.ndarray:
    """a moved by one place (1: each line sees the line before, -1: the line after), `fill` at a page's edge."""
    out = np.full(len(a), fill, a.dtype)
    if by > 0:
        out[1:][same[1:]] = a[:-1][same[1:]]
    else:
        out[:-1][same[1:]] = a[1:][same[1:]]
    return out


def batch_features(pages: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each page the numbers of its lines with visible signs, and the features OWN + AROUND of all of them in order. Linear."""
    flat = list(chain.from_iterable(pages))
    distinct = list(dict.fromkeys(flat))
    if len(_forms) > CACHE_LINES:  # forms are numbered for this batch and the cache alone
        _seen.clear()
        _forms.clear()
        _forms["columns|"] = 0
        del _telling[1:]
    described = _describe(distinct)
    rows, place, at = [], {}, 0
    for line, got in described.items():
        if got is None:
            place[line] = -1
        else:
            place[line] = at
            rows.append(got)
            at += 1
    index = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(p) for p in pages], np.int64)
    page_of = np.repeat(np.arange(len(pages)), sizes)
    line_no = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen = index >= 0
    index, page_of, line_no = index[seen], page_of[seen], line_no[seen]
    n = len(index)
    counts = np.bincount(page_of, minlength=len(pages)) if len(pages) else np.zeros(0, np.int64)
    numbers = np.split(line_no, np.cumsum(counts)[:-1]) if len(pages) else []
    if not n:
        return numbers, np.zeros((0, len(NAMES)))
    own = np.array([r[0] for r in rows])[index]
    form = np.array([r[1] for r in rows], np.int64)[index]
    words, stop, link, kinds, share, digits = own[:, 0], own[:, 1], own[:, 2], own[:, 3], own[:, 4], own[:, 8]
    same = np.zeros(n, bool)  # the line before is of the same page
    same[1:] = page_of[1:] == page_of[:-1]
    goes_on = np.zeros(n, bool)
    goes_on[1:] = same[1:] & (form[1:] == form[:-1]) & np.array(_telling)[form[1:]]
    part = np.cumsum(~goes_on) - 1
    run = np.bincount(part)[part]
    small = (words <= 3) & (stop == 0) & (digits == 0) & (kinds == 0)
    turn = np.ones(n, bool)
    turn[1:] = ~same[1:] | (small[1:] != small[:-1])
    part = np.cumsum(turn) - 1
    short_run = np.where(small, np.bincount(part)[part], 0)
    table = (form == 0) & (run >= 4) & (kinds == 0)  # rows of a table, not a menu's gaps
    own[table, 2] = own[table, 11] = 0.0
    # body: long text without the signs of furniture, or a run of lines of one make (a list, a table)
    body = ((words >= 10) & (kinds + share * 4 < 1.6) & (link < 0.9)) | ((run >= 4) & (words >= 2) & (share < 0.34)) | (short_run >= 8)
    where = np.arange(n)
    first = np.maximum.accumulate(np.where(same, 0, where))
    last = np.maximum.accumulate(np.where(body, where, -1))
    last = np.concatenate([[-1], last[:-1]])
    before = np.where(last >= first, np.minimum(9, where - last), 9)
    back = np.concatenate([same[1:], [False]])  # the line after is of the same page
    end = np.minimum.accumulate(np.where(back, n, where)[::-1])[::-1]
    following = np.minimum.accumulate(np.where(body, where, 2 * n)[::-1])[::-1]
    following = np.concatenate([following[1:], [2 * n]])
    after = np.where(following <= end, np.minimum(9, following - where), 9)
    capped, linked = np.minimum(words, 20.0), np.maximum(link, np.minimum(1.0, share * 2))
    is_link = (link >= 0.9).astype(float)
    up, down = _shifted(is_link, 1, same, 0.0), _shifted(is_link, -1, same, 0.0)
    links = up + down + _shifted(up, 1, same, 0.0) + _shifted(down, -1, same, 0.0)
    around = [
        body, np.minimum(run, 8), np.minimum(short_run, 12), _shifted(capped, 1, same, 0.0), _shifted(capped, -1, same, 0.0),
        _shifted(linked, 1, same, 1.0), _shifted(linked, -1, same, 1.0), links, before, after,
    ]
    return numbers, np.column_stack([own, *around])


def page_features(lines: list[str]) -> tuple[list[int], list[list[float]]]:
    """batch_features of one page, as lists."""
    numbers, x = batch_features([lines])
    return numbers[0].tolist(), x.tolist()
