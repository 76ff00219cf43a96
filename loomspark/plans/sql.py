"""Pieces of the queries' SQL, for an engine with RE2 patterns and lambdas written `lambda x: ...`."""

from ..functions.text import BOILERPLATE, CODE_DIMS, CODE_SIGNS, SPACE, TEXT_DIMS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(SPACE + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def words(x: str) -> str:
    return f"CASE WHEN {ws(f'coalesce({x}, {q(str())})')} = '' THEN []::VARCHAR[] ELSE string_split({ws(x)}, ' ') END"


def is_code(x: str) -> str:
    lines = f"string_split(substring(coalesce({x}, ''), 1, 2000), chr(10))"
    any_ = " OR ".join(f"contains(l, {q(s)})" for s in CODE_SIGNS)
    return f"(len(list_filter({lines}, lambda l: {any_})) * 10 > len({lines}) * 3)"


def boiler(x: str) -> str:
    return "(" + " + ".join(f"regexp_matches(substring(coalesce({x}, ''), 1, 2000), {q('(?i)' + p)})::INT" for p in BOILERPLATE) + ")"


def prefix(x: str, n: int) -> str:
    return f"substring({ws(f'lower(coalesce({x}, {q(str())}))')}, 1, {n})"


def grams(x: str, n: int = 5, first: int | None = 200) -> str:
    w = words(f"lower({x})") if first is None else f"list_slice({words(f'lower({x})')}, 1, {first})"
    some = f"CASE WHEN len(v) >= {n} THEN list_distinct(list_transform(range(1, len(v) - {n} + 2), lambda i: array_to_string(list_slice(v, i, i + {n} - 1), ' '))) ELSE []::VARCHAR[] END"
    return f"list_transform([{w}], lambda v: {some})[1]"


def dims(x: str) -> str:
    show = lambda d: "[" + ", ".join(map(q, d)) + "]"
    return f"CASE WHEN {is_code(x)} THEN {show(CODE_DIMS)} ELSE {show(TEXT_DIMS)} END"


def unit(*parts: str) -> str:
    return f"(('0x' || substring(md5({' || {} || '.format(q('-')).join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def authority(x: str) -> str:
    pattern = r"^[\x{0}-\x{20}]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
    return f"replace(regexp_extract(coalesce({x}, ''), {q(pattern)}, 1), 'www.', '')"
