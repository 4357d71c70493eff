"""DuckDB SQL expression builders for the independent oracle queries.

The patterns are written out here, not shared with the Spark side, so that a
fault in one of them shows.
"""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal (no backslash escaping in DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


# Python's str.isspace() characters; neither word characters nor those; the first sentence.
SPACES = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"
NON_WORD = q(rf"[^\p{{L}}\p{{N}}_{SPACES}]")
WS_RUN = q(f"[{SPACES}]+")
FIRST = q(rf"(?s)^[{SPACES}]*(.*?[.!?]+)(?:[{SPACES}]|\z)")
EDGE = q(rf"^[{SPACES}]+|[{SPACES}]+\z")
ABBREVIATIONS = (
    "string_split('dr mr mrs ms prof rev hon gen col lt sgt capt sen rep gov pres st jr sr no vs etc e.g i.e a.m p.m inc corp co ltd dept est"
    " jan feb mar apr jun jul aug sep sept oct nov dec', ' ')"
)
STARTERS = "string_split('the he she it they we i this that these those but a an in however there if when what why how', ' ')"
CONTR = "'cannot', 'gimme', 'gonna', 'gotta', 'lemme', 'wanna'"
NL = "chr(10)"


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), {NON_WORD}, '', 'g')"


def split_ws(x: str) -> str:
    return f"regexp_split_to_array({x}, {WS_RUN})"


def tokens_of_norm(n: str) -> str:
    return (
        f"flatten(list_transform(list_filter({split_ws(n)}, lambda t: t <> ''), "
        f"lambda t: CASE WHEN t IN ({CONTR}) THEN [substr(t, 1, 3), substr(t, 4)] ELSE [t] END))"
    )


def tokens(x: str) -> str:
    return tokens_of_norm(norm(x))


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def lex_tokens(x: str) -> str:
    return tokens(f"replace({x}, 'U.S.', 'USA')")


def first_sentence(x: str) -> str:
    t = f"coalesce({x}, '')"
    hit = f"regexp_extract({t}, {FIRST}, 1)"
    return f"(CASE WHEN {hit} <> '' THEN {hit} ELSE regexp_replace({t}, {EDGE}, '', 'g') END)"


def first_sentence_by_tables(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), {EDGE}, '', 'g')"
    pieces = f"regexp_extract_all({t}, {q(f'[^{SPACES}]+[{SPACES}]*')})"
    words = f"list_transform({pieces}, lambda p: regexp_replace(p, {EDGE}, '', 'g'))"
    body = rf"regexp_extract(z[1], '^[^\p{{L}}\p{{N}}]*(.*[^.!?])\.\z', 1)"
    held = rf"(list_contains({ABBREVIATIONS}, lower({body})) OR regexp_matches({body}, '^(?:\p{{Lu}}\.)*\p{{Lu}}\z'))"
    starts = rf"list_contains({STARTERS}, lower(regexp_replace(z[2], '[^\p{{L}}]', '', 'g')))"
    ends = f"regexp_matches(z[1], '[.!?]\\z') AND NOT ({held} AND coalesce(z[2], '') <> '' AND NOT {starts})"
    n = f"list_position(list_transform(list_zip({words}, ({words})[2:]), lambda z: {ends}), true)"
    return f"(CASE WHEN {n} > 0 THEN regexp_replace(array_to_string(({pieces})[:{n}], ''), {EDGE}, '', 'g') ELSE {t} END)"


def side(op: str, nl: str, nr: str) -> str:
    head = f"regexp_replace(substr(lower({op}), 1, 30), {NON_WORD}, '', 'g')"
    return f"(CASE WHEN contains({nl}, {head}) THEN 'left' WHEN contains({nr}, {head}) THEN 'right' ELSE 'neither' END)"


def length(x: str) -> str:
    return f"CAST(len({split_ws(x)}) AS BIGINT)"


def except_(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda e: NOT list_contains({b}, e))"


def cov(s: str, p: str) -> str:
    return f"(CASE WHEN len({s}) > 0 THEN len(list_intersect({s}, {p})) / len({s}) ELSE 0.0 END)"


def r6(x: str) -> str:
    return f"round(({x}) * 1000000.0) / 1000000.0"


def mean(x: str, where: str | None = None) -> str:
    """Mean of doubles by whole numbers (units of 2 ** -59), so the order of the rows does not matter."""
    only = f" FILTER (WHERE {where})" if where else ""
    v, unit = f"CAST({x} AS DOUBLE)", f"CAST({1 << 59} AS DOUBLE)"
    whole, part = f"sum(CAST(trunc({v}) AS HUGEINT)){only}", f"sum(CAST(round(({v} - trunc({v})) * {unit}) AS HUGEINT)){only}"
    return f"(({whole} + {part} / {unit}) / count({x}){only})"


def rouge_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def spread(words: str, n: str) -> str:
    """At most n words, every k-th one of a list."""
    step = f"greatest(1, CAST(ceil(len({words}) / ({n})) AS BIGINT))"
    return f"array_to_string(list_transform(range(0, len({words}), {step}), lambda i: {words}[i + 1]), ' ')"
