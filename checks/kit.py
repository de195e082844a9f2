"""Small builders for the checking SQL (DuckDB dialect)."""

from __future__ import annotations

STAMP = "'%Y-%m-%d %H:%M:%S'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_word(column: str, words) -> str:
    """True when the text contains one of the words."""
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def word_hits(column: str, words) -> str:
    """List of the contained words, in list order."""
    cases = ", ".join(f"CASE WHEN contains({column}, {quoted(w)}) THEN {quoted(w)} END" for w in words)
    return f"list_filter([{cases}], lambda w: w IS NOT NULL)"


def first_label(column: str, rules) -> str:
    whens = " ".join(f"WHEN {any_word(column, words)} THEN {quoted(label)}" for label, words in rules)
    return f"CASE {whens} END"


def in_list(column: str, words) -> str:
    return f"{column} IN ({', '.join(quoted(w) for w in words)})"


def joined(list_expr: str) -> str:
    return f"array_to_string({list_expr}, ',')"


def canonical(url: str) -> str:
    """Host of a URL: lower case, no port, one leading ``www.`` removed."""
    with_scheme = f"CASE WHEN contains({url}, '://') THEN {url} ELSE 'http://' || {url} END"
    host = f"split_part(lower(regexp_extract({with_scheme}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':', 1)"
    return f"nullif(regexp_replace({host}, '^www\\.', ''), '')"


def registrable(host: str) -> str:
    """Registrable domain of a host."""
    from leadlens.lexicon import MULTI_SUFFIXES

    parts = f"string_split({host}, '.')"
    last2 = f"array_to_string(list_slice({parts}, -2, -1), '.')"
    last3 = f"array_to_string(list_slice({parts}, -3, -1), '.')"
    return (
        f"CASE WHEN len({parts}) <= 2 THEN {host} WHEN {in_list(last2, MULTI_SUFFIXES)} THEN {last3} ELSE {last2} END"
    )


def stamp(column: str) -> str:
    return f"strftime({column}, {STAMP})"


def hours(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 3600000000.0"


def steady(value: str, digits: int) -> str:
    """Half-up rounding of a double taken to 12 decimals."""
    return f"CAST(round(CAST({value} AS DECIMAL(22,12)), {digits}) AS DOUBLE)"
