"""DuckDB expressions that say the same as the Column functions, for the SQL twins."""

from __future__ import annotations

from dossierlake.functions.text import ACCENTED, PLAIN, STOPWORDS, TOKEN_FORMS


def normalize(x: str) -> str:
    shown = f"trim(replace(replace(coalesce({x}, ''), 'â€”', '—'), 'â€“', '–'))"
    return f"regexp_replace(regexp_replace(lower(translate({shown}, '{ACCENTED}', '{PLAIN}')), '\\bca\\s+phe\\b', 'coffee', 'g'), '\\bwoodchips\\b', 'wood chips', 'g')"


def raw(normalized: str) -> str:
    return f"list_filter(string_split_regex({normalized}, '[^a-z0-9.]+'), lambda t: t <> '')"


def form(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TOKEN_FORMS.items()) + f" ELSE {t} END"


def ranking(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({raw(normalize(x))}, lambda t: {form('t')}), lambda t: length(t) >= 3))"


def meaningful(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter(list_transform({raw(normalize(x))}, lambda t: {form('t')}), lambda t: (length(t) >= 3 OR regexp_matches(t, '^\\d+(?:\\.\\d+)?$')) AND t NOT IN ({stop})))"


def meaningful_in_order(x: str) -> str:
    """The meaningful tokens of a text with repeats, in order."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_transform({raw(normalize(x))}, lambda t: {form('t')}), lambda t: (length(t) >= 3 OR regexp_matches(t, '^\\d+(?:\\.\\d+)?$')) AND t NOT IN ({stop}))"


def joined(array: str) -> str:
    return f"array_to_string(list_sort({array}), '|')"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
