"""Rules as SQL text that Spark and DuckDB both read, so that one statement of a rule is planned by either.

Text functions used: contains, lower, trim, coalesce, least, greatest, length, concat, CASE. ``regexp_like`` is Spark's name;
``for_duckdb`` renames it.
"""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_in(column: str, words: Iterable[str]) -> str:
    """Some word is part of the lower-cased value; false for null."""
    return "coalesce(" + " OR ".join(f"contains(lower({column}), {text(w)})" for w in words) + ", false)"


def hits_in(column: str, words: Iterable[str]) -> str:
    """How many of the words are part of the lower-cased value."""
    return "(" + " + ".join(f"CASE WHEN contains(lower({column}), {text(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def first_of(tests: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    """CASE over (condition, value)."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in tests) + f" ELSE {default} END"


def most_hits(column: str, groups: dict[str, tuple[str, ...]]) -> str:
    """The group with the most words in the value, ties by order; null without any."""
    scores = "array(" + ", ".join(hits_in(column, words) for words in groups.values()) + ")"
    names = "array(" + ", ".join(map(text, groups)) + ")"
    return f"CASE WHEN array_max({scores}) > 0 THEN element_at({names}, CAST(array_position({scores}, array_max({scores})) AS INT)) END"


def filled(column: str) -> str:
    return f"(trim(coalesce({column}, '')) <> '')"


def matches(column: str, pattern: str) -> str:
    """Some part of the value matches; ASCII classes; false for null."""
    return f"coalesce(regexp_like({column}, r'{pattern}'), false)"


#: Spark's names and DuckDB's.
NAMES = {"regexp_like(": "regexp_matches(", " r'": " '", "array_max(": "list_max(", "array_position(": "list_position(", "element_at(": "list_extract(", "array(": "list_value("}


def for_duckdb(sql: str) -> str:
    for spark, duckdb in NAMES.items():
        sql = sql.replace(spark, duckdb)
    return sql
