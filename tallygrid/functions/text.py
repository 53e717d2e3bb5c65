"""String column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and the four ASCII separators, as one explicit class: the same
# characters as the Unicode space class, which is several times slower to match.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = rf"[^{_SPACE}]"
# Only runs that change: two or more, or a single one that is not a plain blank.
WHITESPACE = rf"[{_SPACE}]{{2,}}|[{_SPACE}&&[^ ]]"


def squeeze_whitespace(text: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def first_contained(text: Column, phrases: Mapping[str, str], default: str) -> Column:
    """Value of the first phrase, in mapping order, that occurs in ``text``."""
    chain = None
    for phrase, result in phrases.items():
        hit = text.contains(phrase)
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a key in a small constant table, else NULL."""
    keys, values = (F.array(*[F.lit(v) for v in side]) for side in (table, table.values()))
    return F.try_element_at(F.map_from_arrays(keys, values), key)


def longest_first(phrases: Mapping[str, object]) -> dict[str, object]:
    """Longer phrases first; equal lengths keep their order."""
    return dict(sorted(phrases.items(), key=lambda item: -len(item[0])))


def count_contained(text: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur in ``text``."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + F.when(text.contains(phrase), 1).otherwise(0)
    return total


def any_contained(text: Column, phrases: Iterable[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def any_match(text: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """True if one of the regular expressions is found; one pass with all alternatives."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    shortened = F.length(F.replace(text, F.lit(literal), F.lit("")))
    return ((F.length(text) - shortened) / len(literal)).cast("int")


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)
