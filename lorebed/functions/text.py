"""Column functions on text: pieces of it, counts in it, names made from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def snippet(text: Column, n: int) -> Column:
    """The first ``n`` characters, with dots only where more follow."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def snippet_always(text: Column, n: int) -> Column:
    """The first ``n`` characters with dots, unless the text is empty."""
    return F.when(F.length(text) > 0, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise("")


def short_title(title: Column, longest: int = 80) -> Column:
    """Titles longer than ``longest`` lose their end to dots, which count."""
    return F.when(F.length(title) > longest, F.concat(F.left(title, F.lit(longest - 3)), F.lit("..."))).otherwise(title)


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs without overlap; an empty term never does."""
    if not term:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def clean_wiki(text: Column) -> Column:
    """Edit marks and footnote numbers go; runs of line feeds become two and runs of blanks one."""
    text = F.regexp_replace(text, r"\[edit\]", "")
    text = F.regexp_replace(text, r"\[\d+\]", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(text, r" {2,}", " "))


def display_name(*candidates: Column, source_id: Column) -> Column:
    """The first name that isn't empty, else the id in title case."""
    named = [F.nullif(c, F.lit("")) for c in candidates]
    return F.coalesce(*named, F.initcap(F.translate(source_id, "_-", "  ")))


def any_contains(text: Column, words: list[str]) -> Column:
    """Whether one of ``words`` is in ``text``."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of ``words`` are in ``text``."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total
