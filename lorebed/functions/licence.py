"""Licence categories, families and the allow-list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_contains

#: Words by category, first hit decides (fixed values).
CATEGORIES = {
    "public_domain": ["public domain", "cc0", "government work", "pd"],
    "open_access": ["cc-by", "cc by", "creative commons", "open access", "cc-sa", "attribution"],
    "restricted": ["all rights reserved", "copyright", "restricted", "proprietary"],
}
#: Patterns by family, tried in this order on lower-case text (fixed values).
FAMILIES = {
    "CC-BY-SA": [r"creative\s*commons.*share\s*alike", r"cc[- ]by[- ]sa", r"attribution.*sharealike"],
    "CC-BY": [r"creative\s*commons.*attribution(?!.*share)", r"cc[- ]by(?![- ]sa|[- ]nc)"],
    "CC-BY-NC": [r"creative\s*commons.*non\s*commercial", r"cc[- ]by[- ]nc(?![- ]sa)"],
    "CC-BY-NC-SA": [r"cc[- ]by[- ]nc[- ]sa", r"attribution.*noncommercial.*sharealike"],
    "CC0": [r"cc0", r"public\s*domain\s*dedication", r"creative\s*commons\s*zero"],
    "Public Domain": [r"public\s*domain", r"no\s*copyright", r"free\s*of\s*known\s*copyright"],
    "MIT": [r"mit\s*license", r"permission\s*is\s*hereby\s*granted.*mit"],
    "GPL": [r"gnu\s*general\s*public\s*license", r"gpl[- ]?\d"],
    "Open Access": [r"open\s*access", r"freely\s*available"],
}
#: Licences that may be published (fixed values).
ALLOWED = (
    "CC0", "CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-NC-SA", "Public Domain", "MIT", "Apache-2.0", "GPL", "GFDL", "ODbL", "Custom",
)
LEAST_NOTES = 20


def category(licence: Column) -> Column:
    low = F.lower(F.coalesce(licence, F.lit("")))
    found = F.when(low == "", "unknown")
    for name, words in CATEGORIES.items():
        found = found.when(any_contains(low, words), name)
    return found.otherwise("unknown")


def hostable(category: Column) -> Column:
    return category.isin("public_domain", "open_access")


def family(text: Column) -> Column:
    """The first family with a pattern in the text, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = None
    for name, patterns in FAMILIES.items():
        fits = low.rlike("|".join(f"({p})" for p in patterns))
        found = F.when(fits, name) if found is None else found.when(fits, name)
    return found


def allowed(licence: Column, notes: Column) -> Column:
    """Whether the allow-list has a licence, with or without its version; a custom one needs notes."""
    plain = F.lower(F.trim(F.coalesce(licence, F.lit(""))))
    unversioned = F.regexp_replace(plain, r"\s*\d+(\.\d+)?\s*$", "")
    dashed = F.replace(F.replace(unversioned, F.lit(" "), F.lit("-")), F.lit("--"), F.lit("-"))
    noted = F.length(F.trim(F.coalesce(notes, F.lit("")))) >= LEAST_NOTES
    out = F.lit(False)
    for name in ALLOWED:
        low = name.lower()
        fits = (plain == low) | (unversioned == low) | (dashed == low)
        if low.startswith("cc"):
            fits = fits | F.contains(dashed, F.lit(low))
        out = out | (fits & noted if name == "Custom" else fits)
    return (plain != "") & out
