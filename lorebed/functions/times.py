"""Dates, durations and time codes written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration with hours, minutes and seconds; 0 if it is none."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"^PT.*?(\d+){unit}", 1), F.lit("")), F.lit("999999999")), F.lit(0))
    total = part("H") * 3600 + part("M") * 60 + part("S")
    return F.coalesce(F.when(text.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$"), total.cast("int")), F.lit(0))


def code_seconds(code: Column) -> Column:
    """Seconds of ``H:M:S,ms``, ``M:S`` or a plain number; 0 if it is none."""
    clean = F.replace(F.trim(F.coalesce(code, F.lit(""))), F.lit(","), F.lit("."))
    parts = F.transform(F.split(clean, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.coalesce(F.when(F.size(parts) <= 3, total), F.lit(0.0))


def pdf_date(text: Column) -> Column:
    """``D:20240131120000Z`` and shorter forms as ISO text; null if there are fewer than four digits."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{4,14})", 1)
    cut = lambda a, n: F.substring(digits, a, n)
    day = F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2))
    whole = F.concat(day, F.lit("T"), F.concat_ws(":", cut(9, 2), cut(11, 2), cut(13, 2)))
    return F.when(F.length(digits) >= 14, whole).when(F.length(digits) >= 8, day).when(F.length(digits) >= 4, cut(1, 4))
