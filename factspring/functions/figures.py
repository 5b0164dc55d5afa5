"""Printed figures, fiscal years, units and slabs read from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a cell that holds no number, and their states.
STATES = {"nil": "zero", "-": "not_applicable", "na": "not_applicable", "n.a.": "not_applicable", "not applicable": "not_applicable", "": "unknown"}


def figure(text: Column) -> Column:
    """``1,23,456.78``, ``(12.3)`` for negative, ``Rs. 5``, ``7 %``: a decimal, or null if the text isn't one number."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^(rs\.?|inr)\s*|\s*(%|/-)$|,", "")
    negative = bare.rlike(r"^\(\s*[0-9.]+\s*\)$|^-")
    digits = F.regexp_replace(bare, r"^[-(]\s*|\s*\)$", "")
    number = F.when(digits.rlike(r"^[0-9]+(\.[0-9]+)?$"), digits.cast("decimal(28,6)"))
    return F.when(negative, -number).otherwise(number)


def value_state(text: Column) -> Column:
    """value, zero (said in words), not_applicable, unknown or text; none of the last four is ever a number."""
    bare = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(figure(text).isNotNull(), F.lit("value"))
    for spelling, state in STATES.items():
        out = out.when(bare == spelling, F.lit(state))
    return out.otherwise(F.lit("text"))


def fiscal_year(text: Column) -> Column:
    """The one fiscal year that a text names (``FY 2024-25``, ``2024-2025``, ``2024/25``); null for none or several."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2}\s*[-/]\s*(?:(?:19|20)[0-9]{2}|[0-9]{2}))(?![0-9])"), F.lit(1))
    starts = F.transform(pairs, lambda p: F.struct(F.substring(p, 1, 4).cast("int").alias("a"), F.regexp_extract(p, r"([0-9]{2})$", 1).cast("int").alias("b")))
    valid = F.array_distinct(F.transform(F.filter(starts, lambda s: (s["a"] + 1) % 100 == s["b"]), lambda s: s["a"]))
    start = F.when(F.size(valid) == 1, F.get(valid, 0))
    return F.when(start.isNotNull(), F.concat(F.lit("FY"), start, F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")))


def unit_of(text: Column) -> Column:
    """The unit that a heading names, never a guess."""
    t = F.lower(text)
    named = [(r"rs\.?\s*(in\s*)?cr|crore", "INR_crore"), (r"lakh", "INR_lakh"), (r"paise\s*(/|per)\s*(kwh|unit)", "paise_per_kWh"), (r"rs\.?\s*(/|per)\s*(kwh|unit)", "INR_per_kWh"), (r"\bmus?\b|million units", "MU"), (r"%|per\s*cent", "percent")]
    out = F.when(t.rlike(named[0][0]), F.lit(named[0][1]))
    for pattern, unit in named[1:]:
        out = out.when(t.rlike(pattern), F.lit(unit))
    return out


def slab(text: Column) -> Column:
    """Bounds of ``up to 100``, ``101-200``, ``above 300``: struct<lower, upper>, an open end null; null if none is named."""
    t = F.lower(text)
    number = lambda pattern, i=1: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("int")
    span, top, low = r"([0-9]+)\s*(?:-|to)\s*([0-9]+)", r"(?:up\s*to|first|below)\s*([0-9]+)", r"(?:above|over|exceeding)\s*([0-9]+)"
    return (
        F.when(t.rlike(span), F.struct(number(span).alias("lower"), number(span, 2).alias("upper")))
        .when(t.rlike(top), F.struct(F.lit(0).alias("lower"), number(top).alias("upper")))
        .when(t.rlike(low), F.struct(number(low).alias("lower"), F.lit(None).cast("int").alias("upper")))
    )


def label_key(text: Column) -> Column:
    """A label's letters and digits, by which equal labels are found."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
