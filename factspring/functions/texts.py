"""What a heading, a label or a line of a document says of itself, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stage_of(fiscal_year: Column, order_year: Column) -> Column:
    """The stage at which an order speaks of a year, by how far the year lies from the order's own: both ``FYyyyy-yy``."""
    away = F.substring(fiscal_year, 3, 4).cast("int") - F.substring(order_year, 3, 4).cast("int")
    return F.when(away == 0, "ARR").when(away == -1, "APR").when(away < -1, "True-up").when(away > 0, "MYT projection")


def label_unit(label: Column) -> Column:
    """The unit in the last brackets of a label, in small letters; null if they hold no unit."""
    named = r"(?i)[(\[]\s*(?:in\s+)?((?:rs\.?|inr|₹)?\s*(?:crores?|cr\.?|lakhs?|mus?|mw|kwh|kw|paise|%)(?:\s*(?:/|per)\s*[a-z]+)?)\s*[)\]]\s*$"
    inside = F.lower(F.regexp_extract(label, named, 1))
    return F.nullif(F.regexp_replace(inside, r"\s+", " "), F.lit(""))


def token_cost(prompt: Column, answer: Column, prompt_price: float, answer_price: float) -> Column:
    """US dollars of a call at prices for a million tokens, to six places."""
    return F.round((prompt.cast("decimal(20,0)") * F.lit(prompt_price).cast("decimal(12,6)") + answer.cast("decimal(20,0)") * F.lit(answer_price).cast("decimal(12,6)")) / 1_000_000, 6)


def voltage_key(text: Column) -> Column:
    """A text in small letters and single blanks, with ``11 KV``, ``11kv.`` and ``11-kV`` as ``11kv``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"([0-9]+(?:\.[0-9]+)?)[ -]*k\.? ?v\b\.?", "$1kv"), r"\s+", " "))


def block_letter(text: Column) -> Column:
    """The letter of a lettered block, ``(B)``, ``B.`` or ``Block B``, as a capital."""
    return F.upper(F.nullif(F.regexp_extract(text, r"(?i)^\s*(?:block\s+)?\(?([a-z])(?:[).:]|\s*$)", 1), F.lit("")))


def time_band(text: Column) -> Column:
    """struct<start, end> in minutes of ``22:00 to 06:00 hrs`` and ``6 am - 10 pm``; null for others."""
    clock = r"(?i)([0-9]{1,2})(?:[:.]([0-9]{2}))?\s*([ap]\.?m\.?)?"
    pattern = rf"{clock}\s*(?:hrs?\.?|hours)?\s*(?:-|–|to)\s*{clock}"

    def minutes(first: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, first + i)
        hour, half = part(0).cast("int"), F.lower(part(2))
        hour = F.when(half.startswith("p") & (hour < 12), hour + 12).when(half.startswith("a") & (hour == 12), 0).otherwise(hour)
        return (hour * 60 + F.coalesce(F.nullif(part(1), F.lit("")).cast("int"), F.lit(0))) % 1440

    return F.when(text.rlike(pattern), F.struct(minutes(1).alias("start"), minutes(4).alias("end")))


def contents_page(text: Column, least: int = 5) -> Column:
    """Whether a page lists contents: ``least`` lines or more that begin with words and end in dots or blanks and a page number. Only a line's ends are looked at."""
    ends = lambda line: F.right(F.rtrim(line), F.lit(8)).rlike(r"(?:\.{3}|\s{3})\s?[0-9]{1,4}$") & line.rlike(r"^\s*[^\s.0-9]")
    return F.size(F.filter(F.split(text, r"\r?\n"), ends)) >= least


def snippet(text: Column, at: Column, width: int) -> Column:
    """``width`` characters around a place (from 0), white space as single blanks."""
    first = F.greatest(F.lit(0), at - width // 2)
    return F.trim(F.regexp_replace(F.substring(text, first + 1, F.lit(width)), r"\s+", " "))


def whole_objects(text: Column, schema: str) -> Column:
    """The complete leading objects of a JSON array that breaks off, of flat objects."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.from_json(o, schema))


def pipe_cells(line: Column) -> Column:
    """Cells of a line of a pipe table; null for other lines and for the rule under its header."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.when(F.trim(line).rlike(r"^\|.*\|$") & ~inner.rlike(r"^[\s|:-]+$"), F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c)))


def tall_rows(cells: Column) -> Column:
    """Rows of a row whose cells hold as many lines each (cells of one line stand in all); the row itself if they differ."""
    lines = F.transform(cells, lambda c: F.split(c, "\n", -1))
    most = F.array_max(F.transform(lines, lambda c: F.size(c)))
    even = F.forall(lines, lambda c: (F.size(c) == most) | (F.size(c) == 1))
    return F.when(even, F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.transform(lines, lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.get(c, i))))).otherwise(F.array(cells))
