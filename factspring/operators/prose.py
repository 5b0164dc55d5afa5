"""What prose decides, and what surrounds a figure: sentences with their places, decisions, the nearest title, caption and reasoning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How orders word their decisions on network charges.
SURCHARGE_NIL = r"(?i)additional surcharge[^.\n]{0,80}\b(as|at|to be|is|shall be)\s+(zero|nil)\b"
SURCHARGE_NOT_LEVIED = r"(?i)additional surcharge[^.\n]{0,120}(shall not be levied|not be levied|will not be levied)[^.\n]{0,120}(petition|filing)"
SURCHARGE_DEFERRED = r"(?i)additional surcharge[^.\n]{0,160}(separate petition|file(d)? separately|separately)"
BANKING_BY_REFERENCE = r"(?i)\bbanking\b[^.\n]{0,160}\b(as (specified|provided|per)|in accordance with)\b[^.\n]{0,120}(regulations?|orders?)"
OPEN_ACCESS_LOSS = r"(?i)open access consumers? connected (?:at|below|above)\s+([^,;:]{2,40}?),?\s*(\d+(?:\.\d+)?)\s*%\s*(distribution|wheeling|transmission)?\s*loss(?:es)?\s+(?:shall|will|would|is to) apply"
TRANSMISSION_VALUE = r"(?i)\b((?:inter|intra)[- ]?state\s+)?transmission\s+(loss(?:es)?|charges?)\s*(?:of|at|@|is|shall be|=|\()?\s*(?:Rs\.?\s*)?(\d+(?:\.\d+)?)\s*(%|percent|paise|ps|Rs\.?/kWh|per (?:kWh|unit))?"
TRANSMISSION_REFERENCE = r"(?i)\btransmission\s+(?:loss(?:es)?|charges?|tariff)\b[^.\n]{0,120}?\b(as (?:per|determined|approved|specified)|determined by|in accordance with|order dated|separate order|SLDC|STU|[A-Z]{2,}TCL)\b"

#: Where a sentence ends: a stop and a blank, but not after a short form that a figure or name follows.
SENTENCE_END = r"(?<=[.;])(?<!\b(?:Rs|No|Nos|Sr|viz)\.)\s+"
NONE = "cast(null as string)"


@dataclass(frozen=True)
class Decision:
    """A family and the status that a pattern says of it. Of a family's decisions a sentence takes the first; with ``target`` the reference runs on from the pattern's first group."""

    family: str
    status: str
    state: str
    pattern: str
    target: bool = False


DECISIONS = [
    Decision("additional_surcharge", "approved_zero", "zero", SURCHARGE_NIL),
    Decision("additional_surcharge", "not_levied_pending_petition", "absent_in_source", SURCHARGE_NOT_LEVIED),
    Decision("additional_surcharge", "deferred_to_separate_petition", "absent_in_source", SURCHARGE_DEFERRED),
    Decision("banking_rule", "by_reference", "absent_in_source", BANKING_BY_REFERENCE, True),
]


def sentences(lines: DataFrame, key: list[str], text: str) -> DataFrame:
    """``*key, sentence_no, start, sentence``: the sentences of each line, ``start`` from 0 in its characters. Null and blank lines have none."""
    # what is before a sentence: the sentences before it and the blanks that part them, all inside one row, so repeated rows keep apart
    cut = F.split(F.col(text), SENTENCE_END, -1)
    gaps = F.regexp_extract_all(F.col(text), F.lit(f"(?:{SENTENCE_END})"), F.lit(0))
    taken = F.zip_with(cut, gaps, lambda s, g: F.length(s) + F.coalesce(F.length(g), F.lit(0)))
    pieces = lines.select(*key, taken.alias("_taken"), F.posexplode(cut).alias("_i", "_s"))
    before = F.aggregate(F.slice("_taken", F.lit(1), F.col("_i")), F.lit(0), lambda a, n: a + n)
    lead = F.length("_s") - F.length(F.ltrim("_s"))
    return pieces.select(*key, F.col("_i").alias("sentence_no"), (before + lead).cast("long").alias("start"), F.trim("_s").alias("sentence")).where("sentence <> ''")


def _fact(family, status, state, found, value=NONE, unit=NONE, level=NONE, target=NONE) -> Column:
    as_text = lambda c: (c if isinstance(c, Column) else F.expr(c)).cast("string")
    parts = {"family": F.lit(family), "status": status if isinstance(status, Column) else F.lit(status), "state": F.lit(state), "value": as_text(value), "unit": as_text(unit), "level": as_text(level), "target": as_text(target), "found": found}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _onward(text: Column, pattern: str, groups: int, shown: int) -> Column:
    """The text from the first match's group 1 on, ``shown`` characters."""
    whole = F.regexp_extract(text, pattern, 0)
    # the group's own place: what stands before it is the match less everything from its last occurrence on
    inner = F.regexp_extract(text, pattern, 1)
    at = F.instr(text, whole) + F.length(whole) - F.length(F.call_function("substring_index", whole, inner, F.lit(-1))) - F.length(inner)
    return F.substring(text, at, F.lit(shown))


def decisions(lines: DataFrame, key: list[str], text: str, shown: int = 200) -> DataFrame:
    """``*key, sentence_no, start, sentence, family, status, state, value, unit, level, target, found`` of what each sentence decides on network charges.

    A sentence is judged alone: words of one carry nothing into the next. One sentence takes the first status of a family
    (nil, then not levied, then deferred), every loss of open access consumers by level, and every printed transmission charge or loss, as an
    input of other orders where the sentence refers to one. ``target`` runs from the referring words on, to ``shown`` characters. A sentence without any has no row.
    """
    s = F.col("sentence")
    cases = {}
    for d in DECISIONS:
        fact = _fact(d.family, d.status, d.state, F.regexp_extract(s, d.pattern, 0), target=_onward(s, d.pattern, 1, shown) if d.target else NONE)
        cases.setdefault(d.family, []).append(F.when(s.rlike(d.pattern), fact))
    one = [F.coalesce(*c) for c in cases.values()]
    losses = F.transform(
        F.regexp_extract_all(s, F.lit(OPEN_ACCESS_LOSS), F.lit(0)),
        lambda m: _fact("oa_loss", "approved", "value", m, F.regexp_extract(m, OPEN_ACCESS_LOSS, 2), F.lit("percent"), F.trim(F.regexp_extract(m, OPEN_ACCESS_LOSS, 1))),
    )
    refers = s.rlike(TRANSMISSION_REFERENCE)

    def carried(m: Column) -> Column:
        kind = F.lower(F.regexp_extract(m, TRANSMISSION_VALUE, 2))
        printed = F.lower(F.regexp_extract(m, TRANSMISSION_VALUE, 4))
        share = kind.startswith("loss") | printed.isin("%", "percent")
        unit = F.when(share, "percent").when(printed.isin("paise", "ps"), "paise").when(printed != "", "INR_per_kWh")
        level = F.trim(F.concat(F.lower(F.trim(F.regexp_extract(m, TRANSMISSION_VALUE, 1))), F.lit(" transmission")))
        status = F.when(refers, "by_reference").otherwise("parameter_specified")
        return _fact("transmission_reference", status, "value", m, F.regexp_extract(m, TRANSMISSION_VALUE, 3), unit, level, F.when(refers, _onward(s, TRANSMISSION_REFERENCE, 1, shown)))

    carried_values = F.transform(F.regexp_extract_all(s, F.lit(TRANSMISSION_VALUE), F.lit(0)), carried)
    found = F.concat(F.filter(F.array(*one), lambda x: x.isNotNull()), losses, carried_values)
    # only sentences with a word of one of the families are looked at closely
    near = sentences(lines, key, text).where(s.rlike("(?i)surcharge|banking|open access|transmission"))
    return near.select(*key, "sentence_no", "start", "sentence", F.inline(found))


PROSE_WORDS, REAL_WORDS = 6, 4  # words of a line of prose at least, and those of three letters or more among them
CAPTION = r"(?i)^\s*Table\s+\d+[-–.]\d+[A-Za-z]?\b"


def is_prose(text: Column) -> Column:
    """At least six words, four of them with three letters on end or more: no run of cells."""
    real = F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0)))
    return F.coalesce((F.size(F.filter(F.split(text, r"[ \t]+"), lambda w: w != "")) >= PROSE_WORDS) & (real >= REAL_WORDS), F.lit(False))


def surroundings(lines: DataFrame, key: list[str], line_no: str, text: str, candidate: Column, roles: dict[str, Column], after: tuple[str, ...] = ()) -> DataFrame:
    """``*key, line_no, text`` of the candidate lines with, for each role, the nearest line of that role above (``<role>``, ``<role>_weight``) and, for roles in ``after``, below (``<role>_after``, ``<role>_after_weight``).

    A line's weight is 1 / (1 + lines between and one). A candidate isn't its own surrounding; without such a line there are nulls.
    One pass over a document's lines in order, with no join by ranges; a line may have several roles; rows of equal place take either order.
    """
    w = Window.partitionBy(*key).orderBy(line_no)
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    place = lambda role: F.when(F.col(f"_is_{role}"), F.struct(F.col(line_no).alias("at"), F.col(text).alias("text")))
    marked = lines.select(*key, line_no, text, candidate.alias("_candidate"), *[c.alias(f"_is_{r}") for r, c in roles.items()])
    near = {r: F.last(place(r), ignorenulls=True).over(up) for r in roles} | {f"{r}_after": F.first(place(r), ignorenulls=True).over(down) for r in after}
    out = marked.select(*key, line_no, text, "_candidate", *[c.alias(n) for n, c in near.items()]).where("_candidate")
    weight = lambda n: (1 / (1 + F.abs(F.col(line_no) - F.col(f"{n}.at")))).alias(f"{n}_weight")
    return out.select(*key, line_no, text, *[c for n in near for c in (F.col(f"{n}.text").alias(n), weight(n))])


def naming(spoken: DataFrame, asked: DataFrame, key: list[str], order: list[str], most: int = 2) -> DataFrame:
    """``*key, token, sentences`` of the first ``most`` sentences of prose in a document that hold a token asked for (``asked``: key, token).

    ``spoken`` has ``*key, *order, sentence, tokens``. Each token of a document is cut to its first sentences before it meets what is asked, so a common one makes no pairs.
    """
    each = spoken.where(is_prose(F.col("sentence"))).select(*key, F.struct(*order, "sentence").alias("_s"), F.explode(F.array_distinct("tokens")).alias("token"))
    wanted = each.join(asked.select(*key, "token").distinct(), [*key, "token"], "left_semi")
    w = Window.partitionBy(*key, "token").orderBy("_s")
    first = wanted.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    return first.groupBy(*key, "token").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["sentence"]).alias("sentences"))
