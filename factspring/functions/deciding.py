"""Decisions as data: what is true of a row is measured once, a table says what follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    """An outcome, and the marks that it needs and that it mustn't have (names, blank between them)."""

    outcome: tuple
    needs: str = ""
    lacks: str = ""


def marks(text: Column, patterns: dict[str, str]) -> Column:
    """A number with one bit for each pattern that a text has, in the order given; null for a null text."""
    bits = [F.when(text.rlike(pattern), F.lit(1 << i)).otherwise(F.lit(0)) for i, pattern in enumerate(patterns.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.when(text.isNotNull(), out)


def decided(seen: Column, names: list[str], cases: list[Case], fields: str) -> Column:
    """The outcome of the first case that the marks ``seen`` satisfy, as a struct of strings ``fields``; null if none does."""
    place = {n: 1 << i for i, n in enumerate(names)}

    def first(m: Column) -> Column:
        rows = []
        for case in cases:
            needs, lacks = (sum(place[n] for n in part.split()) for part in (case.needs, case.lacks))
            value = F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields.split(), case.outcome)])
            rows.append(F.when(m.bitwiseAND(F.lit(needs | lacks)) == needs, value))
        return F.coalesce(*rows)

    return F.get(F.transform(F.array(seen), first), F.lit(0))  # the marks are made once for a row, not once for each case
