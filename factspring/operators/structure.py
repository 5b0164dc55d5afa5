"""Grids and outlines: header paths, carried labels, agreement of two readings, clause paths, merged candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import by_group


def carried(text: Column, over: Window) -> Column:
    """The last text that isn't empty: what a merged cell stands for."""
    return F.last(F.when(F.trim(text) != "", text), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def grid_cells(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """Body cells of grids ``(grid, row, col, text)`` with ``header`` (its column's header words from the top, empty ones taken from the left) and ``label`` (the first column's text, empty ones taken from above)."""
    heads = cells.where(F.col("row") < header_rows).withColumn("text", carried(F.col("text"), Window.partitionBy("grid", "row").orderBy("col")))
    paths = heads.groupBy("grid", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), " / ").alias("header"))
    body = cells.where(F.col("row") >= header_rows)
    first = body.where("col = 0").withColumn("label", carried(F.col("text"), Window.partitionBy("grid").orderBy("row"))).select("grid", "row", "label")
    return body.where("col > 0").join(paths, ["grid", "col"], "left").join(first, ["grid", "row"], "left").select("grid", "row", "col", "text", "header", "label")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """``grid, share, class`` of two readings ``(grid, row, col, text)``: of all places either has, those with equal text."""
    key = F.lower(F.regexp_replace("text", r"\s+", ""))
    a, b = left.select("grid", "row", "col", key.alias("a")), right.select("grid", "row", "col", key.alias("b"))
    g = a.join(b, ["grid", "row", "col"], "full_outer").groupBy("grid").agg(F.avg(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("double")).alias("share"))
    return g.select("grid", F.round("share", 6).alias("share"), F.expr("case when share = 1 then 'full' when share >= 0.8 then 'partial' else 'disagree' end").alias("class"))


def merged(candidates: DataFrame, keys: list[str], order: list[Column], evidence: str) -> DataFrame:
    """The best candidate of each key, carrying the distinct evidence of all. The pick and the evidence are made apart, each cut down before its shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = candidates.drop(evidence).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    all_ = candidates.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.array_sort(F.collect_set(evidence)).alias(evidence))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return best.join(all_, same).drop(*[f"_of_{k}" for k in keys])


_LEVELS = (re.compile(r"^(\d+(?:\.\d+)*)[.)]?\s"), re.compile(r"^\(?([a-z])\)\s"), re.compile(r"^\(?([ivx]{2,})\)\s"))


def outline(lines: list[str]) -> list[tuple[str, str]]:
    """(path, text) of the lines of a document: numbers by their dots, letters and roman numbers below them; other lines continue the last one."""
    path: list[str] = []
    out: list[tuple[str, str]] = []
    for line in (raw.strip() for raw in lines):
        if not line:
            continue
        found = next(((level, m) for level, pattern in enumerate(_LEVELS) if (m := pattern.match(line))), None)
        if not found:
            out[-1:] = [(out[-1][0], f"{out[-1][1]} {line}")] if out else [("", line)]
            continue
        level, m = found
        numbers = [p for p in path if p[0].isdigit()]
        letters = [p for p in path if not p[0].isdigit()][:1] if level == 2 else []
        path = m[1].split(".") if level == 0 else [*numbers, *letters, m[1]]
        out.append(("/".join(path), line[m.end() :].strip()))
    return out


def outlines(lines: DataFrame, doc: str, place: str, text: str) -> DataFrame:
    """``doc, seq, path, text`` of each document's lines."""
    make = lambda rows: [(rows[0][doc], i, p, t) for i, (p, t) in enumerate(outline([r[text] or "" for r in rows]), 1)]
    kind = lines.schema[doc].dataType.simpleString()
    return by_group(lines.select(doc, place, text), [doc], [place], make, f"{doc} {kind}, seq int, path string, text string")
