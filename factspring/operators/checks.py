"""Printed figures held against each other: amounts, subtotals, pages, filed workings, ledgers, checklists, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\d[\d,]*(?:\.\d+)?"


def printed_numbers(text: Column) -> Column:
    """Numbers of a text as printed, without a comma at their end; none for a null text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.rtrim(t, F.lit(",")))


def on_their_page(rows: DataFrame, key: list[str], page: list[str], cells: Column, pages: DataFrame, text: str) -> DataFrame:
    """``page, key, holds``: whether every number of ``cells`` (a text) stands on the row's page, with or without its commas. A row without numbers holds, one with numbers and no page doesn't.

    Only the numbers of a row travel to its page, one row each, so a page's text is read once where it lies.
    """
    bare = lambda t: F.regexp_replace(t, ",", "")
    there = pages.select(*page, F.explode(F.array_distinct(F.transform(printed_numbers(F.col(text)), bare))).alias("_n")).distinct()
    asked = rows.select(*page, *key, F.explode_outer(F.array_distinct(F.transform(printed_numbers(cells), bare))).alias("_n"))
    seen = asked.join(there.withColumn("_there", F.lit(True)), [*page, "_n"], "left")
    return seen.groupBy(*page, *key).agg(F.bool_and(F.col("_n").isNull() | F.coalesce("_there", F.lit(False))).alias("holds"))


def amount_check(quantity: Column, rate: Column, amount: Column, quantity_step: str = "0.005", rate_step: str = "0.005", factor: int = 10) -> Column:
    """``match`` if an amount is quantity x rate / ``factor`` within what the rounding of all three allows, else ``differs``; null where one is missing or the quantity is nought."""
    half = lambda s: F.lit(s).cast("decimal(10,6)")
    slack = F.abs(quantity) * half(rate_step) / factor + F.abs(rate) * half(quantity_step) / factor + half("0.005")
    told = quantity.isNotNull() & rate.isNotNull() & amount.isNotNull() & (quantity != 0)
    return F.when(told, F.when(F.abs(quantity * rate / factor - amount) <= slack, "match").otherwise("differs"))


def subtotal_checks(parts: DataFrame, totals: DataFrame, keys: list[str], value: str, total: str, tolerance: str = "0.02") -> DataFrame:
    """``keys, printed, computed, difference, result`` of each printed total that has parts; a missing part counts as nought unless all are."""
    summed = parts.groupBy(*keys).agg(F.sum(value).alias("computed")).where("computed is not null")
    out = totals.where(F.col(total).isNotNull()).join(summed, keys).withColumn("difference", F.col(total) - F.col("computed"))
    return out.select(*keys, F.col(total).alias("printed"), "computed", "difference", F.when(F.abs("difference") <= F.lit(tolerance).cast("decimal(18,4)"), "match").otherwise("differs").alias("result"))


def filed_checks(rows: DataFrame, keys: list[str], bound: dict[str, tuple[Column, str]], places: int) -> DataFrame:
    """``keys, output, filed, computed, result`` of each output of a working; ``bound``: output -> (computed column, filed column).

    Equal at ``places`` decimals, halves away from nought, is a match; without a filed figure there is nothing to
    compare, without a computed one the comparison is blocked.
    """
    at = lambda c: F.round(c.cast("decimal(38,10)"), places)
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), at(F.col(filed)).alias("filed"), at(computed).alias("computed")) for o, (computed, filed) in bound.items()]))
    result = F.when(F.col("filed").isNull(), "no_filed_value").when(F.col("computed").isNull(), "blocked").when(F.col("filed") == F.col("computed"), "match").otherwise("differs")
    return rows.select(*keys, each.alias("c")).select(*keys, "c.*").withColumn("result", result)


def ledger_checks(ledger: DataFrame, group: str, amount: str, comparisons: DataFrame, groups: DataFrame, places: int) -> DataFrame:
    """``comparison, accounts, computed, filed, result``: the accounts of a comparison's groups, summed, beside its claim.

    ``comparisons`` has comparison, sign, factor and claimed; ``groups`` has comparison and the groups it names. An
    account counts once however often its group is named. The ledger is summed by group before it meets a comparison.
    """
    summed = ledger.where(F.col(amount).isNotNull()).groupBy(F.trim(F.col(group).cast("string")).alias("_g")).agg(F.sum(amount).alias("_sum"), F.count("*").alias("_n"))
    named = groups.select("comparison", F.trim(F.col(group).cast("string")).alias("_g")).distinct()
    found = named.join(summed, "_g").groupBy("comparison").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("accounts"))
    at = lambda c: F.round(c.cast("decimal(38,10)"), places)
    out = comparisons.join(found, "comparison", "left").withColumn("computed", at(F.col("_sum") * F.col("sign") * F.col("factor"))).withColumn("filed", at(F.col("claimed")))
    result = F.when(F.col("computed").isNull(), "blocked").when(F.col("filed").isNull(), "no_filed_value").when(F.col("computed") == F.col("filed"), "match").otherwise("differs")
    return out.select("comparison", F.coalesce("accounts", F.lit(0)).alias("accounts"), "computed", "filed", result.alias("result"))


def checklist(evidence: DataFrame, item: list[str], kind: str, found: str, weight: str) -> DataFrame:
    """``item, result``: what is filed for an item: ``evidenced`` when all its evidence is there and none a mere mention, ``partly``, ``mentioned``, ``not_found``, or ``outside_package`` when all of it lies elsewhere."""
    inside, hit, mention = F.col(kind) != "outside", F.coalesce(F.col(found), F.lit(False)), F.coalesce(F.col(weight) == "mention", F.lit(False))
    n = evidence.groupBy(*item).agg(F.count_if(inside).alias("_n"), F.count_if(inside & hit).alias("_hits"), F.count_if(inside & hit & mention).alias("_weak_hits"), F.count_if(inside & mention).alias("_weak"))
    result = F.when(F.col("_n") == 0, "outside_package").when(F.col("_hits") == 0, "not_found").when(F.col("_hits") == F.col("_weak_hits"), "mentioned").when((F.col("_hits") == F.col("_n")) & (F.col("_weak") == 0), "evidenced").otherwise("partly")
    return n.select(*item, result.alias("result"))


def readiness(needed: DataFrame, present: DataFrame, case: list[str], key: list[str]) -> DataFrame:
    """``case, needed, missing, ready``: how much of what a case needs it lacks."""
    there = present.select(*case, *key).distinct().withColumn("_there", F.lit(True))
    out = needed.join(there, [*case, *key], "left").groupBy(*case).agg(F.count("*").alias("needed"), F.count_if(F.col("_there").isNull()).alias("missing"))
    return out.withColumn("ready", F.col("missing") == 0)


def trace(output: str, rule: str, formula: str, inputs: dict[str, tuple[Column, str]], value: Column, places: int, unit: str) -> Column:
    """How a figure was computed: rule, formula, each input with its unit, value and rounded value."""
    return F.struct(
        F.lit(output).alias("output"), F.lit(rule).alias("rule"), F.lit(formula).alias("formula"),
        F.create_map(*[x for name, (c, u) in inputs.items() for x in (F.lit(name), F.struct(c.cast("string").alias("value"), F.lit(u).alias("unit")))]).alias("inputs"),
        value.cast("string").alias("value"), F.round(value, places).cast("string").alias("rounded"), F.lit(unit).alias("unit"),
    )


def questions(findings: DataFrame, key: Column, evidence: str, decisions: DataFrame, most: int = 8) -> DataFrame:
    """``key, asked, evidence, decision``: the questions that findings pose, how often, the first ``most`` pieces of evidence, and what was decided; decided questions stay when their findings go.

    Findings whose key is null pose none. Only the first pieces reach a list.
    """
    from .latest import top_in_group

    posed = findings.withColumn("key", key).where("key is not null")
    counts = posed.groupBy("key").agg(F.count("*").alias("asked"))
    lists = top_in_group(posed.select("key", evidence), ["key"], [F.col(evidence)], most).groupBy("key").agg(F.array_sort(F.collect_list(evidence)).alias("evidence"))
    return counts.join(lists, "key").join(decisions.select("key", "decision"), "key", "full").select("key", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("evidence", F.array().cast(posed.select(F.array(evidence)).schema[0].dataType)).alias("evidence"), "decision")


def deduplicated(readings: DataFrame, fact: list[str], order: list[Column], key: str) -> DataFrame:
    """``readings`` with ``survivor``: the key of the reading that stands for its fact, the first by ``order``; the others' evidence is its. Readings with a null in ``fact`` stand for themselves."""
    whole = F.lit(True)
    for c in fact:
        whole = whole & F.col(c).isNotNull()
    best = readings.where(whole).groupBy(*fact).agg(F.min_by(key, F.struct(*order, F.col(key))).alias("survivor"))
    return readings.join(best, fact, "left").withColumn("survivor", F.coalesce("survivor", key))


def value_rows(tables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and a row for each value of nested tables: ``factor``, ``columns`` (index, fiscal_year, voice, header) and ``lines`` (column, label, row_year, row_voice, value).

    A row's own year and voice go before its column's. Lines of an unknown column are left out.
    """
    lines = tables.select(*keys, "factor", "columns", F.explode("lines").alias("l"))
    found = lines.withColumn("c", F.get(F.filter("columns", lambda c: c["index"] == F.col("l.column")), F.lit(0))).where("c is not null")
    return found.select(
        *keys, "l.label", "l.value", F.coalesce("l.row_year", "c.fiscal_year").alias("fiscal_year"), F.coalesce("l.row_voice", "c.voice").alias("voice"), F.col("c.header").alias("column_header"),
        F.when(F.col("factor") != 0, F.round(F.col("l.value") * F.col("factor"), 4)).alias("value_crore"), F.when(F.col("l.row_year").isNotNull(), "row label").otherwise("column").alias("year_from"),
    )


def logical_columns(cells: DataFrame, grid: list[str], row: str, col: str, text: str, header_rows: int = 1) -> DataFrame:
    """``grid, col, logical``: the first of the neighbouring columns that are one column drawn as several.

    Neighbours join while no row has text in more than one of them; a group stands only if its heading and its
    figures lie in different columns. A grid's columns are folded in order as lists of their filled rows.
    """
    filled = F.coalesce(F.col(text), F.lit("")) != ""
    head = F.col(row) < header_rows
    own = cells.groupBy(*grid, col).agg(F.collect_set(F.when(filled, F.col(row))).alias("_rows"), F.bool_or(filled & head).alias("_head"), F.bool_or(filled & ~head).alias("_data"))
    listed = own.groupBy(*grid).agg(F.array_sort(F.collect_list(F.struct(F.col(col).alias("col"), F.col("_rows").alias("rows"), F.col("_head").alias("head"), F.col("_data").alias("data")))).alias("_cols"))
    state = lambda groups, at, rows: F.struct(groups.alias("groups"), at.alias("at"), rows.alias("rows"))
    kind = dict(own.select(F.col(col).alias("c"), "_rows").dtypes)
    start = state(F.array().cast(f"array<{kind['c']}>"), F.lit(None).cast(kind["c"]), F.array().cast(kind["_rows"]))

    def step(s: Column, c: Column) -> Column:
        joins = s["at"].isNotNull() & (F.size(F.array_intersect(s["rows"], c["rows"])) == 0)
        at = F.when(joins, s["at"]).otherwise(c["col"])
        return state(F.concat(s["groups"], F.array(at)), at, F.when(joins, F.array_union(s["rows"], c["rows"])).otherwise(c["rows"]))

    firsts = listed.withColumn("_first", F.aggregate("_cols", start, step, lambda s: s["groups"]))
    each = firsts.select(*grid, F.explode(F.arrays_zip("_cols", "_first")).alias("_p")).select(*grid, F.col("_p._cols.col").alias(col), F.col("_p._cols.head").alias("_head"), F.col("_p._cols.data").alias("_data"), F.col("_p._first").alias("_first"))
    sign = each.groupBy(*grid, "_first").agg(F.bool_or("_head").alias("_h"), F.bool_or("_data").alias("_d"), F.bool_or(F.col("_head") & F.col("_data")).alias("_both"), F.count("*").alias("_n"))
    return each.join(sign, [*grid, "_first"]).select(*grid, col, F.when((F.col("_n") > 1) & F.col("_h") & F.col("_d") & ~F.col("_both"), F.col("_first")).otherwise(F.col(col)).alias("logical"))
