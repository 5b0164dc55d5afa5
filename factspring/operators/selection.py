"""What is taken, linked or let through: pages under a cap, profiles, budgets, slots, conditions, scopes, label search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chosen_pages(pages: DataFrame, document: list[str], page: str, tabled: Column, readable: Column, most: int, most_unread: int, reach: int = 1) -> DataFrame:
    """``document, page, why`` of the pages to convert: readable ones with tables first, then those within ``reach`` of one, at most ``most``; and the first ``most_unread`` pages without text.

    Nearer pages go first, then those of earlier tables, then the page before a table. Distances come from two window
    functions over a document's pages, so no page is paired with another. Each page is one row.
    """
    w = Window.partitionBy(*document).orderBy(page)
    before = F.last(F.when(tabled, F.col(page)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(F.when(tabled, F.col(page)), ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = pages.withColumn("_readable", readable).withColumn("_back", F.col(page) - before).withColumn("_on", after - F.col(page))
    distance = F.least("_back", "_on")  # nulls are passed over
    near = near.withColumn("_key", F.struct(distance.alias("d"), F.when(F.col("_back") == distance, F.col(page) - distance).otherwise(F.col(page) + distance).alias("of"), F.when(F.col("_back") == distance, 1).otherwise(0).alias("side")))
    within = near.where("not _readable").select(*document, page, F.lit("no text").alias("why"), F.struct(F.lit(0).alias("d"), F.col(page).alias("of"), F.lit(0).alias("side")).alias("_key"))
    within = within.unionByName(near.where(F.col("_readable") & (F.col("_key.d") <= reach)).select(*document, page, F.when(F.col("_key.d") == 0, "table").otherwise("beside a table").alias("why"), "_key"))
    unread = F.col("why") == "no text"
    order = Window.partitionBy(*document, unread).orderBy("_key", page)
    return within.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.when(unread, most_unread).otherwise(most)).select(*document, page, "why")


def profile(headings: DataFrame, document: list[str], kind: str, profiles: dict[str, str]) -> DataFrame:
    """``document, profile, why``: the profile whose kind of heading a document has most of; none for a tie or without such headings."""
    counts = headings.groupBy(*document).agg(*[F.count_if(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(profiles)])
    most = F.greatest(*[F.col(f"_{i}") for i in range(len(profiles))]) if len(profiles) > 1 else F.col("_0")
    best = F.array_compact(F.array(*[F.when(F.col(f"_{i}") == F.col("_most"), F.lit(p)) for i, p in enumerate(profiles.values())]))
    counts = counts.withColumn("_most", most).withColumn("_best", F.array_sort(best))
    tie = F.size("_best") > 1
    why = F.when(F.col("_most") == 0, "no headings of a known kind").when(tie, F.concat(F.lit("a tie of "), F.concat_ws(", ", "_best"))).otherwise(F.concat(F.col("_most").cast("string"), F.lit(" headings")))
    return counts.select(*document, F.when((F.col("_most") > 0) & ~tie, F.get("_best", F.lit(0))).alias("profile"), why.alias("why"))


def budgeted(requests: DataFrame, day: list[str], agent: str, order: list[str], estimate: Column, spent: Column, daily: float, each: dict[str, float]) -> DataFrame:
    """``requests`` with ``refused``: why a request would pass the day's cap or its agent's, given what was recorded as spent before it; null if it may go on. ``order`` must not have ties."""
    before = Window.partitionBy(*day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*day, agent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total, mine = F.coalesce(F.sum(spent).over(before), F.lit(0)) + estimate, F.coalesce(F.sum(spent).over(own), F.lit(0)) + estimate
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in each.items() for x in kv]), F.col(agent)) if each else F.lit(None).cast("double")
    return requests.withColumn("refused", F.when(total > daily, "over the daily cap").when(mine > cap, "over its own cap"))


def fenced(writes: DataFrame, jobs: DataFrame, job: str, run: str) -> DataFrame:
    """``writes`` with ``accepted``: whether the run that writes still holds its job; runs that lost their lease write nothing."""
    held = jobs.select(job, F.col(run).alias("_run"))
    return writes.join(held, job, "left").withColumn("accepted", F.coalesce(F.col(run) == F.col("_run"), F.lit(False))).drop("_run")


def next_stages(done: DataFrame, document: list[str], stage: str, chain: list[str]) -> DataFrame:
    """``document, stage`` to enqueue: the stage of ``chain`` after the furthest that a document has done, none after the last."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, chain)), F.col(stage)), F.lit(0))  # a stage outside the chain counts for nothing
    far = done.groupBy(*document).agg(F.max(place).alias("_at"))
    return far.select(*document, F.get(F.array(*map(F.lit, chain)), F.col("_at").cast("int")).alias(stage)).where(F.col(stage).isNotNull())


def enveloped(rows: DataFrame, batch: list[str], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """``batch, rows, bytes, status`` of every batch: 413 for one with too many rows or bytes, else 200."""
    out = rows.groupBy(*batch).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    return out.withColumn("status", F.when((F.col("rows") > most_rows) | (F.col("bytes") > most_bytes), 413).otherwise(200))


def reconciled(sources: DataFrame, slots: DataFrame, keys: list[str], source: str) -> DataFrame:
    """``keys, source, state`` of every source: linked to the free slot of its keys, linked to one created for it, its slot's already, or the slot is held by another. Of several sources the least takes the slot."""
    least = sources.groupBy(*keys).agg(F.min(source).alias("_first"))
    held = slots.groupBy(*keys).agg(F.min(source).alias("_holder"), F.lit(True).alias("_slot"))
    seen = sources.join(least.join(held, keys, "left"), keys)
    state = (
        F.when(F.col("_holder") == F.col(source), "already").when(F.col("_holder").isNotNull() | (F.col("_first") != F.col(source)), "held by another")
        .when(F.col("_slot"), "linked").otherwise("created")
    )
    return seen.select(*keys, source, state.alias("state"))


def unlinked(conditions: DataFrame, condition: str, known: DataFrame, text: str, least: int = 12) -> DataFrame:
    """``conditions`` that no known text equals, nor (from ``least`` characters on) contains. Both columns are plain texts.

    A contained condition's first ``least`` characters stand somewhere in the known text, so distinct windows of that
    length are joined by equality and only what meets there is compared whole.
    """
    asked, told = conditions.select(F.col(condition).alias("_c")).distinct(), known.select(F.col(text).alias("_t")).distinct()
    same = asked.join(told, F.col("_c") == F.col("_t"), "left_semi").select("_c")
    at = F.when(F.length("_t") >= least, F.sequence(F.lit(1), F.length("_t") - least + 1)).otherwise(F.array().cast("array<int>"))
    windows = told.select("_t", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("_t", i, F.lit(least))))).alias("_w"))
    inside = asked.where(F.length("_c") >= least).withColumn("_w", F.substring("_c", 1, least)).join(windows, "_w").where(F.contains("_t", "_c")).select("_c")
    return conditions.join(same.union(inside).distinct(), F.col(condition) == F.col("_c"), "left_anti")


def in_scope(scope: Column, family: Column, category: Column, categories: list[str], families: list[str]) -> Column:
    """Whether a candidate belongs to what is published: all of a whole schedule, retail ones by category, others by family."""
    return (scope == "whole_schedule") | F.when(family == "retail_tariff", F.coalesce(category, F.lit("")).isin(*categories)).otherwise(family.isin(*families))


def publishable(status: Column, second: Column) -> Column:
    return F.coalesce(status.isin("approved", "corrected") & second.isin("not_required", "done"), F.lit(False))


def included(regions: DataFrame, notes: DataFrame, region: str, version: str, excluded: str) -> DataFrame:
    """``regions`` that the last note on them, by version, doesn't exclude; regions without a note stay, and of notes of one version one that excludes counts."""
    last = notes.groupBy(region).agg(F.max(F.struct(version, excluded))[excluded].alias("_out"))
    return regions.join(last.where("_out"), region, "left_anti")


#: Order of families and components in a document.
FAMILIES = {"retail_tariff": 0, "wheeling_charge": 10, "oa_loss": 11, "distribution_loss_approved": 12, "cross_subsidy_surcharge": 13, "additional_surcharge": 14, "banking_rule": 15, "green_tariff": 16, "transmission_reference": 17}
COMPONENTS = ("fixed", "demand", "energy", "minimum", "tod_adjustment", "rebate", "surcharge", "subsidy", "green_premium", "charge", "loss", "condition", "cross_reference")
SEVERITIES = {"block": 0, "warn": 1}


def place_of(value: Column, places: dict[str, int], other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), value), F.lit(other))


def document_keys(family: str, page: str, grid: str, category: str, component: str, row: str, col: str, line: str, key: str) -> list[Column]:
    """Sort keys of candidates in the order of their document; what is null comes first."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [place_of(F.col(family), FAMILIES, 50), zero(page), zero(grid), F.coalesce(F.col(category), F.lit("")), place_of(F.col(component), {c: i for i, c in enumerate(COMPONENTS)}, 50), zero(row), zero(col), zero(line), F.col(key)]


def severity_keys(severity: str, raised: str, key: str) -> list[Column]:
    """Sort keys of findings: those that block first, then warnings, the newest of each first."""
    return [place_of(F.col(severity), SEVERITIES, 2), F.col(raised).desc(), F.col(key).desc()]


def found_by_words(rows: DataFrame, words: list[str], searched: list[str], ranked: list[str], ties: list[Column], k: int) -> DataFrame:
    """The best ``k`` rows that have every word among ``searched``, with ``score``: how often the words stand in ``ranked``, for each word there; then by ``ties``."""
    split = lambda columns: F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = split(ranked)
    hits = F.size(F.filter(own, lambda w: w.isin(*words)))
    out = rows.withColumn("_all", split(searched)).where(F.size(F.array_intersect("_all", F.array(*map(F.lit, words)))) == len(set(words)))
    return out.withColumn("score", hits / F.greatest(F.size(own), F.lit(1))).drop("_all").orderBy(F.col("score").desc(), *ties).limit(k)


def search_mode(chunks: DataFrame, embedded: Column) -> DataFrame:
    """One row ``total, embedded, mode, why``: hybrid search, or full text with the reason."""
    out = chunks.agg(F.count("*").alias("total"), F.count_if(embedded).alias("embedded"))
    why = F.when(F.col("total") == 0, "nothing has been indexed yet").when(F.col("embedded") == 0, "no chunk has an embedding yet")
    return out.withColumn("mode", F.when(why.isNull(), "hybrid").otherwise("full_text")).withColumn("why", why)
