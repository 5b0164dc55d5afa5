"""Contracts of incoming rows, replay, work queues and review queues, as column rules and aggregates with columns given by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a column of an incoming row must be."""

    name: str
    required: bool = True
    among: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    like: str = ""


def reject_reason(contract: list[Field]) -> Column:
    """The first fault of a row by the order of the contract; null for a row that holds."""
    faults = []
    for f in contract:
        c = F.col(f.name)
        if f.required:
            faults.append(F.when(c.isNull(), F.lit(f"{f.name}: missing")))
        if f.among:
            faults.append(F.when(~c.isin(*f.among), F.lit(f"{f.name}: not one of {', '.join(f.among)}")))
        if f.low is not None:
            faults.append(F.when(c < f.low, F.lit(f"{f.name}: under {f.low}")))
        if f.high is not None:
            faults.append(F.when(c > f.high, F.lit(f"{f.name}: over {f.high}")))
        if f.like:
            faults.append(F.when(~c.cast("string").rlike(f.like), F.lit(f"{f.name}: malformed")))
    return F.coalesce(*faults, F.lit(None).cast("string"))


def replayed(rows: DataFrame, whole: list[str], keys: list[str], order: str, marker: Column) -> DataFrame:
    """Rows that stand after a replay: of each ``whole`` those from its last ``marker`` on, of these the last by ``order`` of each key. Both picks are aggregates, so no group is sorted."""
    last = rows.groupBy(*whole).agg(F.max(F.when(marker, F.col(order))).alias("_from"))
    valid = rows.join(last, whole).where(F.col("_from").isNull() | (F.col(order) >= F.col("_from"))).drop("_from")
    kept = valid.groupBy(*keys).agg(F.max_by(F.struct(*valid.columns), order).alias("_row"))
    return kept.select("_row.*")


def claim(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """``id, event`` of the next ``n`` jobs by priority, age and id: those queued whose time has come and those whose lease has run out.

    ``jobs`` has id, status, attempts, max_attempts, priority, created, run_after and lease_expires. An event is claimed,
    lease_expired_reclaimed, or retries_exhausted for a job that has had all its attempts (it fails instead).
    """
    expired = (F.col("status") == "leased") & (F.col("lease_expires") < now)
    free = jobs.where((F.col("status") == "queued") & (F.coalesce("run_after", now) <= now) | expired)
    event = F.when(F.col("attempts") + 1 > F.col("max_attempts"), "retries_exhausted").when(F.col("status") == "leased", "lease_expired_reclaimed").otherwise("claimed")
    return free.orderBy("priority", "created", "id").limit(n).select("id", event.alias("event"))


def failed(jobs: DataFrame, now: Column, base_seconds: int, longest_seconds: int) -> DataFrame:
    """Jobs after a failure: queued again after a delay that doubles with each attempt, or failed when attempts are used up or a retry makes no sense (``retryable``)."""
    again = F.col("retryable") & (F.col("attempts") < F.col("max_attempts"))
    delay = F.least(F.lit(longest_seconds), base_seconds * F.pow(F.lit(2), F.col("attempts"))).cast("long")
    return jobs.select("id", F.when(again, "queued").otherwise("failed").alias("status"), F.when(again, F.timestamp_seconds(F.unix_timestamp(now) + delay)).alias("run_after"))


def invalidated(states: DataFrame, document: list[str], stage: str, rerun: DataFrame) -> DataFrame:
    """``states`` with ``stale``: whether the stage comes after one that runs again (``rerun``: document, stage) of its document."""
    first = rerun.groupBy(*document).agg(F.min(stage).alias("_from"))
    return states.join(first, document, "left").withColumn("stale", F.coalesce(F.col(stage) > F.col("_from"), F.lit(False))).drop("_from")


def queue_summary(candidates: DataFrame, source: list[str], fixture: Column, routing: str, routes: list[str], category: str) -> DataFrame:
    """A row for each source: candidates, whether any is a fixture, candidates by route, distinct categories."""
    split = [F.count_if(F.col(routing) == r).alias(f"route_{r.lower()}") for r in routes]
    return candidates.groupBy(*source).agg(F.count("*").alias("n"), F.bool_or(fixture).alias("fixture"), *split, F.count_distinct(category).alias("categories"))


def risk_keys(blocking: str, findings: str, disagree: Column, tags: Column, unapproved: Column, confidence: Column, family: str, category: str, key: str) -> list[Column]:
    """Nine keys, the riskiest candidate first."""
    first = lambda c: F.when(c, 0).otherwise(1)
    rank = F.coalesce(F.element_at(F.create_map(F.lit("low"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("high"), F.lit(2)), confidence), F.lit(1))
    return [F.col(blocking).desc(), F.col(findings).desc(), first(disagree), F.size(tags).desc(), first(unapproved), rank, F.col(family), F.coalesce(F.col(category), F.lit("")), F.col(key)]


def batch_refusal(blocking: str, confidence: str, disagree: Column, evidence: str) -> Column:
    """Why a candidate may not be approved in a batch; null if it may."""
    return (
        F.when(F.col(blocking) > 0, F.concat(F.col(blocking).cast("string"), F.lit(" blocking findings")))
        .when(F.coalesce(F.col(confidence), F.lit("")) != "high", "confidence is not high").when(disagree, "the channels disagree").when(F.coalesce(F.col(evidence), F.lit(0)) == 0, "no evidence")
    )


def continued(grids: DataFrame, document: list[str], page: str, ordinal: str, columns: str, headed: str) -> DataFrame:
    """``grids`` with ``continues``: the first grid of a page without a header of its own, as wide as the last one of the page before."""
    w = Window.partitionBy(*document).orderBy(page, ordinal)
    before = lambda c: F.lag(c).over(w)
    turned = F.col(page) == before(page) + 1
    return grids.withColumn("continues", F.coalesce(turned & ~F.col(headed) & (F.col(columns) == before(columns)), F.lit(False)))


def applied_norms(norms: DataFrame, keys: list[str], year: str, voice: str, voices: list[str], value: str) -> DataFrame:
    """Of each key the norm of the latest year, in it that of the strongest voice (``voices``, strongest first)."""
    strength = -F.coalesce(F.array_position(F.array(*map(F.lit, voices)), F.col(voice)), F.lit(len(voices) + 1))
    rated = norms.where(F.col(voice).isin(voices)).withColumn("_at", F.struct(F.col(year), strength, F.col(value)))
    return rated.groupBy(*keys).agg(F.max_by(F.struct(year, voice, value), "_at").alias("n")).select(*keys, "n.*")


def by_gaps(words: DataFrame, keys: list[str], edge: str, gap: float, out: str = "column") -> DataFrame:
    """Words of a page in columns: sorted by an edge, a distance over ``gap`` begins a new one; numbered from 0."""
    w = Window.partitionBy(*keys).orderBy(edge)
    new = F.coalesce((F.col(edge) - F.lag(edge).over(w) > gap).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def cross_checked(summary: DataFrame, schedule: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Each figure of a summary beside the schedule's of the same keys: ``agrees``, ``differs``, ``several`` or ``not there``. The schedule is aggregated to its range before it is joined."""
    there = schedule.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    state = F.when(F.col("_low").isNull(), "not there").when(F.col("_low") != F.col("_high"), "several").when(F.abs(F.col(value) - F.col("_low")) <= tolerance, "agrees").otherwise("differs")
    return summary.join(there, keys, "left").withColumn("state", state).drop("_low", "_high")
