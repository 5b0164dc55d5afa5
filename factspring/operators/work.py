"""Work and decisions: what each document needs next, candidates after their decisions, drafts of a mapping, rules from files."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import stage


def planned(states: DataFrame, document: str, paid: dict[str, float], budget: dict[str, float], keyed: list[str]) -> DataFrame:
    """``document, kind, reason, blocked`` of all work that documents need, by the rules of a director.

    ``states`` has fetched, textlayer, layout, cloud, llm, verified, stale, indexed (booleans), tables, blank_pages,
    shared and disagree (numbers). A document that is not fetched, or not read, needs that alone. Kinds in ``paid`` cost
    their estimate each: without a key (``keyed``) they are blocked, and from where their ``budget`` is used up.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    read = is_("fetched") & is_("textlayer")
    work = {
        "fetch": (~is_("fetched"), F.lit("its pages were never fetched")),
        "parse:textlayer": (is_("fetched") & ~is_("textlayer"), F.lit("its text layer was never read")),
        "parse:layout": (read & ~is_("layout") & ((F.col("tables") == 0) | (F.col("blank_pages") > 0)), F.when(F.col("tables") == 0, "no table found by its text layer").otherwise("blank pages in its text layer")),
        "parse:cloud": (read & is_("verified") & is_("layout") & ~is_("cloud") & (F.col("shared") > 0) & (F.col("disagree") > 0.2 * F.col("shared")), F.lit("readers differ on a fifth of shared figures")),
        "extract": (read & ~is_("llm") & (F.col("tables") > 0), F.lit("its tables wait for extraction")),
        "verify": (read & (~is_("verified") | is_("stale")), F.when(is_("verified"), "read again since it was verified").otherwise("never verified")),
        "index": (read & ~is_("indexed"), F.lit("never indexed")),
    }
    each = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))) for kind, (condition, reason) in work.items()]))
    out = states.select(document, F.explode(each).alias("w")).select(document, "w.*")
    free = out.where(~F.col("kind").isin(list(paid))).withColumn("blocked", F.lit(None).cast("string"))
    done = [free]
    for kind, cost in paid.items():  # of each paid kind those that the budget holds, by document
        mine = out.where(F.col("kind") == kind)
        if kind not in keyed:
            done.append(mine.withColumn("blocked", F.lit("no key")))
            continue
        fits = int(budget[kind] / cost + 1e-9)
        first = mine.orderBy(document).limit(fits).select(document, F.lit(True).alias("_in"))
        done.append(mine.join(first, document, "left").withColumn("blocked", F.when(F.col("_in").isNull(), "budget")).drop("_in"))
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0]


def decided(decisions: DataFrame, candidate: list[str], order: str, outcome: str, reviewer: str, second: Column) -> DataFrame:
    """``candidate, status, reviewed_by`` after all decisions and undos.

    An undo takes back the last decision that still stands, so a decision stands if no later point has as many undos
    as decisions since it. A first approval or correction for which ``second`` holds waits for another reviewer, whose
    first decision is final; what its own reviewer adds, or anyone after a final decision, doesn't count. Candidates
    whose decisions are all undone are open again. ``order`` must not have ties within a candidate.
    """
    w = Window.partitionBy(*candidate).orderBy(order)
    level = F.sum(F.when(F.col(outcome) == "undo", -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.min("_level").over(w.rowsBetween(1, Window.unboundedFollowing))
    steps = decisions.withColumn("_level", level)
    stands = steps.withColumn("_later", later).where((F.col(outcome) != "undo") & (F.coalesce("_later", F.col("_level")) >= F.col("_level"))).withColumn("_second", second)
    agreed = F.col(outcome).isin("approve", "correct")
    before = F.first(F.struct(F.when(agreed & F.col("_second"), F.col(reviewer)).alias("waiting"))).over(w.rowsBetween(Window.unboundedPreceding, 0))["waiting"]
    counts = stands.withColumn("_n", F.row_number().over(w)).withColumn("_waiting", before)
    final = F.element_at(F.create_map(*[F.lit(x) for x in ("approve", "approved", "correct", "corrected", "reject", "rejected")]), F.col(outcome))
    status = F.when((F.col("_n") == 1) & F.col("_waiting").isNotNull(), "awaiting_second_review").otherwise(F.coalesce(final, F.lit("unresolved")))
    valid = counts.where((F.col("_n") == 1) | (F.col(reviewer) != F.col("_waiting"))).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    last = valid.withColumn("_status", status).groupBy(*candidate).agg(F.max_by(F.struct(F.col("_status").alias("status"), F.col(reviewer).alias("reviewed_by")), order).alias("_l"))
    every = decisions.select(*candidate).distinct()
    return every.join(last, candidate, "left").select(*candidate, F.coalesce("_l.status", F.lit("open")).alias("status"), "_l.reviewed_by")


def mapping_draft(current: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, label, kind, code, note``: a mapping with its decisions written in, a decision over what the mapping says of its label."""
    said = current.select(*keys, "label", F.col("kind").alias("_kind"), F.col("code").alias("_code"), F.col("note").alias("_note"), F.lit(True).alias("_old"))
    note = F.concat(F.lit("decided by "), F.col("decided_by"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(": "), F.col("note"))).otherwise(""))
    new = decisions.select(*keys, "label", F.col("kind"), F.when(F.col("kind") == "alias", F.col("code")).alias("code"), note.alias("note"), F.lit(True).alias("_new"))
    pick = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return said.join(new, [*keys, "label"], "full").select(*keys, "label", pick("kind"), pick("code"), pick("note"))


#: Overlaps that twins are looked for at, one after the other; what the first finds needs no more of them.
TWIN_LEVELS = (0.9, 0.8, 0.65)
_NEAR = 1e-6  # overlaps of less difference than this may be ordered by key


def twins(loose: DataFrame, strict: DataFrame, page: list[str], box: list[str], key: str, least: float = 0.5) -> DataFrame:
    """``page, key, chosen``: of each table of a loose reading the strict reading's table (its key) that covers it best, by overlap of ``least`` or more; null for none. Of overlaps that differ by less than a 1e15th of the keys' difference the lower key counts.

    Boxes that overlap by a share have sides whose ratio is that share at least, and centres that are no further apart than what is left of a side. So high
    overlaps are looked for first, in small cells and among boxes of like size; only tables that have none there go on to the next level. The best of those found at a level is the best of all.
    """
    from ..functions.labels import overlap

    if least < 0.5:
        raise ValueError("boxes that overlap by less than a half need not hold each other's centre")
    x0, y0, x1, y1 = box
    left = loose.select(*page, F.col(key).alias("_a"), *[F.col(c).alias(f"_a{c}") for c in box])
    right = strict.select(*page, F.col(key).alias("_b"), *[F.col(c).alias(f"_b{c}") for c in box])
    done = []
    for level in [*[v for v in TWIN_LEVELS if v > least], least]:
        ratio, rest = -2 * math.log(level), (1 - level) * (1 + 1e-9)  # sizes fall into classes by their logarithms, cells are as wide as the class allows
        wide = lambda size: F.exp((F.col(size) + 1) * ratio) * (2 * rest)
        a, b = left, right
        for low, high, size, cell in ((x0, x1, "_w", "_x"), (y0, y1, "_h", "_y")):
            side = F.col(f"_a{high}") - F.col(f"_a{low}")
            middle = (F.col(f"_a{high}") + F.col(f"_a{low}")) / 2
            near = lambda sign, of=side: F.floor((F.log(of) + sign * (ratio / 2 + 1e-9)) / ratio)
            at = lambda sign, of=side, m=middle, s=size: F.floor((m + sign * of * rest) / wide(s))
            a = a.where(side > 0).withColumn(size, F.explode(F.sequence(near(-1), near(1)))).withColumn(cell, F.explode(F.sequence(at(-1), at(1))))
            b = b.where(F.col(f"_b{high}") > F.col(f"_b{low}")).withColumn(size, F.floor(F.log(F.col(f"_b{high}") - F.col(f"_b{low}")) / ratio))
            b = b.withColumn(cell, F.floor((F.col(f"_b{high}") + F.col(f"_b{low}")) / 2 / wide(size)))
        met = a.join(b, [*page, "_w", "_h", "_x", "_y"]).withColumn("_o", overlap(*[F.col(f"_a{c}") for c in box], *[F.col(f"_b{c}") for c in box])).where(F.col("_o") >= level)
        # one number orders them, so that the best is kept by hash and nothing is sorted
        best = met.groupBy(*page, "_a").agg(F.max("_o").alias("_o"), F.max_by("_b", F.col("_o") * 1e9 - F.col("_b") / 1e6).alias("chosen"))
        best = stage(best.where(F.col("_o") >= level + (_NEAR if level > least else 0)), "twins")
        done.append(best.select(*page, F.col("_a").alias(key), "chosen"))
        left = left.join(best.select(*page, "_a"), [*page, "_a"], "left_anti")
    return loose.select(*page, key).join(reduce(DataFrame.unionByName, done), [*page, key], "left")


def rule_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``rule, version, output, formula, status, from_fy, to_fy, file`` of a folder of JSON documents, one rule or a list of rules each."""
    schema = "rule string, version int, output string, formula string, status string, from_fy string, to_fy string"
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def worked_examples(examples: DataFrame, computed: Column, expected: str, places: int) -> DataFrame:
    """``examples`` with ``problem``: null where a rule gives what its example says at ``places`` decimals."""
    at = lambda c: F.round(c.cast("decimal(38,10)"), places)
    got, want = at(computed), at(F.col(expected))
    return examples.withColumn("problem", F.when(got.isNull(), F.lit("gives nothing")).when(want.isNull(), "expects nothing").when(got != want, F.concat(F.lit("gives "), got.cast("string"))))


def extended(jobs: DataFrame, beats: DataFrame, job: str, run: str, at: str, seconds: int) -> DataFrame:
    """``jobs`` with ``lease_expires`` moved to ``seconds`` after the last beat of the run that holds a leased job; beats of other runs move nothing, and no beat shortens a lease."""
    last = beats.groupBy(job, run).agg((F.max(at) + seconds).alias("_until"))
    held = jobs.where("status = 'leased'").select(job, run).join(last, [job, run]).select(job, "_until")
    return jobs.join(held, job, "left").withColumn("lease_expires", F.greatest("lease_expires", "_until")).drop("_until")


def release_state(candidates: DataFrame, source: list[str], final: Column, open_: Column, blocked: Column) -> DataFrame:
    """``source, publishable, open, blocked, may``: what a release of each source would hold and what stands in its way: nothing final, or a blocking finding on what is. Open candidates don't hold it up; they stay out."""
    out = candidates.groupBy(*source).agg(F.count_if(final).alias("publishable"), F.count_if(open_).alias("open"), F.count_if(final & blocked).alias("blocked"))
    return out.withColumn("may", (F.col("publishable") > 0) & (F.col("blocked") == 0))


def released(candidates: DataFrame, states: DataFrame, releases: DataFrame, source: list[str], final: Column) -> tuple[DataFrame, DataFrame]:
    """The facts of new releases and the table of releases after them.

    Each source that ``may`` gets release ``n + 1`` with all its final candidates, since releases are cumulative, and its
    release before is superseded by it. ``releases`` has ``source``, release and superseded_by.
    """
    last = releases.groupBy(*source).agg(F.max("release").alias("_last"))
    new = states.where("may").select(*source).join(last, source, "left").select(*source, "_last", (F.coalesce("_last", F.lit(0)) + 1).alias("release"))
    facts = candidates.where(final).join(new.drop("_last"), source)
    old = releases.join(new.select(*source, F.col("_last"), F.col("release").alias("_new")), source, "left")
    old = old.select(*source, "release", F.when(F.col("release") == F.col("_last"), F.col("_new")).otherwise(F.col("superseded_by")).alias("superseded_by"))
    return facts, old.unionByName(new.select(*source, "release", F.lit(None).cast(releases.schema["superseded_by"].dataType).alias("superseded_by")))


#: Numbered provisions, lettered ones inside a line, and codes of categories.
PROVISION = r"^\s*(\d{1,2})\s*[.)]\s+([A-Z(].{15,})$"
SUB_PROVISION = r"(?<![\w.])\d{1,2}\([a-z]\)\s+[A-Z].{15,}"
CATEGORY = r"\b(?:LMV|HV|LT|HT|HTP|RGP|GLP|AG|LTMD|WWSP|TMP)\s*[-–—]?\s*\d{0,2}(?:\s*\([A-Za-z]\))?\b"


def conditions(lines: DataFrame, document: list[str], page: str, line: str, text: str, schedules: DataFrame) -> DataFrame:
    """``document, page, line, number, text, categories`` of the general provisions up to the page of a document's first schedule (``schedules``: document, page), verbatim to 600 characters.

    A lettered provision inside a line is one of its own. All lines count where a document has no schedule.
    """
    first = schedules.groupBy(*document).agg(F.min(page).alias("_first"))
    before = lines.join(first, document, "left").where(F.col("_first").isNull() | (F.col(page) <= F.col("_first")))
    whole = F.when(F.col(text).rlike(PROVISION), F.array(F.trim(text)))
    inside = F.regexp_extract_all(F.col(text), F.lit(SUB_PROVISION), F.lit(0))
    found = before.select(*document, page, line, F.explode(F.concat(F.coalesce(whole, F.array().cast("array<string>")), F.coalesce(inside, F.array().cast("array<string>")))).alias("_t"))
    number = F.coalesce(F.nullif(F.regexp_extract("_t", r"^(\d{1,2}\([a-z]\))", 1), F.lit("")), F.regexp_extract("_t", r"^(\d{1,2})", 1))
    codes = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(CATEGORY), F.lit(0)), lambda c: F.upper(F.regexp_replace(c, r"\s+", "")))))
    return found.select(*document, page, line, number.alias("number"), F.substring(F.trim("_t"), 1, 600).alias("text"), codes.alias("categories"))
