"""Reading of paged documents in calls: chunks under a token cap with overlap, what a rerun still has to do, and a budget for each document.

No call is made here: the plan, the state and the refusals are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(pages: DataFrame, doc: str, page: str, tokens: str, digest: str, most_tokens: int, most_pages: int, overlap: int = 0) -> DataFrame:
    """``doc, chunk, first_page, last_page, context_from, tokens, input_hash``: consecutive pages while they stay within both caps; a page over the cap is a chunk alone.

    A chunk also takes the last ``overlap`` pages before it as context (``context_from``), which aren't counted against the cap of pages but in ``tokens``.
    ``input_hash`` covers the digests of all its pages, context included, so a changed page makes its chunk, and those that see it, new.
    A document meets in one row of ``page, tokens, digest``; its texts stay where they are. Pages without tokens count as nought; of repeated pages the least row counts.
    """
    item = F.struct(F.col(page).cast("long").alias("page"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col(digest), F.lit("")).alias("digest"))
    once = pages.groupBy(doc, page).agg(F.min(item).alias("_p"))
    row = once.groupBy(doc).agg(F.array_sort(F.collect_list("_p")).alias("_pages"))

    # the fold keeps where each chunk begins (places from 0), what the open one holds, and how many pages it has
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"))
    numbered = F.transform("_pages", lambda p, i: F.struct(i.alias("i"), p["tokens"].alias("tokens")))

    def take(state: Column, p: Column) -> Column:
        fits = (state["n"] > 0) & (state["n"] < most_pages) & (state["held"] + p["tokens"] <= most_tokens)
        return F.struct(
            F.when(fits, state["cuts"]).otherwise(F.concat(state["cuts"], F.array(p["i"]))).alias("cuts"),
            F.when(fits, state["held"] + p["tokens"]).otherwise(p["tokens"]).alias("held"),
            F.when(fits, state["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    cut = row.withColumn("_cuts", F.aggregate(numbered, start, take, lambda s: s["cuts"]))
    begin, end = F.col("_begin"), F.coalesce(F.get("_cuts", F.col("chunk") + 1), F.size("_pages"))
    each = cut.select(doc, "_pages", "_cuts", F.posexplode("_cuts").alias("chunk", "_begin"))
    seen = each.withColumn("_from", F.greatest(begin - overlap, F.lit(0))).withColumn("_end", end)
    seen = seen.withColumn("_seen", F.slice("_pages", F.col("_from") + 1, F.col("_end") - F.col("_from")))
    at = lambda i: F.get("_pages", i)["page"]
    return seen.select(
        doc,
        "chunk",
        at(begin).alias("first_page"),
        at(F.col("_end") - 1).alias("last_page"),
        at(F.col("_from")).alias("context_from"),
        F.aggregate("_seen", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
        F.sha2(F.concat_ws("\n", F.transform("_seen", lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p["digest"]))), 256).alias("input_hash"),
    )


def resumed(chunks: DataFrame, state: DataFrame, doc: str, version: str, attempts: int) -> DataFrame:
    """``chunks`` with ``todo``: ``skip`` what is done, ``give_up`` what failed ``attempts`` times, ``again`` what failed less often, ``run`` the rest; and ``tries`` so far.

    ``state`` has ``doc, input_hash, version, state, attempt``, any number of rows for a chunk. It is looked up by what a chunk reads, not by its number:
    chunks that only moved stay done; another text or another ``version`` of the reader makes a chunk new.
    """
    known = state.where(F.col("version") == version).groupBy(doc, "input_hash").agg(F.max(F.col("state") == "done").alias("_done"), F.count_if(F.col("state") == "failed").alias("_failed"))
    out = chunks.join(known, [doc, "input_hash"], "left")
    todo = F.when(F.col("_done"), "skip").when(F.col("_failed") >= attempts, "give_up").when(F.col("_failed") > 0, "again").otherwise("run")
    return out.withColumn("todo", todo).withColumn("tries", F.coalesce("_failed", F.lit(0)).cast("long")).drop("_done", "_failed")


def budgeted(chunks: DataFrame, doc: str, cost: Column, spent: DataFrame, most: str) -> DataFrame:
    """``chunks`` with ``cost``, ``running`` (spent before and with this call) and ``allowed``: calls still to do, in order, while the document stays within ``most``.

    The first call that would pass the budget stops its document: nothing after it is squeezed in. Chunks that are skipped or given up cost nothing and are null.
    ``spent`` has ``doc, cost`` rows of calls already paid; a document's chunks are few, so the running sum is its own.
    """
    price = F.when(F.col("todo").isin("run", "again"), cost.cast("decimal(18,6)"))
    paid = spent.groupBy(doc).agg(F.sum(F.col("cost").cast("decimal(18,6)")).alias("_paid"))
    w = Window.partitionBy(doc).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = chunks.withColumn("cost", price).join(paid, doc, "left")
    total = (F.coalesce("_paid", F.lit(0).cast("decimal(18,6)")) + F.sum("cost").over(w)).cast("decimal(28,6)")
    # prices aren't negative, so once over the running sum stays over
    return out.withColumn("running", F.when(F.col("cost").isNotNull(), total)).withColumn("allowed", F.col("running") <= F.lit(most).cast("decimal(18,6)")).drop("_paid")
