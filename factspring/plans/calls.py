"""Calls over the lines of documents as pages: chunks, a state to resume from, a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calls import budgeted, chunked, resumed
from ..registry import query
from ..sources.catalog import table

MOST_TOKENS, MOST_PAGES, OVERLAP, ATTEMPTS, VERSION = 300, 4, 1, 3, "rules@2"

# a page for each line, a token for four bytes; the greedy cut walks a document's pages one after the other
_CHUNKS = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL), pages AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS page, (octet_length(encode(unnest(t))) + 3) // 4 AS tokens, md5(unnest(t)) AS digest FROM l),
g AS (SELECT doc_id, page, tokens, 0 AS chunk, tokens AS held, 1 AS n FROM pages WHERE page = 1 UNION ALL
  SELECT p.doc_id, p.page, p.tokens, CASE WHEN g.n < {MOST_PAGES} AND g.held + p.tokens <= {MOST_TOKENS} THEN g.chunk ELSE g.chunk + 1 END, CASE WHEN g.n < {MOST_PAGES} AND g.held + p.tokens <= {MOST_TOKENS} THEN g.held + p.tokens ELSE p.tokens END, CASE WHEN g.n < {MOST_PAGES} AND g.held + p.tokens <= {MOST_TOKENS} THEN g.n + 1 ELSE 1 END
  FROM g JOIN pages p ON p.doc_id = g.doc_id AND p.page = g.page + 1),
c AS (SELECT doc_id, chunk, min(page) AS first_page, max(page) AS last_page, greatest(min(page) - {OVERLAP}, 1) AS context_from FROM g GROUP BY doc_id, chunk),
chunks AS (SELECT c.doc_id, chunk, first_page, last_page, context_from, sum(tokens)::BIGINT AS tokens, sha256(string_agg(page || ':' || digest, chr(10) ORDER BY page)) AS input_hash FROM c JOIN pages p ON p.doc_id = c.doc_id AND p.page BETWEEN context_from AND last_page GROUP BY ALL)"""


def _chunks(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    pages = pages.select("doc_id", (F.col("at") + 1).alias("page"), F.floor((F.octet_length("line") + 3) / 4).alias("tokens"), F.md5("line").alias("digest"))
    return chunked(pages, "doc_id", "page", "tokens", "digest", MOST_TOKENS, MOST_PAGES, OVERLAP)


@query("call_chunks", f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks")
def call_chunks(spark, sf_dir) -> DataFrame:
    """Pages of every document in chunks under caps of tokens and pages, one page of overlap, with a hash of what each reads."""
    return _chunks(spark, sf_dir)


@query("calls_resumed", f"""WITH RECURSIVE {_CHUNKS}, todo AS (SELECT *, CASE (doc_id + chunk) % 7 WHEN 0 THEN 'skip' WHEN 1 THEN 'give_up' WHEN 2 THEN 'again' WHEN 3 THEN 'skip' ELSE 'run' END AS todo, CASE (doc_id + chunk) % 7 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS tries FROM chunks),
priced AS (SELECT *, CASE WHEN todo IN ('run', 'again') THEN (tokens * 0.00003)::DECIMAL(18,6) END AS cost FROM todo), r AS (SELECT *, CASE WHEN cost IS NOT NULL THEN (sum(cost) OVER (PARTITION BY doc_id ORDER BY chunk) + CASE WHEN doc_id % 3 = 0 THEN 0.02 ELSE 0 END::DECIMAL(18,6))::DECIMAL(28,6) END AS running FROM priced)
SELECT doc_id, chunk, todo, tries, cost, running, running <= 0.04 AS allowed FROM r""")
def calls_resumed(spark, sf_dir) -> DataFrame:
    """What a rerun over every document still calls, from the state of earlier runs, within a budget for each document."""
    chunks = _chunks(spark, sf_dir)
    mark = (F.col("doc_id") + F.col("chunk")) % 7
    # what earlier runs left: done, failed three times, failed twice, failed once and then done, done by another version of the reader
    left = F.when(mark == 0, F.array(F.lit("done"))).when(mark == 1, F.array(*[F.lit("failed")] * 3)).when(mark == 2, F.array(*[F.lit("failed")] * 2)).when(mark == 3, F.array(F.lit("failed"), F.lit("done"))).when(mark == 4, F.array(F.lit("done")))
    state = chunks.select("doc_id", "input_hash", F.when(mark == 4, "rules@1").otherwise(VERSION).alias("version"), F.posexplode(left).alias("attempt", "state"))
    spent = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("0.015"), F.lit("0.005"))).alias("cost")).distinct()
    out = budgeted(resumed(chunks, state, "doc_id", VERSION, ATTEMPTS), "doc_id", F.col("tokens") * F.lit("0.00003").cast("decimal(8,6)"), spent, "0.04")
    return out.select("doc_id", "chunk", "todo", "tries", "cost", "running", "allowed")
