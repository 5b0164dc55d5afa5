"""Text ranking (BM25), vector ranking (cosine) and their fusion by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.figures import words
from ..sources.shared import stage

#: Entries of each list before fusion, the constant of the fusion, results.
LIST, FUSION, RESULTS = 50, 60, 30


def _is(term: str):
    return lambda word: word == term


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc_id, score`` of the documents that have a term. Texts are read once, into a narrow table of lengths and term counts; statistics and scores come from it."""
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    split = split.select("doc_id", F.size("w").alias("len"), F.filter("w", lambda x: x.isin(terms)).alias("w"))
    counted = split.select("doc_id", "len", *[F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = stage(counted, "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])  # one row
    joined = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return joined.select("doc_id", F.round(score, 9).alias("score"))


def cosine(a: Column, b: list[float]) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    other = F.array(*[F.lit(float(x)) for x in b])
    return F.try_divide(dot(a, other), F.sqrt(dot(a, a)) * float(sum(x * x for x in b)) ** 0.5)


def nearest(vectors: DataFrame, to: list[float], k: int = LIST) -> DataFrame:
    """The ``k`` vectors of least cosine distance to one, exactly; ties by id."""
    return vectors.select("vec_id", F.round(1 - cosine(F.col("embedding"), to), 6).alias("distance")).orderBy("distance", "vec_id").limit(k)


def fuse(lists: list[DataFrame], results: int = RESULTS) -> DataFrame:
    """Ranked lists ``(id, rank)`` fused: the sum of 1 / (60 + rank), ties by id."""
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    return both.groupBy("id").agg(F.round(F.sum(1 / (F.lit(FUSION) + F.col("rank"))), 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(results)


def ranked(top: DataFrame, id_col: str, *order: Column) -> DataFrame:
    """Ranks of a list that is already cut to its top; a few rows."""
    return top.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
