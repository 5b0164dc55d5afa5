"""A training corpus from ``documents``: language, quality, near duplicates, repeated passages, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspring.llm import language_id, near_dedup, packing, quality_rules, suffix_dedup
from factspring.llm.staging import stage

MIN_SCORE = 0.5  # a language named with less certainty than any other two together doesn't count


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``docs`` has it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network names; texts that are null or without letters, or whose best language has under ``MIN_SCORE``, go. Where no row names a language, all texts with letters stay. Repeated rows stay or go together."""
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    if model is None:  # nothing could be learnt, so no language is held against a text
        return docs.where(F.col("text").rlike(r"\p{L}"))
    language, score = _free(docs, "lang_pred"), _free(docs, "score")
    named = language_id.predict(docs, model, (language, score)).where((F.col(language) != language_id.UNDETERMINED) & (F.col(score) >= MIN_SCORE))
    return named.select(*map(_named, docs.columns))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep, small languages pooled; ``labels`` are those of the documents that are left."""
    return quality_rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), pooled=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of linked documents. Rows with one doc_id are one document: it stays or goes whole, each of its texts once. Rows with a null doc_id stay."""
    gone = stage(near_dedup.link_documents(docs).where(~F.col("kept")).select("doc_id"), "near-copies")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    several = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(several).select(*map(_named, docs.columns))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that an earlier document has; a null text becomes an empty one."""
    carried = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = suffix_dedup.dedup_passages(docs.select("doc_id", "text", *[_named(c).alias(n) for c, n in carried.items()]), texts=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[(made[c] if c in made else F.col(carried[c])).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", by_language),
    ("quality_rules", by_quality),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("packing", packed),
]

#: The network, the suffix sort and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
