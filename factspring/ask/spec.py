"""A plain question as a query specification, and its DataFrame plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest

#: Words of a question and what they ask for.
HEADS = {"power purchase": "power_purchase", "o&m": "om", "operation and maintenance": "om", "arr": "arr", "revenue requirement": "arr"}
VOICES = {"claimed": "claimed", "petitioned": "claimed", "approved": "approved", "actual": "actual", "audited": "actual"}
DESCENDING = ("highest", "largest", "most", "top", "biggest")
ASCENDING = ("lowest", "smallest", "least", "bottom")


@dataclass
class Spec:
    """What a question asks. ``assumed`` lists each default that was taken."""

    shape: str = "list"  # list, rank, aggregate, share, compare
    heads: list[str] = field(default_factory=list)
    voice: str | None = None
    years: list[int] = field(default_factory=list)
    descending: bool = True
    limit: int | None = None
    aggregate: str | None = None
    assumed: list[str] = field(default_factory=list)


def translate(question: str, latest_year: int) -> Spec:
    """Read a question. A share, a comparison, a sum or average, a superlative (with its number) or a list, in this order."""
    text = f" {question.lower()} "
    spec = Spec()
    spec.heads = list(dict.fromkeys(v for k, v in HEADS.items() if re.search(rf"\b{re.escape(k)}\b", text)))
    spec.voice = next((v for k, v in VOICES.items() if k in text), None)
    spec.years = [int(y) for y in re.findall(r"\b((?:19|20)\d{2})\s*-\s*\d{2,4}\b", text)]
    if re.search(r"\b(share|percent(age)? of|proportion)\b", text):
        spec.shape = "share"
    elif re.search(r"\b(compare|disallow\w*|claimed (and|versus|vs) approved)\b", text):
        spec.shape = "compare"
    elif found := re.search(r"\b(total|sum|average|mean)\b", text):
        spec.shape, spec.aggregate = "aggregate", "avg" if found[1] in ("average", "mean") else "sum"
    elif any(re.search(rf"\b{w}\b", text) for w in (*DESCENDING, *ASCENDING)):
        spec.shape, spec.descending = "rank", any(re.search(rf"\b{w}\b", text) for w in DESCENDING)
        number = re.search(r"\b(?:top|bottom|first)?\s*(\d{1,3})\b(?!\s*-)", re.sub(r"\b(?:19|20)\d{2}\s*-\s*\d{2,4}\b", "", text))
        spec.limit = int(number[1]) if number else 1 if re.search(r"\bwhich (utility|state|company|one)\b", text) else 5
    if not spec.heads:
        spec.heads = ["arr"]
        spec.assumed.append("the revenue requirement, as no head is named")
    if not spec.voice and spec.shape != "compare":
        spec.voice = "approved"
        spec.assumed.append("approved figures, as no voice is named")
    if not spec.years and spec.shape in ("list", "rank", "share", "compare"):
        spec.years = [latest_year]
        spec.assumed.append(f"the year from {latest_year}, the latest there is")
    return spec


def answer(spec: Spec, facts: DataFrame) -> DataFrame:
    """The plan of a specification over facts; filters lie under the pick of the latest word, whose keys they are."""
    base = facts
    if spec.years:
        base = base.where(F.col("fy_start").isin(spec.years))
    order = [F.col("order_year").desc_nulls_last(), F.col("fact_id").desc()]
    key = ["utility", "commission", "fiscal_year", "voice"]
    if spec.shape == "compare":
        picked = latest(base.where(F.col("voice").isin("claimed", "approved") & F.col("head").isin(spec.heads)), [*key, "head"], order)
        sides = picked.groupBy("utility", "fiscal_year", "head").agg(*[F.max(F.when(F.col("voice") == v, F.col("value"))).alias(v) for v in ("claimed", "approved")]).where("claimed is not null and approved is not null")
        return sides.withColumn("disallowed", F.round(F.col("claimed") - F.col("approved"), 2)).withColumn("disallowed_pct", F.round(F.try_divide(100 * (F.col("claimed") - F.col("approved")).cast("double"), F.col("claimed").cast("double")), 1))
    base = base.where(F.col("voice") == spec.voice)
    if spec.shape == "share":
        picked = latest(base, [*key, "head"], order)
        sums = picked.groupBy("utility", "fiscal_year").agg(F.sum(F.when(F.col("head").isin(spec.heads), F.col("value"))).alias("part"), F.sum("value").alias("whole"))
        return sums.where("part is not null and whole > 0").withColumn("percent", F.round(100 * F.col("part").cast("double") / F.col("whole").cast("double"), 1))
    picked = latest(base.where(F.col("head").isin(spec.heads)), key if spec.shape == "rank" else [*key, "label"], order)
    if spec.shape == "aggregate":
        made = F.sum("value") if spec.aggregate == "sum" else F.sum("value").cast("double") / F.count("value")
        return picked.groupBy("fiscal_year").agg(F.round(made, 2).alias(spec.aggregate), F.count("*").alias("counted"))
    out = picked.select("utility", "commission", "fiscal_year", "label", "value", "fact_id")
    if spec.shape == "rank":
        return out.orderBy(F.col("value").desc() if spec.descending else F.col("value").asc(), "utility", "fact_id").limit(spec.limit)
    return out
