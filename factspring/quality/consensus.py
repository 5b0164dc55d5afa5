"""Consensus of several readers' figures: clusters of equal readings, and conflicts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.grouped import by_group

#: Readers in order of trust; how far equal values may lie apart.
READERS, TOLERANCE = ("textlayer", "docling", "llamaparse", "llm"), 0.005
KEY = ["utility", "fiscal_year", "voice", "head"]
SCHEMA = "utility string, fiscal_year string, voice string, head string, label string, page int, value double, consensus string, readers string"


def cluster(readings: list[dict]) -> list[dict]:
    """Facts of one key. Readings come in the order of their readers and take the best open cluster: of another reader,
    the same value, and the same page (counts 2) or label (counts 1). Clusters of one page and label but of different
    values, without a reader in common, are one fact in conflict."""
    rank = {r: i for i, r in enumerate(READERS)}
    facts: list[dict] = []
    for r in sorted(readings, key=lambda r: (rank.get(r["reader"], len(rank)), r["page"], r["label"], r["value"])):
        best, score = None, 0
        for fact in facts:
            fits = 2 * (fact["page"] == r["page"]) + (fact["label_key"] == r["label_key"])
            if fits > score and r["reader"] not in fact["readers"] and abs(fact["value"] - r["value"]) <= TOLERANCE:
                best, score = fact, fits
        if best:
            best["readers"].append(r["reader"])
        else:
            facts.append({**r, "readers": [r["reader"]], "against": []})
    out: list[dict] = []
    for fact in facts:
        rival = next((f for f in out if f["page"] == fact["page"] and f["label_key"] == fact["label_key"] and not {*f["readers"]} & {*fact["readers"]} and abs(f["value"] - fact["value"]) > TOLERANCE), None)
        if rival:
            rival["against"] += fact["readers"]
        else:
            out.append(fact)
    for fact in out:
        n = len(fact["readers"])
        fact["consensus"] = "conflict" if fact["against"] else "single" if n == 1 else "agreed_2" if n == 2 else "agreed_3"
        fact["readers"] = ",".join(sorted({*fact["readers"], *fact["against"]}, key=lambda r: rank.get(r, len(rank))))
    return out


def consensus(readings: DataFrame) -> DataFrame:
    """Facts of readings ``utility, fiscal_year, voice, head, label, label_key, page, value, reader``. A key holds the few readings of one figure's row."""
    columns = [*KEY, "label", "page", "value", "consensus", "readers"]
    return by_group(readings, KEY, ["page", "label", "value"], lambda rows: [tuple(f[c] for c in columns) for f in cluster(rows)], SCHEMA)
