"""Merkle fingerprints of texts: units of a paragraph, sections of units, a root.

A section is a line. Its units end after ``.``, ``!`` or ``?``, or after 64 code points, and joined give the line.
Unit nodes hash text, section nodes hash their units' hashes, the root hashes the sections' hashes. A fingerprint is
the root and, behind a slash each, the sections, a section being the first eight digits of its units' hashes: equal
roots mean equal texts, the branches that differ locate an edit, and how alike two texts are is read from their fingerprints alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import width

UNIT = r"(.{0,63}?[.!?]|.{1,64})"
SHORT = 8  # digits of a unit's hash in a fingerprint; two texts of ten thousand units share one by chance once in forty times


def tree(text: Column) -> Column:
    """Sections of a text as arrays of unit hashes (32 hex digits); a null text counts as empty, with one empty section."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda line: F.transform(F.regexp_extract_all(line, F.lit(f"(?s){UNIT}"), F.lit(1)), lambda unit: F.substring(F.sha2(unit, 256), 1, 32)))


def root(sections: Column) -> Column:
    nodes = F.transform(sections, lambda s: F.sha2(F.concat_ws("", s), 256))
    return F.sha2(F.concat_ws("", nodes), 256)


def printed(sections: Column) -> Column:
    """The fingerprint of a tree."""
    return F.concat_ws("/", root(sections), F.concat_ws("/", F.transform(sections, lambda s: F.concat_ws("", F.transform(s, lambda u: F.substring(u, 1, SHORT))))))


def sections_of(fingerprint: Column) -> Column:
    """The sections of a fingerprint, in order."""
    return F.slice(F.split(fingerprint, "/"), F.lit(2), F.size(F.split(fingerprint, "/")) - 1)


def units_of(fingerprint: Column) -> Column:
    """The distinct units of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring(fingerprint, F.lit(65), F.length(fingerprint)), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct units of two fingerprints: 1 for equal texts, 0 for no common unit; two without units are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing_sections(a: Column, b: Column) -> Column:
    """Indexes of the sections that differ between two fingerprints, those that only one has included."""
    x, y = sections_of(a), sections_of(b)
    at = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    return F.filter(at, lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint`` to any table with a text column."""
    return docs.withColumn("fingerprint", printed(tree(F.col(text_col))))


def _longs(numbers: list[int]) -> Column:
    """A constant array that stays one expression however many numbers it has: Catalyst folds it to one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def _least_at(bounds: list[int], value: Column) -> Column:
    """Index of the first of the sorted ``bounds`` that is not under ``value``, by bisection; 0 for null."""
    array = _longs(bounds)
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(F.get(array, ((s["lo"] + s["hi"]) / 2).cast("int")) < value, F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))
        )
    )
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length() + 1)))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi")), step, lambda s: s["lo"])
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Add ``next_text``: the text of the next document by descending ``doc_id``, for the last one that of the first.

    Documents are dealt to ranges of ids that end at ids of the table. The document at such an end is also
    dealt, as a guest, to the range above, whose last document it follows; so one shuffle and one window over
    ranges do, with no global sort. Equal ids lie in the order of their texts, null ids after all others.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or 4 * width(docs.sparkSession)  # several a task, so that tasks even out
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets + 1)], 10000).alias("q"), F.max("doc_id").alias("top"), F.min(F.expr("doc_id is null")).alias("none")).first()
    bounds = sorted({*(cuts["q"] or []), *([cuts["top"]] if cuts["top"] is not None else [])}) or [0]
    n = len(bounds)
    at = _least_at(bounds, F.col("doc_id"))
    ends = F.get(_longs(bounds), F.col("_b"))
    dealt = docs.withColumn("_b", at).withColumn("_guest", F.explode(F.when(F.col("doc_id") == ends, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dealt = dealt.withColumn("_b", F.when(F.col("_guest") == 1, (F.col("_b") + 1) % n).otherwise(F.col("_b")))
    order = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    out = dealt.withColumn("next_text", F.lead("text").over(order)).where("_guest = 0")
    return out.select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of a text's code points (rounded down) replaced by the first as many of another's, or by all of it."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness; see ``with_next`` and ``edited``.

    Likeness is that of the fingerprints that are returned (of the next document, the one it gets itself), and of nothing else. A null text counts as empty; repeated
    rows each have a next document, in the order of id and text; an empty table gives no rows.
    """
    pairs = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    trees = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("_t"), tree(F.col("edited")).alias("_e"), tree(F.col("next_text")).alias("_x"))
    made = trees.select("doc_id", "n_chars", "edited_sha256", printed(F.col("_t")).alias("fingerprint"), printed(F.col("_e")).alias("edited_fingerprint"), printed(F.col("_x")).alias("_next"), F.size("_t").cast("long").alias("n_sections"))
    units = made.withColumns({"_a": units_of(F.col("fingerprint")), "_b": units_of(F.col("edited_fingerprint")), "_c": units_of(F.col("_next"))})
    return units.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"), "n_sections")
