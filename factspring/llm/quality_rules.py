"""Quality rules with cutoffs whose false rejections are controlled.

Each rule scores a text by a share in thousandths; a document is rejected whose score reaches the rule's cutoff in its
stratum. Cutoffs are tried from the most lenient to the strictest of a fixed list: for each, the labelled good documents
of the stratum (those the base rules keep) that it would reject are counted, and the exact binomial probability of so
few, were the true rate ``ALPHA / rules``, must not exceed ``DELTA / (strata * rules)``; the first failure ends the
sequence. So with probability 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its good documents to all rules
together. Where too few labels certify any cutoff, the rules reject nothing.

With ``pooled``, the strata whose labels could certify no cutoff even if none of them were rejected (and the strata
without labels) make one stratum more, tested with a share of ``DELTA`` of its own: then the bound holds for the other
strata each and for these together, not for each of these. Which strata are pooled depends on numbers of labels only,
not on what the rules reject.

Everything is DataFrame functions; only counts by stratum leave the labelled rows' tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

ALPHA, DELTA = 0.02, 0.05
#: Cutoffs in thousandths, lenient to strict.
CUTOFFS = {"symbols": (300, 200, 150, 100, 50), "repeats": (250, 200, 150, 100, 50), "dup_lines": (700, 500, 400, 300, 200, 100)}
WINDOW = 8  # words
_SPACE = r"[ \x09-\x0D]"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (all 0 for a null or empty text) and keep all columns.

    A window of ``WINDOW`` words counts as repeated by its 64-bit hash; its places are sorted by it, no text is
    compared with another row's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", f"{_SPACE}+"), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^ \x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    places = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(places, lambda i: F.struct(F.xxhash64(F.slice(F.col("_words"), i + 1, WINDOW)).alias("h"), i.alias("i")))
    out = out.withColumn("_sorted", F.sort_array(hashed))
    at = lambda i: F.get(F.col("_sorted"), i)["h"]
    twice = F.filter(F.col("_sorted"), lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
    out = out.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    steps = F.transform(F.col("_twice"), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_twice"), k + 1) - i, F.lit(WINDOW))))
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b),
    }).drop("_text", "_words", "_lines", "_sorted", "_twice")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def scores() -> dict[str, Column]:
    share = lambda part, whole: F.expr(f"{part} * 1000 div greatest({whole}, 1)")
    return {"symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "n_lines")}


def _log_factorial(n: Column) -> Column:
    """By Stirling's series, shifted by 8; exact to about 1e-12."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for i in range(1, 9):
        series = series - F.log(n + i)
    return series


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(at most k of n) at ``rate``, for k under n * rate; 1 otherwise (such counts never certify anything).

    Terms fall from the k-th down; the sum ends some 40 standard deviations below, where they are under 1e-300.
    """
    odds = (1 - rate) / rate
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate)))
    steps = F.least(k, (F.lit(100) + 40 * F.sqrt(n * rate)).cast("long"))
    down = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>")), F.struct(top.alias("term"), top.alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"), (s["sum"] + s["term"] * (k - i) / (n - k + i + 1) * odds).alias("sum")), lambda s: s["sum"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(down)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """A row for each stratum (``coalesce(lang, '')``) with its good labelled documents ``n_good`` and a cutoff ``cut_<rule>``, null where none is certified.

    Labels without a quality are left out; of several labels of one document the least quality counts. With
    ``pooled``, strata of too few labels are one row whose stratum is null.
    """
    labels = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    good = measured.join(labels, F.col("doc_id") == F.col("_id")).where("_quality = 1").where(~base_failed())
    tries = [(rule, cut) for rule, cuts in CUTOFFS.items() for cut in cuts]
    rejected = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"_{rule}_{cut}").alias("k")) for rule, cut in tries])
    counts = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.sum((scores()[rule] >= cut).cast("long")).alias(f"_{rule}_{cut}") for rule, cut in tries])
    strata = counts.agg((F.count("*") + int(pooled)).alias("_strata"))  # one row
    counts = counts.crossJoin(F.broadcast(strata)).select("stratum", "n_good", "_strata", F.explode(rejected).alias("t"))
    counts = stage(counts.select("stratum", "n_good", "_strata", "t.*"), "label-counts")  # a row for each stratum and cutoff
    rate, share = alpha / len(CUTOFFS), F.lit(delta) / (F.col("_strata") * len(CUTOFFS))
    if pooled:
        own = F.when(F.pow(F.lit(1 - rate), F.col("n_good")) <= share, F.col("stratum"))
        counts = counts.groupBy(own.alias("stratum"), "_strata", "rule", "cut").agg(F.sum("n_good").alias("n_good"), F.sum("k").alias("k"))
    sure = binomial_tail(F.col("n_good"), F.col("k"), rate) <= share
    # counts grow with strictness, so the certified cutoffs of a sequence are its first ones
    return counts.withColumn("sure", sure).groupBy("stratum", "n_good").agg(*[F.min(F.when(F.col("sure") & (F.col("rule") == rule), F.col("cut"))).alias(f"cut_{rule}") for rule in CUTOFFS])


def _judged(docs: DataFrame, labels: DataFrame, alpha: float, delta: float, carried: list[str], pooled: bool) -> DataFrame:
    """The columns ``carried`` (renamed, so that none clashes with a measure) and all measures and verdicts."""
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.col("text").alias("_whole"), *[F.col(f"`{c}`").alias(f"_carried_{i}") for i, c in enumerate(carried)])
    measured = stage(measures(slim, "_whole").drop("_whole"), "measures")
    narrow = measured.drop(*[f"_carried_{i}" for i in range(len(carried))])
    cutoffs = certified_cutoffs(narrow, labels, alpha, delta, pooled).withColumnRenamed("stratum", "_stratum")
    if pooled:
        cutoffs = stage(cutoffs, "cutoffs")  # a row for each stratum
    judged = measured.join(cutoffs, F.col("stratum") == F.col("_stratum"), "left").withColumn("base_failed", base_failed())
    if pooled:
        rest = cutoffs.where("_stratum is null").agg(*[F.min(f"cut_{r}").alias(f"_rest_{r}") for r in CUTOFFS])  # one row
        judged = judged.crossJoin(F.broadcast(rest)).withColumns({f"cut_{r}": F.when(F.col("_stratum").isNull(), F.col(f"_rest_{r}")).otherwise(F.col(f"cut_{r}")) for r in CUTOFFS})
    failed = F.filter(F.array(*[F.when(scores()[r] >= F.col(f"cut_{r}"), F.lit(r)) for r in CUTOFFS]), lambda r: r.isNotNull())
    judged = judged.withColumn("rejected_by", F.array_join(failed, ","))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``rejected_by`` (names of the rules) of every row, beside ``doc_id`` and ``stratum``."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    return _judged(docs, labels, alpha, delta, [], pooled).select("doc_id", "stratum", *names)


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, pooled: bool = False) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; texts are measured where they lie and not shuffled."""
    kept = _judged(docs, labels, alpha, delta, docs.columns, pooled).where("kept")
    return kept.select(*[F.col(f"_carried_{i}").alias(c) for i, c in enumerate(docs.columns)])


def rules_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for ``apply_rules(documents, labels)``."""
    rate, rules = alpha / len(CUTOFFS), len(CUTOFFS)
    score = {"symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)"}
    counts = ", ".join(f"count(*) FILTER ({score[r]} >= {c}) AS k_{r}_{c}" for r, cs in CUTOFFS.items() for c in cs)
    tail = lambda k: (
        f"CASE WHEN {k} >= n_good * {rate!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({rate!r}::DOUBLE) + (n_good - i) * ln(1 - {rate!r}::DOUBLE)))) END"
    )
    cuts = ", ".join("CASE " + " ".join(f"WHEN {tail(f'k_{r}_{c}')} <= {delta!r}::DOUBLE / (strata * {rules}) THEN {c}" for c in reversed(cs)) + f" END AS cut_{r}" for r, cs in CUTOFFS.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, unnest(range(0, greatest(len(words) - 7, 0))) AS i, unnest(list_transform(range(0, greatest(len(words) - 7, 0)), lambda i: array_to_string(words[i + 1:i + 8], ' '))) AS eight FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, eight) AS c FROM g),
p AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS covered FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM h WHERE c > 1) GROUP BY r),
m AS (SELECT w.doc_id, w.stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.covered, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT *, count(*) OVER () AS strata FROM (SELECT stratum, count(*) AS n_good, {counts} FROM b JOIN q USING (doc_id) WHERE quality = 1 AND NOT base_failed GROUP BY stratum)),
c AS (SELECT stratum, {cuts} FROM k),
v AS (SELECT b.*, concat_ws(',', {', '.join(f"CASE WHEN {score[r]} >= cut_{r} THEN '{r}' END" for r in CUTOFFS)}) AS rejected_by FROM b LEFT JOIN c USING (stratum))
SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM v"""


def pooled_rules_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for ``apply_rules(documents, labels, pooled=True)``."""
    rate, rules = alpha / len(CUTOFFS), len(CUTOFFS)
    sums = ", ".join(f"sum({k})::BIGINT AS {k}" for k in ("n_good", *(f"k_{r}_{c}" for r, cs in CUTOFFS.items() for c in cs)))
    own = f"CASE WHEN pow(1 - {rate!r}::DOUBLE, n_good) <= {delta!r}::DOUBLE / (strata * {rules}) THEN stratum END"
    sql = rules_sql(alpha, delta).replace("k AS (SELECT *, count(*) OVER () AS strata", "e AS (SELECT *, count(*) OVER () + 1 AS strata")
    sql = sql.replace("\nc AS (", f"\nk AS (SELECT {own} AS stratum, strata, {sums} FROM e GROUP BY 1, 2),\nc AS (")
    return sql.replace("LEFT JOIN c USING (stratum)", "LEFT JOIN c ON c.stratum IS NOT DISTINCT FROM CASE WHEN b.stratum IN (SELECT stratum FROM c WHERE stratum IS NOT NULL) THEN b.stratum END")
