"""Decisions in sentences, the surroundings of figures, and the sentences that name them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prose import CAPTION, decisions, is_prose, naming, sentences, surroundings
from ..registry import query
from ..sources.catalog import table

# Sentences of a line, in either dialect, by (l_orderkey + l_linenumber) % 8; figures are the row's own.
_LOSS = "CAST(CAST(l_discount * 100 AS INTEGER) AS VARCHAR(9))"
_CHARGE = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9))"
_LEVEL = "concat(CAST(11 * l_linenumber AS VARCHAR(9)), ' kV')"
SAID = {
    0: ("'The additional surcharge of the year is approved as nil.'", "'Banking shall be as per the Regulations of the State.'"),
    1: ("'Additional surcharge shall not be levied until the petition is decided;'", "'the additional surcharge is nil meanwhile.'"),
    2: (f"concat('For open access consumers connected at ', {_LEVEL}, ', ', {_LOSS}, '.25% distribution loss shall apply.')", "'It was Rs. 5 before.'"),
    3: (f"concat('Intra-State transmission charges of ', {_CHARGE}, ' paise as determined by the Commission.')", "'Banking was not asked for.'"),
    4: (f"concat('Transmission losses ', {_LOSS}, '.18% apply, transmission charges Rs. ', {_CHARGE}, ' per unit too.')", "'All is said.'"),
    5: ("'The additional surcharge is to be filed separately.'", "'It is as nil as before.'"),
    6: ("'The surcharge was discussed.'", "'It is nil.'"),
    7: (f"concat('Charges of ', {_CHARGE}, ' paise are as before;')", "'no more was said.'"),
}
_FORM = "(l_orderkey + l_linenumber) % 8"
_FIRST = "concat('On ', CAST(l_partkey AS VARCHAR(12)), '.')"
_SPEECH = {n: f"CASE {_FORM} {' '.join(f'WHEN {i} THEN {s[n]}' for i, s in SAID.items())} END" for n in (0, 1)}
_TEXT = f"concat({_FIRST}, ' ', {_SPEECH[0]}, '  ', {_SPEECH[1]})"
_FOUND = [  # form, sentence, family, status, state, value, unit, level, target
    (0, 1, "additional_surcharge", "approved_zero", "zero", "NULL", "NULL", "NULL", "NULL"),
    (0, 2, "banking_rule", "by_reference", "absent_in_source", "NULL", "NULL", "NULL", "'as per the Regulations of the State.'"),
    (1, 1, "additional_surcharge", "not_levied_pending_petition", "absent_in_source", "NULL", "NULL", "NULL", "NULL"),
    (1, 2, "additional_surcharge", "approved_zero", "zero", "NULL", "NULL", "NULL", "NULL"),
    (2, 1, "oa_loss", "approved", "value", f"concat({_LOSS}, '.25')", "'percent'", _LEVEL, "NULL"),
    (3, 1, "transmission_reference", "by_reference", "value", _CHARGE, "'paise'", "'intra-state transmission'", "'as determined by the Commission.'"),
    (4, 1, "transmission_reference", "parameter_specified", "value", f"concat({_LOSS}, '.18')", "'percent'", "'transmission'", "NULL"),
    (4, 1, "transmission_reference", "parameter_specified", "value", _CHARGE, "'INR_per_kWh'", "'transmission'", "NULL"),
    (5, 1, "additional_surcharge", "deferred_to_separate_petition", "absent_in_source", "NULL", "NULL", "NULL", "NULL"),
]
_START = {1: f"length({_FIRST}) + 1", 2: f"length({_FIRST}) + 3 + length({_SPEECH[0]})"}


@query("prose_decisions", " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, {n} AS sentence_no, {_START[n]} AS start, '{f}' AS family, '{s}' AS status, '{st}' AS state, {v} AS value, {u} AS unit, {le} AS level, {t} AS target FROM lineitem WHERE {_FORM} = {i}" for i, n, f, s, st, v, u, le, t in _FOUND))
def prose_decisions(spark, sf_dir) -> DataFrame:
    """Decisions on network charges in the sentences of each line, with their places (X17): printed from the line's own figures and read back."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = table(spark, sf_dir, "lineitem").select(*key, F.expr(_TEXT).alias("text"))
    return decisions(lines, key, "text").drop("sentence", "found")


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


_LINES = "lines AS (SELECT doc_id, unnest(range(len(t))) AS line_no, unnest(t) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL))"
_PROSE = r"(len(list_filter(regexp_split_to_array({0}, '[ \t]+'), lambda w: w <> '')) >= 6 AND len(regexp_extract_all({0}, '[A-Za-z]{{3,}}')) >= 4)"
_TITLE = "length(text) between 1 and 60 and right(text, 1) not in ('.', ';', ':', ',')"
_UP, _DOWN = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
_NEAR = lambda test, way: f"{'last' if way == _UP else 'first'}_value(CASE WHEN {test} THEN struct_pack(at := line_no, text := text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no {way})"


@query("figure_surroundings", f"""WITH {_LINES}, m AS (SELECT *, {_NEAR(_TITLE, _UP)} AS title, {_NEAR("regexp_matches(text, '(?i)^[ ]*Table[ ]+[0-9]+[-–.][0-9]+')", _UP)} AS caption, {_NEAR(_PROSE.format('text'), _UP)} AS b, {_NEAR(_PROSE.format('text'), _DOWN)} AS a FROM lines)
SELECT doc_id, line_no, title.text AS title, 1 / (1 + abs(line_no - title.at))::DOUBLE AS title_weight, caption.text AS caption, md5(b.text) AS before, 1 / (1 + abs(line_no - b.at))::DOUBLE AS before_weight, md5(a.text) AS after, 1 / (1 + abs(line_no - a.at))::DOUBLE AS after_weight FROM m WHERE regexp_matches(text, '[0-9]')""")
def figure_surroundings(spark, sf_dir) -> DataFrame:
    """Lines of every document that hold a figure, with the nearest title and caption above and the nearest prose before and after, weighed by distance."""
    roles = {"title": F.expr(_TITLE), "caption": F.col("text").rlike(CAPTION), "reason": is_prose(F.col("text"))}
    out = surroundings(_lines(spark, sf_dir), ["doc_id"], "line_no", "text", F.col("text").rlike("[0-9]"), roles, ("reason",))
    return out.select("doc_id", "line_no", "title", "title_weight", "caption", F.md5("reason").alias("before"), F.col("reason_weight").alias("before_weight"), F.md5("reason_after").alias("after"), F.col("reason_after_weight").alias("after_weight"))


_FIGURE = "[0-9]+(?:[.,][0-9]+)*"


@query("figures_named", rf"""WITH {_LINES}, c AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(text, '([.;])(\s+)', '\1' || chr(1) || '\2', 'g'), '\b(Rs|No|Nos|Sr|viz)\.' || chr(1), '\1.', 'g') AS text FROM lines),
s AS (SELECT doc_id, line_no, unnest(range(len(t))) AS n, unnest(t) AS s FROM (SELECT *, string_split(text, chr(1)) AS t FROM c)), q AS (SELECT doc_id, line_no, n, regexp_replace(s, '^\s+', '') AS s FROM s),
w AS (SELECT DISTINCT doc_id, line_no, n, s, unnest(regexp_extract_all(s, '{_FIGURE}')) AS token FROM q WHERE {_PROSE.format('s')}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY line_no, n, s) AS r FROM w)
SELECT doc_id, token, count(*) AS n_sentences, string_agg(md5(trim(s)), ' ' ORDER BY line_no, n, s) AS sentences FROM k WHERE r <= 2 GROUP BY ALL""")
def figures_named(spark, sf_dir) -> DataFrame:
    """For every figure of each document the first two sentences of prose that name it."""
    spoken = sentences(_lines(spark, sf_dir), ["doc_id", "line_no"], "text").withColumn("tokens", F.regexp_extract_all("sentence", F.lit(_FIGURE), F.lit(0)))
    asked = _lines(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_FIGURE), F.lit(0))).alias("token"))
    out = naming(spoken, asked, ["doc_id"], ["line_no", "sentence_no"])
    return out.select("doc_id", "token", F.size("sentences").cast("long").alias("n_sentences"), F.concat_ws(" ", F.transform("sentences", lambda s: F.md5(s))).alias("sentences"))
