"""Sentences and their places, decisions, surroundings, benchmark ratios: small cases and whole tables."""

import re
from decimal import Decimal

from pyspark.sql import functions as F

from factspring.operators.benchmarks import Ratio, placed, ratios
from factspring.operators.prose import decisions, is_prose, naming, sentences, surroundings
from factspring.sources.catalog import table

SF = "/root/testdata/sf0.001"


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string")


def test_sentences_stand_where_they_say_in_the_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = sentences(docs, ["doc_id"], "text").collect()
    assert all(texts[r.doc_id][r.start :].startswith(r.sentence) for r in out)
    plain = {(d, s.strip(" ")) for d, t in texts.items() if t for s in re.split(r"(?<=[.;])(?<!\bRs\.)(?<!\bNo\.)(?<!\bNos\.)(?<!\bSr\.)(?<!\bviz\.)[ \t\n\x0b\f\r]+", t)}
    assert {(r.doc_id, r.sentence) for r in out} == {p for p in plain if p[1]}


def test_short_forms_blanks_and_repeated_rows(spark):
    frame = lines(spark, "  Rs. 5 is due;  no more. ", None, "", "   ")
    out = [(r.n, r.start, r.sentence) for r in sentences(frame.union(frame), ["n"], "text").collect()]
    assert sorted(out) == [(0, 2, "Rs. 5 is due;")] * 2 + [(0, 17, "no more.")] * 2
    assert sentences(frame.limit(0), ["n"], "text").count() == 0


def test_what_sentences_decide(spark):
    frame = lines(
        spark,
        "The additional surcharge shall be nil. The additional surcharge will be decided in a separate petition.",
        "Additional surcharge is zero and will be filed separately",
        "The surcharge is nil. It is additional.",
        "Banking, as provided in this and as specified in the Regulations of 2019, is allowed",
        "Open access consumers connected at 33 kV, 0.79% distribution loss shall apply and open access consumers connected above 66 kV 0.5 % losses will apply",
        "Inter-state transmission charges of Rs. 0.25 per unit and intra state transmission loss (3%) as determined by the SLDC",
        "transmission charges 25",
        None,
    )
    out = {}
    for r in decisions(frame, ["n"], "text").collect():
        out.setdefault(r.n, []).append((r.sentence_no, r.family, r.status, r.value, r.unit, r.level, r.target))
    s = "additional_surcharge"
    assert sorted(out[0]) == [(0, s, "approved_zero", None, None, None, None), (1, s, "deferred_to_separate_petition", None, None, None, None)]
    assert [x[2] for x in out[1]] == ["approved_zero"] and 2 not in out and 7 not in out
    assert out[3] == [(0, "banking_rule", "by_reference", None, None, None, "as specified in the Regulations of 2019, is allowed")]
    assert [(x[1], x[3], x[5]) for x in out[4]] == [("oa_loss", "0.79", "33 kV"), ("oa_loss", "0.5", "66 kV")]
    assert [(x[2], x[3], x[4], x[5]) for x in out[5]] == [("by_reference", "0.25", "INR_per_kWh", "inter-state transmission"), ("by_reference", "3", "percent", "intra state transmission")]
    assert out[6] == [(0, "transmission_reference", "parameter_specified", "25", None, "transmission", None)]


def test_nearest_lines_and_their_weights(spark):
    text = ["Title", "a reason of six real words here", "5", "Title two", "7 is a reason of six real words", "9"]
    frame = lines(spark, *text).withColumn("d", F.lit(1))
    roles = {"title": F.col("text").startswith("Title"), "reason": is_prose(F.col("text"))}
    out = {r.n: r for r in surroundings(frame, ["d"], "n", "text", F.col("text").rlike("[0-9]"), roles, ("reason",)).collect()}
    assert (out[2].title, out[2].title_weight, out[2].reason, out[2].reason_after, out[2].reason_after_weight) == ("Title", 1 / 3, text[1], text[4], 1 / 3)
    assert (out[4].reason, out[4].reason_after, out[5].reason, out[5].reason_after) == (text[1], None, text[4], None)


def test_first_sentences_of_a_common_figure(spark):
    said = [(1, i, f"sentence {i} has six real words and 5", ["5", "5", str(i)]) for i in range(50)] + [(1, 99, "5 | 5", ["5"])]
    spoken = spark.createDataFrame(said, "d int, i int, sentence string, tokens array<string>")
    asked = spark.createDataFrame([(1, "5"), (1, "5"), (1, "none"), (2, "5")], "d int, token string")
    assert [(r.token, len(r.sentences), r.sentences[0]) for r in naming(spoken, asked, ["d"], ["i"]).collect()] == [("5", 2, said[0][2])]


def test_ratios_reasons_and_places(spark):
    rows = [("a", "x", "10", "u", 1), ("a", "y", "4", "u", 1), ("a", "y", "5", "u", 2), ("b", "x", "1", "v", 1), ("b", "y", "0", "u", 1), ("c", "x", "1", "u", 1), ("c", "y", "0", "u", 1), ("d", "y", "1", None, 1), ("e", "x", "4", "u", 1), ("e", "y", "2", "u", 1), ("e", "x", None, "u", 9)]
    facts = spark.createDataFrame([(e, l, v and Decimal(v), u, o) for e, l, v, u, o in rows], "e string, line string, value decimal(18,4), unit string, o int")
    found = ratios(facts, ["e"], F.col("o"), [Ratio("x/y", "x", "u", "y", "u"), Ratio("x", "x", "u")])
    assert {(r.e, r.ratio): r.reason or float(r.value) for r in found.collect()} == {
        ("a", "x/y"): 2.0, ("b", "x/y"): "another unit: x in v", ("c", "x/y"): "y is nought", ("d", "x/y"): "not printed: x", ("e", "x/y"): 2.0,
        ("a", "x"): 10.0, ("b", "x"): "another unit: x in v", ("c", "x"): 1.0, ("d", "x"): "not printed: x", ("e", "x"): 4.0,
    }
    out = {(r.e, r.ratio): (r.place, r.n, r.middle and float(r.middle)) for r in placed(found, ["ratio"], "value").collect()}
    assert out["a", "x/y"] == out["e", "x/y"] == (1, 2, 2.0) and out["b", "x/y"] == (None, 2, 2.0)
    assert [out[e, "x"] for e in "cea"] == [(1, 3, 4.0), (2, 3, 4.0), (3, 3, 4.0)]
    assert placed(found.limit(0), ["ratio"], "value").count() == 0
    assert {(r.place, r.n) for r in placed(found.withColumn("value", F.lit(None).cast("decimal(28,4)")), ["ratio"], "value").collect()} == {(None, 0)}
