import itertools
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factspring.functions import labels
from factspring.operators import pairing
from factspring.operators.grouped import by_group
from factspring.operators.pairing import best_boxes, heaviest_run, paired_places, staged_pairs
from factspring.sources import files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4)), max_size=9))
def test_heaviest_run(pairs):
    values, weights = [p[0] for p in pairs], [float(p[1]) for p in pairs]
    kept = heaviest_run(values, weights)
    assert kept == sorted(kept) and all(values[a] <= values[b] for a, b in itertools.pairwise(kept))
    best = max(sum(weights[i] for i in c) for n in range(len(pairs) + 1) for c in itertools.combinations(range(len(pairs)), n) if all(values[a] <= values[b] for a, b in itertools.pairwise(c)))
    assert sum(weights[i] for i in kept) == best


def test_staged_pairs(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (4, "c", "q")], "l int, k string, m string")
    right = spark.createDataFrame([(10, "a", "x"), (20, "b", "y"), (30, "b", "w"), (40, "d", "q"), (50, "d", "q")], "r int, k string, m string")
    assert sorted(map(tuple, staged_pairs(left, right, "l", "r", [["k", "m"], ["k"], ["m"]]).collect())) == [(1, 10, 1), (2, 20, 1), (3, 30, 2)]


def test_boxes_are_used_once(spark):
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 9.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([(1, 5, 0.0, 0.0, 10.0, 10.0), (1, 6, 0.0, 1.0, 10.0, 10.0), (2, 7, 5.0, 5.0, 6.0, 6.0)], schema)
    assert sorted((r.page, r.left, r.right) for r in best_boxes(a, b, "page").collect()) == [(1, 1, 5), (1, 2, 6)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), max_size=5), min_size=3, max_size=3), st.lists(st.lists(st.integers(0, 8), max_size=5), min_size=3, max_size=3), st.lists(st.sampled_from([0.0, 0.5, 0.6, 1.0]), min_size=9, max_size=9))
def test_places_pair_as_their_boxes_do(lefts, rights, ious):
    lefts, rights = ({(float(i),): sorted(set(ids)) for i, ids in enumerate(side)} for side in (lefts, rights))
    met = [(iou, a, b) for iou, (a, b) in zip(ious, itertools.product(lefts, rights)) if iou]
    used_left, used_right, out = set(), set(), []
    for iou, one, other in sorted(((iou, x, y) for iou, a, b in met for x in lefts[a] for y in rights[b]), key=lambda m: (-m[0], m[1], m[2])):
        if one not in used_left and other not in used_right:
            used_left.add(one)
            used_right.add(other)
            out.append((one, other, iou))
    assert paired_places(lefts, rights, met) == out


def test_boxes_that_lie_alike_make_no_pairs_of_all(spark, monkeypatch):
    boxes = spark.range(3000).selectExpr("1 as page", "id", "double(0) as x0", "double(0) as y0", "double(4) as x1", "double(2) as y1")
    other = boxes.withColumn("id", F.col("id") + 5)
    assert sorted((r.left, r.right) for r in best_boxes(boxes, other, "page").collect()) == [(i, i + 5) for i in range(3000)]
    monkeypatch.setattr(pairing, "by_group", lambda rows, *rest: rows)
    assert best_boxes(boxes, other, "page").count() <= 3  # two places and their overlap


def test_groups_with_missing_keys_stay_whole(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "k int, v int")
    out = by_group(df, ["k"], ["v"], lambda rows: [(len(rows),)], "n int").collect()
    assert [r.n for r in out] == [2, 2]


def test_labels(spark):
    df = spark.createDataFrame([("xiv", "lmv – 1 (a)", "#,##0.00", 12345678.9), ("MCMXC", "HV-2", "0%", -999.0), ("abc", "", "0.0", 100000.0)], "r string, c string, f string, n double")
    rows = df.select(labels.roman(F.col("r")), labels.code(F.col("c")), labels.decimals(F.col("f")), labels.indian(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(14, "LMV-1(A)", 2, "1,23,45,678.90"), (1990, "HV-2", 0, "-999.00"), (None, "", 1, "1,00,000.00")]
    said = spark.createDataFrame([("the claim of 5.2 and 7", "The  claim\nof 5.2", "8")], "t string, p string, q string")
    assert said.select(labels.unsupported_numbers(F.col("t"), F.col("p"), F.col("q"))).first()[0] == ["7"]
    assert said.select(labels.grounded(F.lit("theclaim of"), F.col("p"))).first()[0]
    assert said.select(labels.head_of(F.lit("Net ARR (Rs. Cr)")), labels.voice_of(F.lit("Approved in earlier order"))).first() == ("net_arr", "approved_earlier")


def test_files(spark, tmp_path):
    for name, rows in (("a", [{"url": "u1", "title": "one"}, {"url": "u2", "title": "two"}]), ("b", [{"url": "u2", "title": "again"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    listed = files.read_manifest(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert sorted((r.url, r.title) for r in listed.collect()) == [("u1", "one"), ("u2", "two")]
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, content in (("x.pdf", b"1"), ("y.pdf", b"1"), ("z.pdf", b"2")):
        (inbox / name).write_bytes(content)
    everything = files.register(spark, str(inbox), spark.createDataFrame([], "sha256 string"))
    assert sorted(r.path[-5:] for r in everything.collect()) == ["x.pdf", "z.pdf"]
    known = everything.where("path like '%x.pdf'")
    assert [r.path[-5:] for r in files.register(spark, str(inbox), known).collect()] == ["z.pdf"]
    assert {r.registered for r in files.inbox(everything, known).collect()} == {True, False}
    docs = spark.createDataFrame([("generic", 3, "g3"), ("c", 1, "c1"), ("c", 2, "c2")], "commission string, version int, doc string")
    assert [files.newest_documents(docs, *args).first().doc for args in (("c", "generic"), ("other", "generic"), ("c", "generic", 1))] == ["c2", "g3", "c1"]
    files.export(docs, str(tmp_path / "out"), "commission")
    files.append_ledger(docs, str(tmp_path / "ledger"))
    files.append_ledger(docs, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3 and spark.read.json(str(tmp_path / "ledger")).count() == 6
