import pytest
from pyspark.sql import functions as F

from factspring.calc.fixpoint import fill
from factspring.operators import structure


def test_fill_reaches_a_fixpoint(spark):
    cells = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("x", 99.0)], "cell string, value double")
    terms = spark.createDataFrame([("x", "a", 1.0), ("x", "b", -2.0), ("y", "x", 10.0), ("z", "missing", 1.0)], "cell string, source string, weight double")
    filled, passes = fill(cells, terms)
    assert {r.cell: r.value for r in filled.collect()} == {"a": 2.0, "b": 3.0, "x": -4.0, "y": -40.0, "z": None} and passes == 3


def test_fill_that_never_ends_is_an_error(spark):
    cells = spark.createDataFrame([("a", 1.0)], "cell string, value double")
    terms = spark.createDataFrame([("x", "a", 1.0), ("x", "y", 1.0), ("y", "a", 1.0), ("y", "y2", 1.0), ("y2", "a", 1.0)], "cell string, source string, weight double")
    assert fill(cells, terms)[1] == 4
    with pytest.raises(RuntimeError):
        fill(cells, terms, passes=2)


def test_grid_headers_and_labels(spark):
    rows = [["Item", "2024", ""], ["", "Claimed", "Approved"], ["Energy", "1", "2"], ["", "3", "4"]]
    cells = spark.createDataFrame([(1, i, j, t) for i, r in enumerate(rows) for j, t in enumerate(r)], "grid int, row int, col int, text string")
    found = {(r.row, r.col): (r.text, r.header, r.label) for r in structure.grid_cells(cells, 2).collect()}
    assert found == {(2, 1): ("1", "2024 / Claimed", "Energy"), (2, 2): ("2", "2024 / Approved", "Energy"), (3, 1): ("3", "2024 / Claimed", "Energy"), (3, 2): ("4", "2024 / Approved", "Energy")}


def test_outline():
    lines = ["Preamble", "3.1 First", "goes on", "(a) letter", "(ii) roman", "(b) next", "", "3.2 Second"]
    assert structure.outline(lines) == [("", "Preamble"), ("3/1", "First goes on"), ("3/1/a", "letter"), ("3/1/a/ii", "roman"), ("3/1/b", "next"), ("3/2", "Second")]


def test_merged_keeps_all_evidence(spark):
    df = spark.createDataFrame([("k", 1, 0.5, "p1"), ("k", 2, 0.9, "p2"), ("m", 3, 0.1, "p9")], "key string, id int, confidence double, page string")
    out = {r.key: (r.id, r.page) for r in structure.merged(df, ["key"], [F.col("confidence").desc(), F.col("id")], "page").collect()}
    assert out == {"k": (2, ["p1", "p2"]), "m": (3, ["p9"])}
