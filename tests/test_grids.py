import os

from factspring.catalogue import QUERIES
from factspring.operators.grids import interpreted, text_cells
from factspring.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def staged(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_grid_values_move_lines_and_orders_once_and_stage_nothing(spark):
    before = staged(spark)
    df = QUERIES["grid_values"](spark, SF)
    assert staged(spark) == before and exchanges(df) <= 3  # lines, orders, titles


def test_cells_are_moved_once(spark):
    rows = [["S.No.", "Particulars", "FY 2023-24", None, "FY 2024-25", None], [None, None, "Claimed", "Approved", "Claimed", "Approved"], [None, "Power Purchase"], ["1", "Station A", "10", "9", "(8)", "-"], ["2", "Station B", "4", "5", "6", "7"]]
    cells = spark.createDataFrame([(p, i, j, t) for p in (1, 2) for i, r in enumerate(rows) for j, t in enumerate(r)], "page int, row int, col int, text string")
    out = interpreted(cells, "page")
    assert exchanges(out) == 1
    found = {(r.row, r.col): (r.label, r.group, r.fiscal_year, r.voice, float(r.value)) for r in out.where("page = 2").collect()}
    assert len(found) == 7 and found[3, 4] == ("Station A", "Power Purchase", "FY2024-25", "claimed", -8.0) and found[4, 3] == ("Station B", "Power Purchase", "FY2023-24", "approved", 5.0)


def test_text_tables_move_lines_and_orders_once_and_stage_nothing(spark):
    before = staged(spark)
    df = QUERIES["text_tables"](spark, SF)
    assert staged(spark) == before and exchanges(df) <= 3


def test_text_is_read_by_places(spark):
    printed = ["   Particulars        2023-24   2024-25", "1. Power Purchase       10.0      (8.0)", "2. Other words here        4          5", "Total                   14.0       12"]
    lines = spark.createDataFrame([(7, i, t) for i, t in enumerate([*printed, ""])] + [(8, 0, "words alone")], "p int, r int, t string")
    found = {(c.page, c.row, c.col): c.text for c in text_cells(lines, "p", "r", "t").collect()}
    assert found == {(7, 0, 0): "Particulars", (7, 0, 1): "2023-24", (7, 0, 2): "2024-25", (7, 1, 0): "1. Power Purchase", (7, 1, 1): "10.0", (7, 1, 2): "(8.0)", (7, 2, 0): "2. Other words here", (7, 2, 1): "4", (7, 2, 2): "5", (7, 3, 0): "Total", (7, 3, 1): "14.0", (7, 3, 2): "12"}
