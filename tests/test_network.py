"""Network charges: matrices, losses, named charges, tables that determine nothing."""

from pyspark.sql import functions as F

from factspring.operators.network import charges


def cells(spark, *rows):
    return spark.createDataFrame([(g, i, 0, h, r, raw) for i, (g, h, r, raw) in enumerate(rows)], "g string, row int, col int, headers array<string>, rows array<string>, raw string")


def read(spark, *rows, trajectory=None):
    facts, refused = charges(cells(spark, *rows), ["g"], trajectory)
    found = {}
    for r in facts.collect():
        found.setdefault((r.g, r.row), []).append((r.family, float(r.value), r.unit, r.injection, r.drawal, r.level, r.period))
    return found, {r.g: r.reason for r in refused.collect()}


def test_a_matrix_keeps_both_levels_and_bracketed_losses(spark):
    found, refused = read(spark, ("m", ["Wheeling", "Drawal at 11 kV"], ["Injection", "33 kV"], "0.45 (3.5%)"), ("m", ["Wheeling", "Drawal at LT"], ["Injection", "33 kV"], "Rs. 1,000.5 [4 losses]"), ("m", ["Wheeling", "LT"], ["33 kV"], "nil"), ("m", ["Wheeling", "LT"], ["33 kV"], None))
    assert found == {
        ("m", 0): [("wheeling_charge", 0.45, "INR_per_kWh", "33 kV", "Drawal at 11 kV", None, None), ("oa_loss", 3.5, "percent", "33 kV", "Drawal at 11 kV", None, None)],
        ("m", 1): [("wheeling_charge", 1000.5, "INR_per_kWh", "33 kV", "Drawal at LT", None, None), ("oa_loss", 4.0, "percent", "33 kV", "Drawal at LT", None, None)],
    }
    assert refused == {}


def test_losses_are_percentages_at_a_level_or_in_a_year(spark):
    rows = [("l", ["Loss", "FY 2024-25"], ["Below 11 kV"], "7.5%"), ("l", ["Loss", "MW"], ["33 kV"], "120"), ("l", ["Share %"], ["Rest"], "5")]
    found, _ = read(spark, *rows)
    assert found == {("l", 0): [("oa_loss", 7.5, "percent", None, None, "Below 11 kV", "FY2024-25")]}
    found, refused = read(spark, *rows, ("w", ["Wheeling"], ["33 kV"], "1"), trajectory=F.lit(True))
    assert found["l", 0][0][0] == "distribution_loss_approved" and refused == {"w": "no family known"}


def test_charges_need_their_name_and_a_unit(spark):
    found, refused = read(
        spark,
        ("a", ["Additional surcharge"], ["All"], "0.5"),
        ("a", ["Additional surcharge", "Rs/kWh"], ["All"], "0.6"),
        ("a", ["Other", "Rs/kWh"], ["All"], "0.7"),
        ("b", ["Wheeling cost"], ["33 kV"], "5"),
        ("c", None, [None], "5"),
        ("d", ["CSS", "per unit"], ["HT"], "1.5"),
    )
    assert {k: v[0][:3] for k, v in found.items()} == {("a", 1): ("additional_surcharge", 0.6, "INR_per_kWh"), ("d", 5): ("cross_subsidy_surcharge", 1.5, "INR_per_kWh")}
    assert refused == {"b": "wheeling_charge in a table of amounts", "c": "no family known"}


def test_no_cells(spark):
    facts, refused = charges(cells(spark, ("a", [], [], "")).limit(0), ["g"])
    assert facts.count() == refused.count() == 0
