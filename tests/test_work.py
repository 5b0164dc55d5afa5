"""Decisions, pages, columns and rule documents against plain code on small cases."""

import json
import random

from pyspark.sql import functions as F

from factspring.functions import titles
from factspring.operators import checks, selection, tables, work


def plain_decisions(steps):
    standing = []
    for outcome, reviewer, second in steps:
        if outcome == "undo":
            standing[-1:] = []
        else:
            standing.append((outcome, reviewer, second))
    if not standing:
        return "open", None
    first = standing[0]
    final = lambda s: ({"approve": "approved", "correct": "corrected", "reject": "rejected"}.get(s[0], "unresolved"), s[1])
    if first[0] not in ("approve", "correct") or not first[2]:
        return final(first)
    other = next((s for s in standing[1:] if s[1] != first[1]), None)
    return final(other) if other else ("awaiting_second_review", first[1])


def test_decisions_and_undos(spark):
    rng, rows, want = random.Random(5), [], {}
    for candidate in range(60):
        steps = []
        for _ in range(rng.randrange(1, 8)):
            standing = sum(-1 if s[0] == "undo" else 1 for s in steps)
            steps.append((rng.choice(["approve", "correct", "reject", "leave", *["undo"] * 3 * (standing > 0)]), rng.choice("ab"), rng.random() < 0.6))
        want[candidate] = plain_decisions(steps)
        rows += [(candidate, i, *s) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "c int, i int, outcome string, who string, again boolean")
    out = {r.c: (r.status, r.reviewed_by) for r in work.decided(df, ["c"], "i", "outcome", "who", F.col("again")).collect()}
    assert out == want


def plain_pages(pages, most, unread, reach):
    chosen, blank = [], [p for p, _, text in pages if not text]
    tabled = [p for p, t, _ in pages if t]
    readable = {p for p, _, text in pages if text}
    for p in [*tabled, *(q for d in range(1, reach + 1) for p in tabled for q in (p - d, p + d))]:
        if p in readable and p not in chosen:
            chosen.append(p)
    return set(chosen[:most]) | set(blank[:unread])


def test_chosen_pages(spark):
    rng, rows, want = random.Random(7), [], {}
    for doc in range(40):
        pages = [(p, rng.random() < 0.2, rng.random() < 0.8) for p in range(1, rng.randrange(2, 30))]
        want[doc] = plain_pages(pages, 6, 2, 2)
        rows += [(doc, *p) for p in pages]
    df = spark.createDataFrame(rows, "doc int, page int, tabled boolean, readable boolean")
    out = {d: set() for d in want}
    for r in selection.chosen_pages(df, ["doc"], "page", F.col("tabled"), F.col("readable"), 6, 2, 2).collect():
        out[r.doc].add(r.page)
    assert out == want


def test_batches_of_a_large_group(spark):
    rows = [("big" if i % 10 else "small", i, i * 37 % 91 if i % 13 else None) for i in range(500)]
    out = tables.batches(spark.createDataFrame(rows, "g string, i int, n int").repartition(7), "g", ["i"], "n", 300).collect()
    before, want = {}, {}
    for g, i, n in rows:
        want[g, i] = before.get(g, 0) // 300
        before[g] = before.get(g, 0) + (n or 0)
    assert {(r.g, r.i): r.batch for r in out} == want


def test_rule_documents(spark, tmp_path):
    one = {"rule": "R-1", "version": 2, "output": "net", "formula": "a - b", "status": "approved", "from_fy": "FY2024-25"}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "two.json").write_text(json.dumps([one | {"rule": "R-2"}, one | {"rule": "R-3", "to_fy": "FY2030-31"}]))
    out = {r.rule: (r.version, r.to_fy, r.file) for r in work.rule_documents(spark, str(tmp_path)).collect()}
    assert out == {"R-1": (2, None, "one.json"), "R-2": (2, None, "two.json"), "R-3": (2, "FY2030-31", "two.json")}


def test_nulls_and_empty_tables(spark):
    nothing = spark.createDataFrame([], "c int, i int, outcome string, who string")
    assert work.decided(nothing, ["c"], "i", "outcome", "who", F.lit(True)).count() == 0
    line = spark.createDataFrame([(None,)], "t string")
    said = titles.chapters(line, "t", "a").select("a", titles.section_class(F.col("t")).alias("b"), titles.document_kind(F.col("t")).alias("c"), titles.unit_hint(F.col("t")).alias("d"), titles.years_named(F.col("t")).alias("e")).first()
    assert not said.a and said.b is None and said.c.kind is None and said.d.currency is None and said.e is None
    pages = spark.createDataFrame([(1, "has 12"), (2, None)], "page int, text string")
    rows = spark.createDataFrame([(1, 1, "12"), (1, 2, None), (2, 3, "12"), (3, 4, "12"), (None, 5, "12"), (None, 6, "x")], "page int, row int, cells string")
    held = {r.row: r.holds for r in checks.on_their_page(rows, ["row"], ["page"], F.col("cells"), pages, "text").collect()}
    assert held == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_twins_keep_the_best_without_sorting(spark, monkeypatch):
    rng = random.Random(3)
    boxes = lambda n: [(rng.randrange(3), i, float(x), float(y), float(x + rng.randint(0, 40)), float(y + rng.randint(1, 30))) for i in range(n) for x, y in [(rng.randint(-20, 60), rng.randint(-20, 40))]]
    schema = "page int, id long, x0 double, y0 double, x1 double, y1 double"
    a, b = boxes(150), boxes(400)

    def share(p, q):
        both = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        return both / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - both) if both else 0

    want = {p[1]: max(((share(p, q) * 1e9 - q[1] / 1e6, q[1]) for q in b if q[0] == p[0] and share(p, q) >= 0.5), default=(0, None))[1] for p in a}
    planned, put = [], work.stage
    monkeypatch.setattr(work, "stage", lambda df, name: planned.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, name))
    out = work.twins(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["page"], ["x0", "y0", "x1", "y1"], "id")
    assert {r.id: r.chosen for r in out.collect()} == want and len({v for v in want.values() if v is not None}) > 20
    assert planned and not any("SortAggregate" in p for p in planned)
