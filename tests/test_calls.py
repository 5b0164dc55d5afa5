"""Chunks, resumed runs and budgets of calls."""

from pyspark.sql import functions as F

from factspring.operators.calls import budgeted, chunked, resumed

CHUNK = "d string, chunk int, input_hash string"


def chunks(spark, pages, **caps):
    frame = spark.createDataFrame(pages, "d string, page int, tokens int, digest string")
    caps = {"most_tokens": 10, "most_pages": 3, "overlap": 0} | caps
    return chunked(frame, "d", "page", "tokens", "digest", **caps)


def test_caps_large_pages_gaps_and_repeats(spark):
    pages = [("a", p, t, "x") for p, t in ((1, 4), (2, 6), (3, 1), (5, 50), (6, None), (7, 1), (8, 1), (9, 1))]
    out = [(r.chunk, r.first_page, r.last_page, r.tokens) for r in chunks(spark, pages + pages[:2]).orderBy("chunk").collect()]
    assert out == [(0, 1, 2, 10), (1, 3, 3, 1), (2, 5, 5, 50), (3, 6, 8, 2), (4, 9, 9, 1)]
    assert chunks(spark, pages).limit(0).count() == 0


def test_overlap_is_context_and_part_of_the_hash(spark):
    pages = [("a", p, 5, str(p)) for p in range(1, 7)]
    rows = chunks(spark, pages, overlap=1).orderBy("chunk").collect()
    assert [(r.context_from, r.first_page, r.last_page, r.tokens) for r in rows] == [(1, 1, 2, 10), (2, 3, 4, 15), (4, 5, 6, 15)]
    again = chunks(spark, [(d, p, t, "new" if p == 2 else s) for d, p, t, s in pages], overlap=1).orderBy("chunk").collect()
    assert [a.input_hash == b.input_hash for a, b in zip(rows, again)] == [False, False, True]


def test_a_rerun_does_what_is_missing_within_the_budget(spark):
    plan = spark.createDataFrame([(d, i, h) for d in "ab" for i, h in enumerate(["h0", "h1", "h2", "h3", "h4"])], CHUNK)
    state = [("a", "h0", "v2", "failed", 0), ("a", "h0", "v2", "done", 1), ("a", "h1", "v2", "failed", 0), ("a", "h1", "v2", "failed", 1), ("a", "h2", "v2", "failed", 0), ("a", "h3", "v1", "done", 0), ("c", "h0", "v2", "done", 0)]
    todo = resumed(plan, spark.createDataFrame(state, "d string, input_hash string, version string, state string, attempt int"), "d", "v2", 2)
    assert [(r.todo, r.tries) for r in todo.where("d = 'a'").orderBy("chunk").collect()] == [("skip", 1), ("give_up", 2), ("again", 1), ("run", 0), ("run", 0)]
    spent = spark.createDataFrame([("a", 1.0), ("a", 0.5)], "d string, cost double")
    out = {(r.d, r.chunk): r.allowed for r in budgeted(todo, "d", F.lit(2), spent, "5.5").collect()}
    assert [out["a", i] for i in range(5)] == [None, None, True, True, False]
    assert [out["b", i] for i in range(5)] == [True, True, False, False, False]
    assert budgeted(todo.limit(0), "d", F.lit(2), spent, "1").count() == 0
