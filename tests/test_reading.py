import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factspring.ask.guard import refusal, run_read_only
from factspring.ask.spec import translate
from factspring.catalogue import QUERIES
from factspring.functions import figures, passages
from factspring.operators import passage_search, tables
from factspring.plans.metrics import best_passages
from factspring.plans.reading import borrowed_units
from factspring.quality.consensus import cluster
from factspring.streaming import events


def test_figures_and_states(spark):
    cells = {"1,23,456.78": ("value", 123456.78), "(12.5)": ("value", -12.5), "Rs. 7/-": ("value", 7.0), "8 %": ("value", 8.0), "Nil": ("zero", None), "-": ("not_applicable", None), " NA ": ("not_applicable", None), "": ("unknown", None), "see order": ("text", None), "1.2.3": ("text", None)}
    df = spark.createDataFrame([(c,) for c in [*cells, None]], "c string").select("c", figures.value_state(F.col("c")).alias("s"), figures.figure(F.col("c")).cast("double").alias("v"))
    found = {r.c: (r.s, r.v) for r in df.collect()}
    assert found.pop(None) == ("unknown", None) and found == cells


def test_years_units_and_slabs(spark):
    df = spark.createDataFrame([("FY 2024-25 and 2024-2025", "ARR (Rs. Cr)", "101-200"), ("2024-25, 2025-26", "Paise per unit", "above 300"), ("pages 2019-23", "kWh", "up to 50")], "y string, u string, s string")
    rows = df.select(figures.fiscal_year(F.col("y")), figures.unit_of(F.col("u")), figures.slab(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["FY2024-25", None, None]
    assert [r[1] for r in rows] == ["INR_crore", "paise_per_kWh", None]
    assert [tuple(r[2]) for r in rows] == [(101, 200), (300, None), (0, 50)]


def test_units_are_borrowed_on_three_figures_however_common(spark):
    common = [(t, "crore", f) for t in range(10) for f in (10001, 20002, 30003)]  # ten tables print each figure
    asked = [(20, None, f) for f in (10001, 20002, 30003)] + [(21, None, f) for f in (10001, 20002)] + [(22, None, f) for f in (10001, 20002, 30003, 40004)]
    plain = [(t, u, f) for t, u in ((11, "lakh"), (23, None)) for f in (101, 20000, 30000)]  # small or whole
    df = spark.createDataFrame([*common, *asked, *asked, *plain, (12, "lakh", 40004)], "tab long, unit string, figure long")
    assert [tuple(r) for r in borrowed_units(df).collect()] == [(20, "crore", 3)]


def test_passages_of_common_words_are_found(spark):
    told = "the commission approves the claim"
    docs = spark.createDataFrame([(d, f"Notes of day {d}\n\n {told} \n\n{told}\nagain" if d < 25 else "\n".join(["x" * 300] * 3) if d == 25 else None) for d in range(27)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Approves the commission?"), (2, "x" * 300), (3, "unheard")], "item_id long, text string")
    out = best_passages(docs, items).orderBy("item_id", "place").collect()
    assert [(r.item_id, r.doc_id, r.passage, r.place) for r in out] == [*((1, d, 2, d + 1) for d in range(4)), (2, 25, 1, 1), (2, 25, 2, 2)]
    assert all(r.score > 0 for r in out)


PLAIN_WORDS = lambda t: 13 * len(t.split()) // 10 + 1  # noqa: E731  estimated tokens


def plain_heading(t):
    letters, words = [c for c in t if c.isalpha()], t.split()
    if not letters or len(words) > 12 or t[-1] in ".:;,":
        return False
    return 10 * sum(c.isupper() for c in letters) > 6 * len(letters) or 4 * sum(not w[0].isalpha() or w[0].isupper() for w in words) > 3 * len(words)


def plain_paragraphs(text):
    """A plain reading, line by line."""
    found, before = [], None  # before: the paragraph that the last line went to, or None after a gap
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.strip()
        figures_ = [bool(re.fullmatch(r"[-–0-9.,()%]+", w)) for w in line.split()]
        if not line or all(figures_) or len(figures_) > 1 and 2 * sum(figures_) >= len(figures_):
            before = None
        elif before is None or re.match(r"(?i)(\d{1,2}(\.\d{1,3}){1,4}\.?|\(\s?[a-z]{1,4}\s?\)|[a-z]\))\s+\S", line) or len(before) == 1 and plain_heading(before[0]) and before[0][-1] != "-":
            before = [line]
            found.append(before)
        else:
            before.append(line)
    out = []
    for whole in (" ".join(" ".join(p).split()) for p in found):
        if len(whole) < 3:
            continue
        if plain_heading(whole):
            out.append(("heading", whole))
            continue
        pieces = [whole]
        if PLAIN_WORDS(whole) > 400:
            pieces = []
            for s in re.split(r"(?<=[.;:])\s+(?=[A-Z(\d])", whole):
                if pieces and PLAIN_WORDS(pieces[-1] + " " + s) <= 400:
                    pieces[-1] += " " + s
                else:
                    pieces.append(s)
        for piece in pieces:
            w = piece.split()
            out += [("text", piece)] if PLAIN_WORDS(piece) <= 400 else [("text", " ".join(w[i : i + 306])) for i in range(0, len(w), 306)]
    return out


def plain_chunks(parts):
    out, own = [], []
    for i, p in enumerate(parts, 1):
        if own and sum(PLAIN_WORDS(x) for _, x in own) + PLAIN_WORDS(p) > 400:
            out.append(own)
            own = []
        own.append((i, p))
        if sum(PLAIN_WORDS(x) for _, x in own) >= 200:
            out.append(own)
            own = []
    return [(c[0][0], "\n\n".join(x for _, x in c)) for c in [*out, own] if c]


SMALL_PAGES = {
    "ANNUAL REVENUE\n3.1 The Commission has\nlooked at it.\n1,200 34.5 (2)\n\n12\nIt approves the claim.\n(a) First item here": [("heading", "ANNUAL REVENUE"), ("text", "3.1 The Commission has looked at it."), ("text", "It approves the claim."), ("text", "(a) First item here")],
    "Power Purchase\nCost Of Power\nthe rest of it,\nand more": [("heading", "Power Purchase"), ("heading", "Cost Of Power"), ("text", "the rest of it, and more")],
    "CARRIED OVER-\nTHE LINE": [("heading", "CARRIED OVER- THE LINE")],
    "ab\n\n  \n. .": [],
    "": [],
}


def test_paragraphs_of_small_pages(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SMALL_PAGES)] + [(99, None)], "doc_id long, text string")
    out = {i: [] for i in range(len(SMALL_PAGES))}
    for r in passages.split_paragraphs(df).orderBy("doc_id", "seq").collect():
        out[r.doc_id].append((r.kind, r.text))
    assert out == dict(enumerate(SMALL_PAGES.values()))


@pytest.mark.parametrize("query", ["paragraph_kinds", "page_chunks"])
def test_paragraphs_and_chunks_by_a_plain_reading(spark, query):
    """The registered queries on their own table, and pages with long sentences and figures between lines."""
    from factspring.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    rnd = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "delta.", "of;", "12", "3.4%", "(a)", "x)", "1.2", "the", "and", "Élan", "a-", "–"]
    own = [(10**6 + i, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 14, 40, 700]))) for _ in range(rnd.randint(1, 30)))) for i in range(40)]
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect() + own
    made = QUERIES[query](spark, sf).collect() + (passages.split_paragraphs if query == "paragraph_kinds" else passages.chunk_pages)(spark.createDataFrame(own, "doc_id long, text string")).collect()
    out = {}
    for r in made:
        out.setdefault(r.doc_id, []).append((r.seq, r.kind, r.text) if query == "paragraph_kinds" else (r.paragraph_seq, r.text))
    for doc, text in given:
        expected = plain_paragraphs(text)
        expected = [(i, k, p) for i, (k, p) in enumerate(expected, 1)] if query == "paragraph_kinds" else plain_chunks([p for _, p in expected])
        assert sorted(out.get(doc, [])) == sorted(expected), doc


def reading(reader, value, page=1, label="Net ARR"):
    return {"utility": "U", "fiscal_year": "FY2024-25", "voice": "approved", "head": "arr", "label": label, "label_key": label.lower(), "page": page, "value": value, "reader": reader}


@pytest.mark.parametrize(
    "readings, expected",
    [
        ([reading("docling", 5.0)], [("single", "docling")]),
        ([reading("docling", 5.0), reading("textlayer", 5.004)], [("agreed_2", "textlayer,docling")]),
        ([reading("docling", 5.0), reading("textlayer", 5.0), reading("llm", 5.0)], [("agreed_3", "textlayer,docling,llm")]),
        ([reading("docling", 5.0), reading("textlayer", 6.0)], [("conflict", "textlayer,docling")]),
        ([reading("llm", 5.0), reading("llm", 5.0)], [("single", "llm"), ("single", "llm")]),
        ([reading("docling", 5.0), reading("textlayer", 5.0, 2, "Other")], [("single", "textlayer"), ("single", "docling")]),
    ],
)
def test_consensus(readings, expected):
    assert [(f["consensus"], f["readers"]) for f in cluster(readings)] == expected


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SET x = 1", "CREATE TABLE t AS SELECT 1", "SHOW TABLES", "not sql", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"])
def test_guard_refuses(spark, sql):
    assert refusal(spark, sql)


def test_guard_runs_one_query_and_tells_of_more(spark):
    df, capped = run_read_only(spark, "WITH a AS (SELECT id, 'DROP TABLE t' AS s FROM range(10)) SELECT * FROM a", rows=4)
    assert df.count() == 4 and capped


def test_questions():
    spec = translate("Which utility has the highest ARR?", 2024)
    assert (spec.shape, spec.limit, spec.heads, spec.voice, spec.years, len(spec.assumed)) == ("rank", 1, ["arr"], "approved", [2024], 2)
    assert translate("top 3 by O&M in 2023-24", 2024).limit == 3 and translate("lowest claimed ARR", 2024).descending is False
    assert translate("average actual ARR", 2024).years == []


def test_upsert_and_replay(spark):
    old = spark.createDataFrame([(1, "a", "r"), (2, "b", None)], "k int, v string, review string")
    new = spark.createDataFrame([(2, "B", "x"), (3, "C", None)], "k int, v string, review string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], ["review"]).collect())) == [(1, "a", "r"), (2, "B", "x"), (3, "C", None)]
    chain = spark.createDataFrame([("1", None), ("2", "1"), ("3", None)], "id string, supersedes string")
    assert sorted(r.id for r in tables.current_of(chain, "id").collect()) == ["2", "3"]


def test_streams_end_as_their_tables_do(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    done = events.running_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals_of_users").trigger(availableNow=True).start()
    done.awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "in"))
    assert {(r.user_id, r.n) for r in spark.table("totals_of_users").collect()} == {(r.user_id, r["count"]) for r in table.groupBy("user_id").count().collect()}
    sink = events.idempotent_sink(str(tmp_path / "out"))
    sink(table, 0)
    sink(table, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()
    closed = events.windowed(stream).writeStream.outputMode("append").format("memory").queryName("closed_windows").trigger(availableNow=True).start()
    closed.awaitTermination(120)
    whole = {(r.start, r.event_type, r.n) for r in events.windowed(table).collect()}
    assert {(r.start, r.event_type, r.n) for r in spark.table("closed_windows").collect()} <= whole


def test_passages_of_all_items_are_scored_where_they_lie(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda n: "\n\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 9))) for _ in range(n))
    docs = [(d % 30 if d else None, text(rng.randint(1, 6))) for d in range(40)] + [(None, text(3)), (50, None), (51, "")]  # ids recur, nulls too
    items = [(i, text(1)) for i in range(12)] + [(3, "aa bb"), (12, "...")]
    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    passages = [(d, ps.index(p) + 1, split(p)) for d, t in docs if t for ps in [t.split("\n\n")] for p in dict.fromkeys(ps)]
    n, mean = len(passages), sum(len(w) for *_, w in passages) / len(passages)
    held = Counter((d, p, len(ws), w) for d, p, ws in passages for w in ws)
    df = Counter(w for *_, w in held)
    words = defaultdict(set)
    for i, t in items:
        words[i] |= set(split(t))
    want = []
    for i, asked in words.items():
        scores = Counter()
        for (d, p, size, w), tf in sorted(held.items(), key=str):
            if w in asked:
                scores[d, p] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
        best = sorted(((round(-s, 9), -1 if d is None else d, p) for (d, p), s in scores.items()))[:4]
        want += [(i, d, p, -s, place) for place, (s, d, p) in enumerate(best, 1)]
    given = (spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda r: (r[0], r[4])
    read = lambda: sorted(((r.item_id, -1 if r.doc_id is None else r.doc_id, r.passage, pytest.approx(r.score), r.place) for r in best_passages(*given).collect()), key=key)
    assert sorted(want, key=key) == read()
    monkeypatch.setattr(passage_search, "ASKED", 20)  # several blocks of items
    monkeypatch.setattr(passage_search, "TILE", 50)
    assert sorted(want, key=key) == read()


def test_words_of_passages_are_not_moved(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "concat('common words of ', id) as text")
    plan = best_passages(docs, docs.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the best of each task meet by item


def test_passages_per_item_moves_no_words(spark):
    plan = QUERIES["passages_per_item"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
