"""The pipeline's stages on the small table, each against what it must do to its own input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import frame, links, passages

from factspring.llm import language_id, quality_rules

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return out


def test_columns_stay_and_rows_only_go(kept):
    for (_, before), (name, after) in zip(kept, kept[1:-1]):
        assert after.columns == before.columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_one_of_each_group_stays(kept):
    before, after = dict(kept)["quality_rules"], dict(kept)["near_dedup"]
    expected = {c for _, c in links([(r.doc_id, r.text) for r in before.collect()]).values()}
    assert {r.doc_id for r in after.collect()} == expected


def test_passages_go(kept):
    before, after = dict(kept)["near_dedup"], dict(kept)["suffix_dedup"]
    expected = passages([(r.doc_id, r.text) for r in before.collect()])
    left = {r.doc_id: r for r in after.collect()}
    assert set(left) == set(expected)
    assert all(0 <= expected[d][0] - expected[d][1] - len(r.text.encode()) <= 3 * 2 * expected[d][2] for d, r in left.items())  # cut code points go whole
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_every_document_is_packed(kept):
    before, after = dict(kept)["suffix_dedup"], dict(kept)["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_languages_by_brute_force(spark, kept):
    """Each text through the training's forward pass, window by window."""
    before, after = (dict(kept)[n] for n in ("documents", "language_id"))
    model = language_id.train(before, ~language_id.held_out(F.col("doc_id")))
    expected = set()
    for r in before.collect():
        if any(c.isalpha() for c in r.text or ""):
            x, live, _ = language_id.windowed([r.text.encode()])
            probabilities, _ = model.forward(x.T, live.T.astype(np.float32))
            mean = (probabilities * live.T[..., None]).sum((0, 1)) / live.sum()
            if mean.max() >= corpus_pipeline.MIN_SCORE:
                expected.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == expected


def test_quality_by_sql(kept):
    before, after = (dict(kept)[n] for n in ("language_id", "quality_rules"))
    connection = duckdb.connect()
    documents = before.toPandas()
    connection.register("documents", documents)
    connection.execute(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet'")
    expected = {d for d, k in connection.execute(f"SELECT doc_id, kept FROM ({quality_rules.pooled_rules_sql()})").fetchall() if k}
    assert {r.doc_id for r in after.collect()} == expected


def adverse(spark):
    """Nulls, empty and long texts, ties, repeated rows, ids that repeat, and columns that stages make themselves."""
    words = " ".join(f"word{i % 977} of{i % 31}" for i in range(4000))
    base = " ".join(f"some{i} plain words" for i in range(60))
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, None), (None, base + " and more", "en"), (4, "", "fr"), (5, words, "en"), (6, "12 34", "fr"), (7, words + " tail", None), (7, "une autre phrase que nul ne porte", "fr"), (1, base, "en")]
    made = ("score", "lang_pred", "n_bytes", "n_removed", "kept_sha256", "kept_text", "component_id")
    df = frame(spark, rows)
    return df.withColumns({name: F.lit("mine") for name in made})


@pytest.mark.parametrize("k", range(4))
def test_stages_on_an_adverse_table(spark, k):
    docs = adverse(spark)
    name, function = corpus_pipeline.STAGES[k]
    out = function(spark, docs, SF)
    assert out.columns == docs.columns, name
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in ("score", "lang_pred", "n_bytes", "n_removed", "kept_sha256", "kept_text", "component_id")) and all(r["a.b"] == "x" for r in rows)
    ids = sorted((r.doc_id for r in rows), key=lambda d: (d is None, d or 0))
    if name == "language_id":
        assert set(ids) <= {1, 2, 5, 7, None}
    elif name == "quality_rules":
        assert ids == [1, 1, 2, 2, 5, 7, None]  # under 20 words or repeating themselves: 3, 4, 6 and one text of 7
    elif name == "near_dedup":
        assert ids == [1, 3, 4, 5, 6, None]  # 2 repeats 1, 7 repeats 5
    else:
        assert len(rows) == docs.count() and {r.text for r in rows if r.doc_id == 2} == {""} and {r.text for r in rows if r.doc_id == 3} == {""}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, k):
    empty = adverse(spark).limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, empty, SF).count() == 0


def test_packing_of_an_adverse_table(spark):
    docs = adverse(spark)
    out = corpus_pipeline.packed(spark, docs, SF).groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("rows")).collect()
    assert {r.doc_id: r["rows"] for r in out} == {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
