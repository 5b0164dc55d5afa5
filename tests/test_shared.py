"""Staged tables: written, read back, removed at the end of a scope."""

import os

from factspring.sources.shared import scratch, shared_folder, stage


def test_staged_tables_go_with_their_scope(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    with scratch(spark):
        kept = stage(spark.range(5).selectExpr("id", "id % 2 AS `a.b`").repartition(2), "scoped")
        assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.columns == ["id", "a.b"]
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_the_cleanup_setting_is_given_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    stage(spark.range(3).groupBy("id").count(), "counted")
    assert spark.conf.get(name) == before
