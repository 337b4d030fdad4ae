"""Scores of multisets: one shuffle for all kinds, and tasks of bounded rows."""

from textloom.operators import metrics
from textloom.queries import QUERIES


def test_both_kinds_are_counted_after_one_shuffle(spark):
    plan = QUERIES["arc_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning" not in plan and "Join" not in plan


def test_more_rows_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SHARE", 1000)
    rows = spark.range(5000).selectExpr("id AS sent_id", "1 AS child", "0 AS head", "'x' AS rel")
    plan = metrics.arc_scores(rows, rows, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sent_id#" in plan and ", 5), REPARTITION_BY_NUM" in plan


def test_nulls_match_nothing_and_repeats_count(spark):
    t = "sent_id int, child int, head int, rel string"
    gold = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "a"), (1, 1, None, "b"), (2, 0, 1, "a"), (3, 0, 1, None)], t)
    found = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "c"), (1, 1, None, "b"), (2, 0, 1, "a"), (3, 0, 1, None)], t)
    got = {r["kind"]: (r["matches"], r["gold"], r["found"], round(r["complete"], 3)) for r in metrics.arc_scores(gold, found).collect()}
    assert got == {"labelled": (2, 5, 5, 0.333), "unlabelled": (4, 5, 5, 0.667)}
