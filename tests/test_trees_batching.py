"""Bracketed trees as spans, and batches by length."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import batching, trees

CASE = "(S (NP-SBJ (NN rain)) (VP (VV falls) (NP (NP (NN day)) (CC and) (NP (NN night)))))"


def test_spans_parents_and_tags(spark):
    rows = trees.nodes(spark.createDataFrame([(1, CASE)], "sent_id int, tree string")).orderBy("node").collect()
    label = {r["node"]: r["label"] for r in rows}
    assert [(r["label"], r["start"], r["end"], r["depth"], label.get(r["parent"]), r["tag"]) for r in rows] == [
        ("S", 0, 5, 1, None, False), ("NP-SBJ", 0, 1, 2, "S", False), ("NN", 0, 1, 3, "NP-SBJ", True), ("VP", 1, 5, 2, "S", False), ("VV", 1, 2, 3, "VP", True), ("NP", 2, 5, 3, "VP", False),
        ("NP", 2, 3, 4, "NP", False), ("NN", 2, 3, 5, "NP", True), ("CC", 3, 4, 4, "NP", True), ("NP", 4, 5, 4, "NP", False), ("NN", 4, 5, 5, "NP", True),
    ]


def random_tree(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return f"({rng.choice(['NN', 'VV', '-X-'])} {rng.choice(['a', 'b', '日', 'c-d'])})"
    return f"({rng.choice(['S', 'NP-SBJ', 'VP'])} {' '.join(random_tree(rng, depth + 1) for _ in range(rng.randint(1, 3)))})"


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, random_tree(rng)) for i in range(40)]
    df = spark.createDataFrame(rows, "sent_id int, tree string")
    assert {r["sent_id"]: r["tree"] for r in trees.bracketed(trees.nodes(df), trees.words(df)).collect()} == dict(rows)


def test_odd_trees(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "((S (NN a)))"), (4, "(S (NN a"), (5, "(S (NP) (NN a))")], "sent_id int, tree string")
    rows = trees.nodes(df).orderBy("sent_id", "node").collect()
    assert [(r["label"], r["start"], r["end"]) for r in rows if r["sent_id"] == 3] == [("", 0, 1), ("S", 0, 1), ("NN", 0, 1)]
    assert not [r for r in rows if r["sent_id"] in (1, 2, 4)]
    assert [(r["label"], r["start"], r["end"], r["tag"]) for r in rows if r["sent_id"] == 5] == [("S", 0, 1, False), ("NP", 0, 0, False), ("NN", 0, 1, True)]
    plain = trees.nodes(spark.createDataFrame([(1, "(NP-SBJ (-NONE- x))")], "sent_id int, tree string"), subcategories=False)
    assert sorted(r["label"] for r in plain.collect()) == ["-NONE", "NP"] or sorted(r["label"] for r in plain.collect()) == ["-NONE-", "NP"]


def test_batches(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([3, 10, 11, 12, 200, 210, 1000])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, n int")
    found = batching.batched(df, "n", "id", 4000, k=4)
    out = found.collect()
    assert sorted((r["id"], r["n"]) for r in out) == rows
    sizes = {}
    for r in out:
        sizes.setdefault(r["bucket"], {}).setdefault(r["batch"], []).append(r["place"])
    for batches in sizes.values():
        assert sorted(batches) == list(range(len(batches)))
        assert max(map(len, batches.values())) - min(map(len, batches.values())) <= 1
        assert all(sorted(p) == list(range(len(p))) for p in batches.values())
    share = batching.padding(found, "n").first()
    mixed = df.withColumns({"bucket": F.lit(0), "batch": F.pmod(F.xxhash64("id"), F.lit(int(share["batches"])))})
    assert share["rows"] == 500 and share["share"] < 0.3 < batching.padding(mixed, "n").first()["share"]


def test_batches_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 5)], "id int, n int")
    assert batching.batched(df, "n", "id", 10).count() == 3
    assert batching.batched(df.where("id > 1"), "n", "id", 10).count() == 0
    many = spark.range(100).withColumn("n", F.lit(1))
    assert batching.batched(many, "n", "id", 10**6, most=7).groupBy("bucket", "batch").count().agg(F.max("count")).first()[0] <= 7
    back = batching.restored(many.select("id"), many.withColumn("at", 100 - F.col("id")), "id", "at")
    assert [r["id"] for r in back.limit(3).collect()] == [99, 98, 97]


@pytest.mark.parametrize("k", [1, 3])
def test_centres(spark, k):
    hist = spark.createDataFrame([(1, 10), (2, 10), (50, 5), (100, 1)], "length long, n long")
    found = batching.centres(hist, k)
    assert found == ([pytest.approx(380 / 26)] if k == 1 else [1.5, 50.0, 100.0])


def test_trees_are_walked_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "(S (NP-SBJ (NN a)) (VP b c))"), (2, ") (A (B x"), (3, None), (4, "(A (B x)) ) (C y)")], "sent_id long, tree string")
    found = trees.nodes(rows, parent_labels=True)
    for df in (found, trees.words(rows)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.sent_id, r.node, r.parent, r.depth, r.label, r.parent_label, r.start, r.end, r.tag) for r in found.where("sent_id = 1").collect())
    assert got == [(1, 0, None, 1, "S", None, 0, 3, False), (1, 2, 0, 2, "NP-SBJ", "S", 0, 1, False), (1, 4, 2, 3, "NN", "NP-SBJ", 0, 1, True), (1, 9, 0, 2, "VP", "S", 1, 3, False)]
    assert sorted((r.sent_id, r.label, r.depth, r.start, r.end) for r in found.where("sent_id <> 1").collect()) == [(4, "A", 1, 0, 1), (4, "B", 2, 0, 1), (4, "C", 0, 1, 2)]
