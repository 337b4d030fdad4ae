"""Trees are scored and written again within their rows, equal ones walked once."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_trees_batching import random_tree
from textloom.operators import metrics, trees
from textloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_trees_are_walked_once():
    seen = []
    found = trees.of_each(pa.array(["(A x)", None, "(A x)", "", "(A x)"]), "node int", lambda t: seen.append(t) or ([(7,)] if t else []))
    assert seen == ["(A x)", ""] and found.to_pylist() == [[{"node": 7}], None, [{"node": 7}], [], [{"node": 7}]]


def test_scores_are_those_of_the_tables(spark):
    rng = random.Random(11)
    rows = [(i, random_tree(rng), random_tree(rng)) for i in range(120)] + [(900, "(S (S (S (A x))) (S (B y)))", "(S (S (A x)) (B y))"), (901, None, "(S (A x) (B y))")]
    df = spark.createDataFrame(rows, "sent_id int, gold string, found string")
    for subcategories in (True, False):
        told = lambda c, s=subcategories: trees.constituents(trees.nodes(df.select("sent_id", F.col(c).alias("tree")), subcategories=s))
        want = metrics.bracket_scores(told("gold"), told("found")).where("kind = 'labelled'").select("matches", "gold", "found").first()
        own = df.select(*[F.coalesce(trees.constituents_in(c, s), F.array().cast("array<struct<start:int,end:int,label:string,nth:int>>")).alias(c) for c, s in (("gold", subcategories), ("found", subcategories))])
        assert tuple(metrics.bracket_scores_in(own).first()) == tuple(want)


def test_scores_need_no_join_and_walk_trees_once(spark):
    scores = plan(QUERIES["tree_scores"](spark, SF))
    assert "Exchange hashpartitioning" not in scores and "Join" not in scores and scores.count("ArrowEvalPython") == 1


def test_only_lines_are_shuffled_for_texts_of_trees(spark):
    assert len(re.findall("Exchange hashpartitioning", plan(QUERIES["trees_again"](spark, SF)))) == 1
