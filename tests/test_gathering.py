import pytest

from textloom.operators import dictionaries
from textloom.queries import QUERIES


@pytest.mark.parametrize("name", ["tokens_put_together", "dictionary_names"])
def test_tokens_become_no_rows_before_the_end(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") <= 1 + (name == "dictionary_names")


def test_words_of_touching_tokens_are_put_together(spark):
    tokens = [(1, i, t, "N", s, s + len(t)) for i, (t, s) in enumerate([("ab", 0), ("c", 2), ("d", 3), ("ab", 5), ("c", 8), ("ab", 9), ("c", 11)])]
    rows = spark.createDataFrame([*tokens, (2, 0, "x", "V", 0, 1), (2, 4, "y", "N", 1, 2)], "doc_id int, tok_idx int, text string, pos string, start int, end int")
    words = spark.createDataFrame([(1, "abc"), (1, "abcd"), (1, "cd"), (1, None), (2, "xy"), (3, "z")], "doc_id int, word string")
    got = sorted(tuple(r) for r in dictionaries.put_together(rows, words).collect())
    assert got == [(1, 0, "abcd", "N", 0, 4), (1, 1, "ab", "N", 5, 7), (1, 2, "c", "N", 8, 9), (1, 3, "abc", "N", 9, 12), (2, 0, "xy", "N", 0, 2)]


@pytest.mark.parametrize("name", ["document_mentions", "chain_members", "mention_chains", "entity_attributes", "noun_signals", "entities_with_determiners", "entity_merge_by_place"])
def test_findings_are_made_within_one_row_a_document(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") <= 1


def test_verbs_above_are_found_along_long_chains_and_not_along_rings(spark):
    from textloom.operators import relations

    n = 300
    tokens = [(1, i, f"w{i}", "VV" if i == n else "NN") for i in range(n + 1)] + [(2, i, f"r{i}", "NN") for i in range(3)]
    deps = [(1, i, i + 1, "nn") for i in range(n)] + [(2, i, (i + 1) % 3, "nn") for i in range(3)]
    rows = relations.governing_verbs(spark.createDataFrame(deps, "doc_id int, child int, head int, rel string"), spark.createDataFrame(tokens, "doc_id int, tok_idx int, text string, pos string"))
    got = {(r["doc_id"], r["tok_idx"]): r["governing_verb"] for r in rows.collect()}
    assert got == {**{(1, i): f"w{n}" for i in range(n)}, **{(2, i): None for i in range(3)}}
