import time

from textloom.operators import entities


def test_the_longest_at_each_place_and_signs_of_patterns(spark):
    docs = spark.createDataFrame([(1, "abcabxa.b"), (2, ""), (3, None)], "doc_id int, text string")
    got = [tuple(r) for r in entities.longest_prefix_matches(docs, ["a", "ab", "abc", "bca", "a.b", "", "ab"]).collect()]
    assert got == [(1, 0, 3, "abc"), (1, 3, 5, "ab"), (1, 6, 9, "a.b")]
    assert entities.longest_prefix_matches(docs, [""]).count() == 0


def test_long_texts_are_not_walked_sign_by_sign(spark):
    docs = spark.range(8).selectExpr("id AS doc_id", "repeat('x', 3000000) AS text").coalesce(1)
    words = ["w" * n for n in range(1, 9)]
    entities.longest_prefix_matches(docs.limit(1), words).count()
    start = time.perf_counter()
    assert entities.longest_prefix_matches(docs, words).count() == 0
    assert time.perf_counter() - start < 6
