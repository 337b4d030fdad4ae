import random

from tests.llm.test_substrings import jaccard, prose
from textloom.llm import substrings


def test_similar_paragraphs_around_a_frequent_passage(spark):
    """300 paragraphs of which 85 words of 100 are the same passage; each has a near copy, and no two others are similar."""
    rng = random.Random(9)
    passage, lines = prose(rng, 85), []
    for _ in range(150):
        own = prose(rng, 15).split()
        copy = list(own)
        copy[rng.randrange(2, 13)] = "changed"
        lines += [f"{passage} {' '.join(x)}" for x in (own, copy)]
    assert jaccard(lines[0], lines[1]) >= 0.8 > jaccard(lines[0], lines[2])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {}
    for r in substrings.repeats(docs).where("not floating").collect():
        got.setdefault(r["class"], set()).add(r.id)
    whole = sum({2 * k, 2 * k + 1} in got.values() for k in range(150))
    assert whole >= 0.99 * 150, f"{whole} of 150"
    assert all(i // 2 == j // 2 for c in got.values() for i in c for j in c)
