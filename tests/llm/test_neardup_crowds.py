"""Crowds of near copies in the pipeline's second stage: as many links as texts, not as pairs, and no component lost."""

import random

from tests.llm.test_neardup import mutated
from tests.llm.test_neardup_fingerprints import prints_of
from tests.llm.test_substrings import jaccard, prose
from textloom.llm import neardup


def group(n, most):
    """Copies of a text, each with one to ``most`` words of 150 changed."""
    rng = random.Random(n)
    base = prose(rng, 150)
    return [mutated(rng, base, rng.randint(1, most)) for _ in range(n)]


def test_links_within_a_crowd_grow_with_its_texts(spark):
    for size in (150, 600):
        prints, _ = prints_of(spark, group(size, 6))
        pairs, hot = neardup.candidates(prints, small=100)
        crowd = {r.content for r in hot.collect()}
        assert len(crowd) >= 0.9 * size
        links = sum(r.a in crowd and r.b in crowd for r in pairs.collect())
        assert 0 < links <= 2 * neardup.SEGMENTS * len(crowd)


def test_components_of_a_crowd(spark):
    """Many of these texts are similar to none or to few of the others."""
    texts = group(160, 12)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {find(i) for i in range(len(texts))}
    assert 10 < len(want) < 150
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
