import random

import corpus_pipeline
from tests.llm.test_substrings import WORDS, jaccard, prose
from textloom.llm import neardup


def mutated(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def test_planted_near_copies_go(spark):
    rng = random.Random(7)
    rows, copies = [], set()
    for k in range(60):
        text = prose(rng, rng.randint(120, 300))
        rows.append((k, text))
        for j in range(rng.randint(0, 3)):
            copy = mutated(rng, text, rng.randint(1, 5))
            rows.append((1000 + 10 * k + j, copy))
            if jaccard(text, copy) >= 0.8:
                copies.add(rows[-1][0])
    assert sum(jaccard(rows[0][1], mutated(rng, rows[0][1], 3)) < 0.95 for _ in range(5)) == 5 and len(copies) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert set(range(60)) <= got
    assert len(got & copies) <= 0.01 * len(copies)


def test_components_against_all_pairs(spark):
    """A large group of near copies that is not all similar to any one of them, and texts that share much with it."""
    rng = random.Random(8)
    base, texts = prose(rng, 150), []
    for _ in range(100):
        texts.append(mutated(rng, base, rng.randint(1, 6)))
    texts += [base[: len(base) // 2] + " " + prose(rng, 60) for _ in range(40)]
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
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {find(i) for i in range(len(texts))}


def test_short_empty_and_null(spark):
    rows = [(1, None), (2, ""), (None, " "), (3, "a b"), (4, "A  b"), (None, "c d e"), (None, "C D E"), (5, "a"), (5, "a"), (5, "q")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in got) == [("1", ""), ("3", "a b"), ("5", "a"), ("5", "q"), ("None", "c d e")]
    assert neardup.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
