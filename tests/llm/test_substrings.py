import random

import numpy as np

from textloom.llm import substrings

WORDS = [a + b + c for a in ("an", "be", "co", "du", "el") for b in ("ta", "mo", "li", "vi", "te") for c in ("n", "s", "r", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_gram_hashes():
    words = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    words[30:40] = words[5:15]
    got = substrings.gram_hashes(words, 10)
    assert len(got) == 41 and got[30] == got[5] and len(set(got.tolist())) == 40
    assert len(substrings.gram_hashes(words[:3], 10)) == 1 and len(substrings.gram_hashes(words, 50)) == 1


def test_windows_of_a_shared_passage():
    rng = np.random.default_rng(2)
    for _ in range(50):
        passage = rng.integers(0, 1 << 63, substrings.LEAST + substrings.STEP - 1).astype(np.uint64)
        cuts = []
        for _ in range(2):
            n, m = rng.integers(0, 200, 2)
            text = np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), passage, rng.integers(0, 1 << 63, m).astype(np.uint64)])
            cuts.append({tuple(text[i : i + substrings.LEAST]) for i in substrings.windows(text)})
        assert cuts[0] & cuts[1]


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_lines(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(60):
        base = prose(rng, rng.randint(60, 200)).split()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            lines.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {}
    for r in substrings.repeats(docs).where("not floating").collect():
        got.setdefault(r["class"], set()).add(r.id)
    group = {i: frozenset(c) for c in got.values() for i in c}
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.8]
    assert sum(group.get(i) == group.get(j) is not None for i, j in pairs) >= 0.98 * len(pairs)
    assert all(i // 4 == j // 4 for c in got.values() for i in c for j in c)


def test_planted_passages(spark):
    rng = random.Random(3)
    passage = prose(rng, 30) + ".\n" + prose(rng, 22)
    rows = [(i, f"{prose(rng, 80)}\n{prose(rng, 60)}") for i in range(40)]
    planted = set(range(100, 112))
    rows += [(i, f"{prose(rng, rng.randint(1, 90))} {passage} {prose(rng, 70)}") for i in planted]
    copies = {200, 201, 202}
    rows += [(i, rows[3][1]) for i in copies]
    twice = prose(rng, 55)
    rows += [(300, f"{twice}\nx y\n{twice}"), (301, f"short {' '.join(passage.split()[:20])}"), (302, None), (303, ""), (None, passage), (304, "the same line\n" * 50), (305, "the same line of mine\n")]
    docs = spark.createDataFrame([(i, t, "c", 1, True) for i, t in rows], "doc_id long, text string, content string, start int, keep boolean")
    got = substrings.repeats(docs).collect()
    assert {r.id for r in got} == planted | copies | {3}
    assert all(r.keep == (r.id in (100, 3)) for r in got)
    for r in got:
        text = next(t for i, t in rows if i == r.id)
        assert r.start + r.words <= len(text.split())
    spans = substrings.removed_spans(substrings.repeats(docs)).collect()
    assert {r.id for r in spans} == (planted | copies) - {100}
    assert all(r.end - r.start >= 40 for r in spans)


def test_very_long_line_and_nothing(spark):
    rng = random.Random(5)
    long = prose(rng, 30_000)
    docs = spark.createDataFrame([(1, long), (2, "x " + long), (3, "a b c")], "doc_id long, text string")
    assert {r.id for r in substrings.repeats(docs).collect()} == {1, 2}
    assert substrings.repeats(docs.limit(0)).count() == 0
