import re

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash

DOCS = "doc_id long, text string, ID string, fp string, component int"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "One Two", "a b c", "A É b \x0b c d e f", "x " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("hot", [1, 48])
def test_links_against_all_pairs(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12)
    found = {0, -1}
    for b in base:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            found.add(int(np.array([int(b) ^ sum(1 << int(f) for f in flips)], np.uint64).view(np.int64)[0]))
    found = sorted(found)
    want = {(a, b) for i, b in enumerate(found) for a in found[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    got = simhash.links(spark.createDataFrame([(f,) for f in found], "fp long"), hot).collect()
    assert {tuple(sorted(r)) for r in got} == want


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    for t in texts[:6]:
        for _ in range(3):
            parts = t.split()
            parts[int(rng.integers(len(parts)))] = "changed"
            texts.append(" ".join(parts))
    texts += [None, "", " ", "One two", "one TWO", texts[0], texts[0]]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    prints = [slow_fingerprint(t) for t in texts]
    want = dict(enumerate(zip(prints, slow_components(prints), strict=True)))
    for hot in (1, 48):
        got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), hot=hot).collect()}
        assert got == want


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "q r s t"), (4, "a b c d"), (4, "a b c d"), (4, "q r s t u v w")]
    got = sorted((str(r.id), str(r.component)) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("4", "4"), ("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_grows_is_merged_not_broadcast(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(6 + i % 5))) for i in range(60)] + [(100 + i, "a b c") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.fingerprints(docs).select("fp").distinct()
    for found in (simhash.links(prints, 1), simhash.links(prints)):
        found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.component for r in simhash.near_duplicates(docs).collect()}
    assert len(want) == 65 and all(want[100 + i] == 100 for i in range(5))
    for heavy in (0, 1, 4):
        assert {r.id: r.component for r in simhash.near_duplicates(docs, heavy=heavy).collect()} == want


def test_components_by_merges(spark, monkeypatch):
    from textloom.llm import common

    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(40, 60)] + [(60, 29), (70, 71), (71, 70), (80, 80)], "a long, b long")
    want = {r.node: r.component for r in common.components(edges).collect()}
    for many in (0, 3, 256):
        monkeypatch.setattr(common, "MANY", many)
        assert {r.node: r.component for r in common.components(edges, merge=True).collect()} == want
