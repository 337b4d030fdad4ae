"""The audit of sources against a plain count, and the tries by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=200):
    rows = [(x or "", s or "", TERM.findall((t or "").translate(SMALL))) for x, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in mine for t in set(r[2]))
        kept = [t for t, n in docs.items() if n >= 3]
        counts = defaultdict(Counter)
        for _, s, words in mine:
            counts[s].update(w for w in words if docs[w] >= 3)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            typical = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", typical)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(ordered) if part == "pair" or r < most]
    return sorted(out)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(tuple(r) for r in divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [rng.choice(["", "é", "日本", "co"]) + "".join(rng.choices("abC", k=rng.randint(1, 5))) for _ in range(vocabulary)]
    return [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]


@pytest.mark.parametrize("more", [{}, {"prefix": 1}, {"entries": 5, "words": 20}, {"words": 50}, {"leaves": 7}, {"cells": 3}, {"most_terms": 4}])
def test_against_a_plain_count(spark, more):
    rows = corpus(3, 150)
    assert run(spark, rows, **more) == plain(rows, more.get("most_terms", 200))


def test_edges(spark):
    same = [("en", "a", "x y x")] * 3 + [("en", "b", "y y")] * 3
    odd = [("fr", "a", None), ("fr", "b", ""), ("fr", "c", "once"), (None, None, None), ("it", "only", "ciao ciao")] + [("it", "only", "ciao")] * 3
    assert run(spark, same + odd) == plain(same + odd)
    assert run(spark, []) == []


def test_ties_are_in_utf8_order_and_long_texts_whole(spark):
    texts = " ".join(["zz", "é", "𝔞", "aa", "ﬀ"] * 200_000)
    rows = [("en", "a", texts)] * 3 + [("en", "b", "other " * 7)] * 3
    found = run(spark, rows)
    assert found == plain(rows)
    assert [r[3] for r in sorted((r for r in found if r[1:3] == ("a", "term")), key=lambda r: r[5])] == ["aa", "zz", "é", "ﬀ", "𝔞"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("en", "a", "x", 1, "p")] * 3 + [("en", "b", "y", 1, "p")], "lang string, source string, text string, n int, prefix string")
    assert divergence.audit(docs).where("part = 'pair'").count() == 2


def test_a_trie_gives_its_leaves_back():
    rng = random.Random(9)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 8))).encode() for _ in range(80)]
    made = divergence.counted(["en", "de"], ["s", "t"], [words, words[::2]], [0, 1])
    rows = pa.Table.from_batches([made.laid_out(2), made.laid_out(2)])
    assert all(len(t) <= 2 for t in rows["prefix"].to_pylist())
    terms = [list(divergence.walk(r["depth"], r["label"])) for r in rows.slice(0, len(rows) // 2).to_pylist() if r["lang"] == "en"]
    assert [t for part in terms for t in part] == sorted(set(words))
    twice = divergence.of_tries(rows)
    assert twice.terms == made.terms and (twice.n == 2 * made.n).all() and (twice.docs == 2).all()
    assert len(twice.at_least(3).terms) == 0 and twice.at_least(3).laid_out(2) is None


def test_shares_are_exact_for_large_counts():
    for count, whole in ((10**14, 3 * 10**14), (0, 1), (9 * 10**14, 9 * 10**14 + 1), (12345, 99999)):
        assert divergence.shares(np.array([count]), whole)[0] == 1 + 10**9 * (count + 1) // whole
