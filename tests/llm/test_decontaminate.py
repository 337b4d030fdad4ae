import hashlib
import random
import re

import pytest

from textloom.llm import decontaminate, queries


def slow_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(doc, items):
    words, hit, ids = slow_words(doc), set(), set()
    for item, text in items:
        ws = slow_words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == ws[i : i + n]:
                    hit.update(range(j, j + n))
                    ids |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(ids)


def cases():
    rng = random.Random(3)
    letters = ["a", "b", "c1", "é", "Ω"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(3, 25)]
    items += [(100, None), (101, ""), (102, ".!"), (7, "Q w E r t y u i o p a"), (None, "z z z z z z z z z z z z"), (103, "q w e r t y u i o p a")]
    docs = [None, "", "...", "Q-W,E r\nt y u i o p", "x q w e r t y u i o p a q w e r t y u i o p", "z " * 11, "é", "a " * 5000]
    docs += [" ".join(rng.choice([*letters, "zz"]) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    docs += [f"foo {items[5][1]} {items[6][1]} bar"] * 3
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_report_against_brute_force(spark, block_bytes):
    docs, items = cases()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for r in decontaminate.report(frame, bench, block_bytes=block_bytes).collect():
        assert (r.n_words, r.n_hit, r["items"]) == slow(docs[r.id], items), docs[r.id]


def test_longest_matches(spark):
    doc = "p q " + " ".join(f"w{i}" for i in range(5, 30)) + " r"
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    found, _, at = decontaminate.matches(spark.createDataFrame([(1, doc)], "doc_id long, text string"), items)
    assert [tuple(m) for m in found.first()[at]] == [("1", 5, 2, 25)]


def test_clean_keeps_columns_and_rows(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(t, i, "m", 1) for i, t in enumerate(docs)], "text string, doc_id long, matches string, n_words int")
    kept = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.schema == frame.schema
    assert sorted(kept.collect(), key=lambda r: r.doc_id) == [r for r in frame.collect() if not slow(r.text, items)[1]]


def test_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.report(docs, items).collect()] == [(1, 2, 0, [])]
    assert decontaminate.report(docs.limit(0), items).count() == 0


def test_query(spark, tmp_path):
    docs, items = cases()
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in queries.op5_decontamination(spark, str(tmp_path)).collect():
        n, hit, ids = slow(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
