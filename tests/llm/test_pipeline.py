"""The pipeline's stages over the small tables, each against what it must do to its own input."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_decontaminate import slow_words  # noqa: E402
from textloom.llm.common import stash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_ids(steps):
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.dtypes == before.dtypes
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    packed = steps[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in steps[4].collect()}
    assert max(r.offset + r.length for r in packed) <= 2048


def test_quality_keeps_clean_labelled_documents(spark, steps):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    clean = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_one_document_of_each_group(steps):
    """Groups by all pairs: five-word shingles at a similarity of 0.8 or more."""
    sets = {}
    for r in steps[1].collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({find(i) for i in sets})


def test_no_benchmark_window_is_left(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = slow_words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [slow_words(t)] for i in range(len(w) - 9))
    before = steps[2].collect()
    assert {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in before if not hit(r.text)}
    assert any(hit(r.text) for r in before)


def test_secrets_are_masked_and_nothing_else_changes(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    secret = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    for r in steps[4].collect():
        old = before[r.doc_id]
        want = secret.sub("[SECRET]", old.text)
        assert r.text == want
        assert r.n_chars == (old.n_chars if want == old.text else len(want))
