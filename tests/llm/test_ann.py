import math

import numpy as np
import pytest

from textloom.llm import ann


def exact(rows, k=5, asks=lambda i: i % 50 == 0):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fine:
        if asks(q):
            found = sorted((-(float((x * y).sum()) / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in fine if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def clustered(n, width=16, centres=12):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(centres, width))
    return [(i, [float(np.float32(x)) for x in c[i % centres] + 0.6 * rng.normal(size=width)]) for i in range(n)]


def run(spark, rows, **more):
    frame = spark.createDataFrame([(v, i, 1, "s") for i, v in rows], "embedding array<float>, vec_id long, rank int, id string")
    out = {}
    for r in ann.search(frame, "id % 50 = 0", **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [4096, 100])
def test_recall_and_scores(spark, block):
    rows = clustered(6000)
    want, got = exact(rows), run(spark, rows, block=block)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 5 * len(want)
    for q in want:
        near = dict(want[q])
        assert all(abs(s - near[i]) < 1e-14 for i, s in got[q] if i in near)


def test_ties_go_by_id(spark):
    rows = clustered(1500)
    rows += [(i, rows[50][1]) for i in range(1500, 2600)]
    got = run(spark, rows, block=200)
    assert [i for i, _ in got[50]] == [1500, 1501, 1502, 1503, 1504]
    assert [i for i, _ in got[1500]] == [50, 1501, 1502, 1503, 1504]


def test_odd_vectors(spark):
    good = clustered(60, 4)
    odd = [(100, None), (150, []), (200, [0.0] * 4), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 1.0, 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (400, [1.0, 2.0])]
    assert run(spark, good + odd) == exact(good)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    assert run(spark, rows) == {0: [(1, 1.0), (2, 0.0)]}
    assert run(spark, rows[:1]) == {} and run(spark, []) == {}
