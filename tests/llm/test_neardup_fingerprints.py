"""The pipeline's near-duplicates by fingerprints: each step against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_neardup import mutated
from tests.llm.test_substrings import jaccard, prose
from textloom.llm import neardup
from textloom.llm.substrings import MAP_BITS, mixed


def prints_of(spark, texts):
    content, leads = neardup.hashed([t.encode() for t in texts])
    rows = {c: p for c, p in zip(content.tolist(), leads, strict=True) if p is not None}
    return spark.createDataFrame([(c, bytearray(p)) for c, p in rows.items()], "content long, lead binary"), content.tolist()


@pytest.mark.parametrize("n", [1, 4, 255, 700])
def test_majorities(n):
    shingles = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    hashes = mixed(shingles[:, None] + neardup.SALTS).tolist()
    ones = [sum(row[k // 64] >> k % 64 & 1 for row in hashes) for k in range(neardup.BITS)]
    lead = neardup.majorities(shingles)
    assert np.sign(lead).tolist() == [(2 * x > n) - (2 * x < n) for x in ones]
    bits = neardup.fingerprints(lead[None])[0].tolist()
    assert [bits[k // 64] >> k % 64 & 1 for k in range(neardup.BITS)] == [int(2 * x > n) for x in ones]


def test_balls_hold_the_narrowest_majorities():
    lead = np.stack([neardup.majorities(np.random.default_rng(k).integers(0, 1 << 63, 200, dtype=np.uint64)) for k in range(3)])
    segments = np.array([2, 7])
    got = neardup.balls(lead, segments)
    for t in range(3):
        for i, s in enumerate(segments):
            own = lead[t, 32 * s : 32 * s + 32]
            order = np.argsort(np.abs(own), kind="stable")
            value = sum(1 << k for k in range(32) if own[k] > 0)
            assert got[:, t, i].tolist() == [value ^ sum(1 << int(order[r]) for r in ranks) for ranks in neardup.likeliest()]


@pytest.mark.parametrize("small, many, map_bits", [(24, 4, MAP_BITS), (2, 1, 16 * 5 * 250)])
def test_candidates_against_all_pairs(spark, small, many, map_bits):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 250)) for _ in range(60)]
    texts += [mutated(rng, t, rng.randint(1, 4)) for t in texts[:40] for _ in range(3)]
    texts += [mutated(rng, texts[0], 2) for _ in range(60)]
    prints, content = prints_of(spark, texts)
    pairs, hot = neardup.candidates(prints, small, many, map_bits)
    found, crowd = {(r.a, r.b) for r in pairs.collect()}, {r.content for r in hot.collect()}
    assert (map_bits == MAP_BITS) or crowd
    words = dict(zip(content, (neardup.fingerprints(np.frombuffer(p, np.int8)[None])[0] for p in neardup.hashed([t.encode() for t in texts])[1]), strict=True))
    assert all(np.bitwise_count(words[a] ^ words[b]).sum() <= neardup.RADIUS for a, b in found)
    want = {tuple(sorted((content[i], content[j]))) for i in range(len(texts)) for j in range(i) if content[i] != content[j] and jaccard(texts[i], texts[j]) >= 0.8}
    missed = {(a, b) for a, b in want - found if not (a in crowd and b in crowd)}
    assert len(want) > 100 and len(missed) <= 0.002 * len(want)


def test_the_stage_links_by_fingerprints_only(spark, monkeypatch):
    rng = random.Random(4)
    text = prose(rng, 150)
    docs = spark.createDataFrame([(1, text), (2, mutated(rng, text, 1)), (3, text)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]
    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "content long")
    monkeypatch.setattr(neardup, "candidates", lambda prints: none)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]
