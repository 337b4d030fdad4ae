"""The registered queries over the small tables against brute force."""

from collections import Counter

import numpy as np
import xxhash
from tokenizers import Tokenizer

import public_tokenizers
from textloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow_fingerprint(text):
    w = words(low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(spark):
    prints = {i: slow_fingerprint(t) for i, t in texts(spark).items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_op3(spark):
    source = texts(spark)
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len((t or "").encode()) + 1) for i, t in source.items())
    loads = Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
    assert set(loads) == set(range(8)) and all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in loads)
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)


def test_op4_finds_every_shared_passage(spark):
    """Documents that share 51 words in a row with another have rows; others have rows only for near copies of 40 words."""
    found = {r.doc_id for r in QUERIES["op4_repeats"](spark, SF).collect()}
    holders = {}
    for i, t in texts(spark).items():
        w = words(low(t))
        for k in range(len(w) - 50):
            holders.setdefault(tuple(w[k : k + 51]), set()).add(i)
    shared = {i for s in holders.values() if len(s) > 1 for i in s}
    assert shared and shared <= found
    short = {}
    for i, t in texts(spark).items():
        w = words(low(t))
        for k in range(len(w) - 4):
            short.setdefault(tuple(w[k : k + 5]), set()).add(i)
    assert found <= {i for s in short.values() if len(s) > 1 for i in s}


def test_op6(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {}
    for r in QUERIES["op6_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        cosine = unit @ unit[ids == q][0]
        order = [int(ids[k]) for k in np.lexsort((ids, -cosine)) if ids[k] != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine[ids == v][0]) < 1e-12 for v, s in found.values())
        hit += len(set(order) & {v for v, _ in found.values()})
    assert hit >= 0.9 * 5 * len(got)


def test_op8(spark):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(encode.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts(spark).items()}
    rows = QUERIES["op8_packing"](spark, SF).collect()
    want = {(i, k, 2048 * k, min(2048, n - 2048 * k)) for i, n in sizes.items() for k in range(-(-n // 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(sizes.values()) // 2048) + 1


def test_op9(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert len(kept) == len(rows) and kept <= set(texts(spark))
    clean = {i for i, x in labels.items() if x == (1, 0)}
    assert len(clean & kept) >= 0.95 * len(clean)
