import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality

WORDS = [a + b for a in ("an", "ber", "cho", "du", "el") for b in ("ta", "mor", "li", "ving", "ter", "so")]


def corpus(n=900):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 200))]
        kind = 0 if i % 10 < 7 else 1 if i % 10 < 9 else 2
        if kind == 1:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:20] for _ in range(9)]
        if kind == 2:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words), "lw"))
        if i % 3:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    return rows, labels


def test_held_out_accuracy_and_columns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None, "x"), (5000, "", "x")], "doc_id long, text string, log_weight string")
    kept, name = quality.resample(docs, spark.createDataFrame([*labels, (None, 1, 0), (1, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int"))
    assert name == "log_weight_" and kept.columns == [*docs.columns, name]
    ids = {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 900}
    clean = {i for i, *_ in rows if i % 10 < 7}
    assert len(clean - ids) <= 3 and len(ids - clean) <= 3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, none)[0].count() == 3
    assert quality.resample(docs.limit(0), none)[0].count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_top_k(spark, k):
    rng = np.random.default_rng(3)
    keys = [float(x) for x in np.concatenate([rng.normal(size=600), np.full(300, 0.25), rng.normal(size=100) * 1e-9 - 50])]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "id long, key double")
    got = sorted(r.key for r in quality.top_k(rows, "key", k, bins=8).collect())
    assert got == sorted(keys)[max(0, len(keys) - k) :]


def test_top_k_of_one_value(spark):
    rows = spark.range(50).select("id", F.lit(1.5).alias("key"))
    assert quality.top_k(rows, "key", 20).count() == 20


def test_gumbel_noise_is_standard(spark):
    rows = spark.range(20000).withColumn("w", F.lit(0.0)).select(quality.gumbel_key("w", F.col("id")).alias("g"))
    mean, deviation = rows.agg(F.avg("g"), F.stddev("g")).first()
    assert abs(mean - 0.5772) < 0.03 and abs(deviation - 1.2825) < 0.03


def test_features_of_odd_texts():
    for text in (None, b"", b" ", b"\xff\xfe x", b"a " * 400_000, " ".join(f"w{i}" for i in range(350_000)).encode()):
        found = quality.features(text)
        assert len(found) and 0 <= found.min() and found.max() < quality.BUCKETS


def test_labels_held_out(spark):
    """Taught with the labels of one half of the ids, judged by the other half, both ways."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    right = {True: [0, 0], False: [0, 0]}
    for half in (0, 1):
        kept = {r.doc_id for r in quality.resample(docs, labels.where(f"pmod(hash(doc_id), 2) = {half}"), keep_columns=False)[0].collect()}
        for r in labels.where(f"pmod(hash(doc_id), 2) <> {half}").collect():
            clean = r.quality == 1 and r.toxic == 0
            right[clean][0] += (r.doc_id in kept) == clean
            right[clean][1] += 1
    assert right[True][0] >= 0.97 * right[True][1] and right[False][0] >= 0.8 * right[False][1], right
