"""Batches of rows of like length under a budget of tokens.

Lengths are put into buckets by k-means in one dimension, over a histogram of the lengths: each round is one aggregate of
as many rows as there are lengths, and only the centres, ``k`` numbers, come to the driver. A bucket is then cut into
batches of equal size. Rows are numbered within cells of one length and hash, so that no bucket is ever sorted in one
task. The rows keep their key, by which results come back in the original order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, CELLS = 32, 64


def nearest(length: Column, centres: list[float]) -> Column:
    """The number of the nearest centre, the first of two."""
    far = F.transform(F.array(*[F.lit(c) for c in centres]), lambda c, i: F.struct(F.abs(length - c).alias("far"), i.alias("i")))
    return F.array_min(far)["i"]


def centres(lengths: DataFrame, k: int, rounds: int = ROUNDS) -> list[float]:
    """The centres of ``k`` clusters of lengths (length, n), from evenly spaced ones on; fewer where one is nobody's nearest."""
    low, high = lengths.agg(F.min("length"), F.max("length")).first()
    if low is None:
        return []
    now = [low + (j + 0.5) * (high - low) / k for j in range(k)]
    for _ in range(rounds):
        rows = lengths.groupBy(nearest(F.col("length"), now).alias("i")).agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("c")).collect()
        before, now = now, [r["c"] for r in sorted(rows, key=lambda r: r["i"])]
        if now == before:
            break
    return now


def batched(rows: DataFrame, length: str, key: str, tokens: int, k: int = 8, most: int | None = None) -> DataFrame:
    """``rows`` with bucket, batch and place: a bucket of centre c and m rows has round(c m / tokens) batches, one at least and m
    at most, whose sizes differ by one at most; ``most`` bounds the rows of a batch. Within a bucket rows go by length.
    Null lengths count as 0. An empty table gives none; equal keys are as good as different ones."""
    own = F.coalesce(F.col(length), F.lit(0))
    hist = rows.groupBy(own.cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n")).cache()
    found = centres(hist, k)
    hist.unpersist()
    if not found:
        return rows.withColumns({c: F.lit(None).cast("int") for c in ("bucket", "batch", "place")})
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    given = rows.withColumns({"bucket": nearest(own, found), "__length": own, "__cell": cell})
    sizes = given.groupBy("bucket", "__length", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("bucket").orderBy("__length", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("bucket")
    starts = sizes.select("bucket", "__length", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__m"))
    within = Window.partitionBy("bucket", "__length", "__cell").orderBy(key)
    numbered = given.withColumn("__i", F.row_number().over(within) - 1).join(starts, ["bucket", "__length", "__cell"])
    i, m = F.col("__start") + F.col("__i"), F.col("__m")
    centre = F.element_at(F.array(*[F.lit(c) for c in found]), F.col("bucket") + 1)
    chunks = F.greatest(F.lit(1), F.round(centre * m / tokens))
    chunks = F.least(m, F.greatest(chunks, F.ceil(m / most)) if most else chunks).cast("long")
    small = F.floor(m / chunks)
    large = m % chunks  # so many batches have one row more
    edge = large * (small + 1)
    batch = F.when(i < edge, F.floor(i / (small + 1))).otherwise(large + F.floor((i - edge) / small))
    place = F.when(i < edge, i % (small + 1)).otherwise((i - edge) % small)
    return numbered.withColumns({"batch": batch.cast("int"), "place": place.cast("int")}).select(*rows.columns, "bucket", "batch", "place")


def padding(rows: DataFrame, length: str) -> DataFrame:
    """One row (rows, batches, tokens, padded, share): ``padded`` is what the batches take with every row as long as the longest,
    ``share`` how much of that is filling."""
    own = rows.groupBy("bucket", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("t"), F.max(length).alias("longest"))
    sums = own.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("batches"), F.sum("t").alias("tokens"), F.sum(F.col("n") * F.col("longest")).alias("padded"))
    return sums.withColumn("share", 1 - F.col("tokens") / F.col("padded"))


def restored(results: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Results by key in the order that the rows had."""
    return results.join(rows.select(key, order), key).orderBy(order)
