"""Quality classification by importance resampling.

A text is the set of its hashed n-grams: words, pairs of neighbouring words, beginnings of words, and coarse shares of
capitals, repetitions, signs and different words. Two generative models over these features are counted: one for the
target (documents labelled good and harmless), one for raw text, over every document there is. Every feature has its
ratio of the two. The target is known from fewer documents, so its rates are smoothed towards the raw ones: a priori
nearly all features are as frequent in the target as in raw text, and a few are rarer by an unknown factor (a gamma
distribution); the ratio is the one expected after the counts, which for a feature with little evidence is next to one.

Raw text holds the target: p_raw(x) = share * p_target(x) + (1 - share) * p_rest(x), with the share from the labels. What is
not target is text with something that the target hardly has, so the rest departs from the target by the features that raw
text has more often, and a document is not rejected for lacking what the target has. The importance weight of a text x is
p_target(x) / p_raw(x). Texts are sampled without replacement by Gumbel top-k on log weight / temperature; k is given, or
else the number of texts whose log weight is on the target's side of the cut that parts the labelled documents best. The
noise is a hash of id and text, so runs repeat; the k-th key is found by counting, not by sorting.

Edge cases: a null or empty text has the features of an empty text; texts with equal id and text share their noise and
their fate, unless they are the last ones (then as many as are needed are dropped, none more); labels with nulls, or
for ids that no document has, teach nothing; without labels of the target or of any reject everything is kept; rows
with null ids are judged by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, as_bytes, free_name, ship, stash
from textloom.llm.substrings import running, spans_hash

#: Features are hashed into a space of their own for each kind: words, beginnings of words, pairs of words, shape.
SPACES = (1 << 19, 1 << 17, 1 << 15, 1 << 12)
BUCKETS = sum(SPACES)
#: Labelled documents that teach the models, at most; the ones with the smallest hash of their id.
LABELLED = 40_000
#: Before the counts: the odds that the target has a feature more rarely than raw text, and the gamma distribution (shape,
#: rate) of the factor if so.
RARER, SHAPE, RATE = 3e-3, 0.25, 1.0
TEMPERATURE = 0.25

#: Bytes as features see them: digits are 0, ASCII signs are spaces; and all but capitals, all but odd signs.
FLAT = bytes(48 if 48 <= b <= 57 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_ODD = bytes(b for b in range(256) if b not in b"!|%&#$*~^<>{}[]\\/=+@_")


def pieces_of(flat: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about ``most`` bytes, cut at spaces; a longer word stays whole."""
    at = 0
    while at < len(flat):
        cut = flat.find(b" ", at + most)
        cut = len(flat) if cut < 0 else cut
        yield flat[at:cut]
        at = cut


def word_buckets(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words between spaces and of their first five bytes: hashes of stretches of bytes, by differences of
    running sums, for all words at once."""
    words, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for piece in pieces_of(flat):
        a = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(a) + 2, bool)
        inside[1:-1] = a != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        sums = running(a)
        words.append((spans_hash(sums, begin, end) & np.uint64(SPACES[0] - 1)).view(np.int64))
        starts.append((spans_hash(sums, begin, np.minimum(begin + 5, end)) & np.uint64(SPACES[1] - 1)).view(np.int64))
    return np.concatenate(words), np.concatenate(starts)


def features(text: bytes | None) -> np.ndarray:
    """The buckets of a text, some repeated."""
    raw = text or b""
    words, starts = word_buckets(raw.lower().translate(FLAT))
    n = len(words)
    pairs = (words[:-1] * 0x9E3779B1 + words[1:] * 0x85EBCA77 >> 11) & SPACES[2] - 1
    most = max([int((words[p:] == words[:-p]).sum()) for p in range(1, 9) if n > p], default=0)
    different = len(np.unique(words))
    capitals, odd = len(raw.translate(None, NOT_CAPITAL)), len(raw.translate(None, NOT_ODD))
    # at least so many tenths of capitals, quarters of odd signs a word, sixteenths of repetitions; at most so many tenths of
    # different words, by size: each has numbers of its own
    up = lambda base, value, most: base + np.arange(min(value, most) + 1)
    shares = [up(0, 10 * capitals // max(len(raw), 1), 10), up(20, 4 * odd // max(n, 1), 12), up(40, 16 * most // max(n, 1), 16), up(64 + 100 * n.bit_length(), 10 - 10 * different // max(n, 1), 10)]
    shape = np.minimum(np.concatenate(shares), SPACES[3] - 1)
    return np.concatenate([words, starts + SPACES[0], pairs + sum(SPACES[:2]), shape + sum(SPACES[:3])])


def known_labels(labels: DataFrame, most: int) -> DataFrame:
    """Rows (__id, kind) of at most ``most`` labelled documents, the ones with the smallest hash of their id: kind 0 is the
    target, 1 the rest. Repeated labels of an id count once, rejects first."""
    kind = F.expr("case when quality = 0 or toxic = 1 then 1 when quality = 1 and toxic = 0 then 0 end")
    known = labels.select(F.col("doc_id").alias("__id"), kind.alias("kind")).where("kind is not null and __id is not null")
    return known.groupBy("__id").agg(F.max("kind").alias("kind")).orderBy(F.xxhash64("__id"), "__id").limit(most)


def labelled(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (text, kind) for every document; kind is -1 where there is no label. The labels kept are few and so are broadcast."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "__id", "left")
    return rows.select("text", F.coalesce("kind", F.lit(-1)).alias("kind"))


def counted(texts: DataFrame) -> DataFrame:
    """Document counts of the buckets by kind, over all rows of (text, kind): rows (kind, bucket, n); bucket -1 counts the
    documents. A task adds up all it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for text, kind in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = counts.setdefault(kind, np.zeros(BUCKETS + 1, np.int64))
                own[features(text)] += 1
                own[BUCKETS] += 1
        for kind, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(own[at])], ["kind", "bucket", "n"])

    ship(texts.sparkSession)
    found = texts.select(F.col("text").cast("string").alias("text"), F.col("kind").cast("int").alias("kind")).mapInArrow(run, "kind int, bucket int, n long")
    return found


class Model:
    """By bucket, how much more often raw text has it than the target, as a log; the same for a text that is itself one of
    the target's, as if it had not been counted there; and the target's share of raw text."""

    def __init__(self, share: float, logs: np.ndarray, without: np.ndarray):
        self.use = 0 < share < 1
        self.share, self.logs = share, np.stack([logs, without], axis=1).astype(np.float32)

    def log_weights(self, found: np.ndarray) -> np.ndarray:
        """The log weight of a text, and what it is if the target were counted without it."""
        rest = self.logs[np.unique(found)].sum(axis=0, dtype=np.float64)
        return -np.logaddexp(math.log(self.share), math.log1p(-self.share) + rest)


def expected_logs(seen: np.ndarray, expected: np.ndarray, rest: np.ndarray, rest_expected: np.ndarray, share: float) -> np.ndarray:
    """The log of how many times rarer the target has a feature than raw text, after it was seen in so many documents of the
    target, and of the rest, where raw text lets so many be expected. What the target lacks, the rest has the more often."""
    shape = seen + SHAPE
    gamma = np.fromiter(map(math.lgamma, shape), float, len(shape))
    odds = math.log(RARER) + gamma - math.lgamma(SHAPE) + SHAPE * math.log(RATE) - shape * np.log(RATE + expected) + expected
    odds += rest * -math.log1p(-share) - rest_expected * share / (1 - share)
    rarer = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return rarer * np.maximum(0, np.log((expected + RATE) / shape))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> Model:
    """The models, from one pass over all documents. The driver gets one count a bucket, whose number is fixed."""
    found = counted(labelled(docs, known_labels(labels, most), id_col, text_col))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    wide = found.groupBy("bucket").agg(F.sum("n").alias("raw"), of(0).alias("target"), of(1).alias("rest")).toArrow()
    bucket, raw, target, rest = (wide.column(c).to_numpy() for c in ("bucket", "raw", "target", "rest"))
    logs, whole = np.zeros(BUCKETS), bucket < 0
    if not whole.any():
        return Model(0.0, logs, logs)
    n_raw, n_target, n_rest = (int(c[whole][0]) for c in (raw, target, rest))
    share = n_target / (n_target + n_rest) if n_target + n_rest else 0.0
    if not 0 < share < 1:
        return Model(share, logs, logs)
    without, bucket, rate, seen, other = np.zeros(BUCKETS), bucket[~whole], raw[~whole] / n_raw, target[~whole].astype(float), rest[~whole]
    logs[bucket] = expected_logs(seen, n_target * rate, other, n_rest * rate, share)
    without[bucket] = expected_logs(np.maximum(seen - 1, 0), max(n_target - 1, 0) * rate, other, n_rest * rate, share)
    return Model(share, logs, without)


def best_cut(weights: np.ndarray, kinds: np.ndarray) -> float:
    """The lowest weight to keep, so that most labelled documents are on their side."""
    order = np.argsort(-weights, kind="stable")
    weights, good = weights[order], kinds[order] == 0
    right = np.cumsum(good) + (~good).sum() - np.cumsum(~good)
    ends = np.append(weights[1:] < weights[:-1], True)
    at = np.flatnonzero(ends)
    best = at[len(at) - 1 - np.argmax(right[at][::-1])]  # of equals the one that keeps most
    return float(weights[best])


def weighed(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, the log weight and the one without the text itself, and their names."""
    name, other, at, schema = free_name(docs, "log_weight"), free_name(docs, "log_weight_without"), docs.columns.index(text_col), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(schema) + 2)]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found = np.array([model.log_weights(features(t)) if model.use else (0.0, 0.0) for t in as_bytes(b.column(at).cast(pa.string()))], float).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(found[:, 0]), pa.array(found[:, 1])], names)

    types = [f.dataType.simpleString() for f in schema] + ["double", "double"]
    found = arrow_map(docs.toDF(*names[:-2]), batch, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    return found.toDF(*docs.columns, name, other), name, other


def gumbel_key(weight: str, *identity: Column, temperature: float = TEMPERATURE, seed: int = 0) -> Column:
    """Log weight over temperature plus a standard Gumbel number made of a hash of ``identity``."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.col(weight) / F.lit(temperature) - F.log(-F.log(unit))


def top_k(rows: DataFrame, key: str, k: int, bins: int = 4096) -> DataFrame:
    """The ``k`` rows with the largest ``key`` (all, if fewer). The k-th key is narrowed down by counting in equal
    bins; of rows that tie with it, as many as are needed are taken. ``rows`` is read again and again: a written table."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if k >= n or n == 0:
        return rows
    if k <= 0:
        return rows.limit(0)
    need = k
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        counts = dict(rows.where(F.col(key).between(low, high)).groupBy(at.alias("b")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))).collect())
        for b in sorted(counts, reverse=True):
            if counts[b]["n"] >= need:
                if (counts[b]["low"], counts[b]["high"]) == (low, high) and len(counts) == 1:
                    width = 0
                low, high = counts[b]["low"], counts[b]["high"]
                if counts[b]["n"] == need:
                    return rows.where(F.col(key) >= low)
                break
            need -= counts[b]["n"]
        if width == 0:
            break
    if low == high:
        return rows.where(F.col(key) > low).unionByName(rows.where(F.col(key) == low).limit(need))
    above = rows.where(F.col(key) > high)
    return above.unionByName(rows.where(F.col(key).between(low, high)).orderBy(F.col(key).desc()).limit(need))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, temperature: float = TEMPERATURE, keep_columns: bool = True, most: int = LABELLED) -> tuple[DataFrame, str]:
    """The sampled rows of ``docs`` with their log weight, and the name of that column; without ``keep_columns`` only the id and the weight."""
    model = fit(docs, labels, id_col, text_col, most)
    rows, weight, without = weighed(docs if keep_columns else docs.select(id_col, text_col), model, text_col)
    key = free_name(rows, "gumbel")
    rows = rows.withColumn(key, gumbel_key(weight, F.col(id_col), F.col(text_col), temperature=temperature))
    rows = stash(rows if keep_columns else rows.select(id_col, weight, without, key), "weighed")
    if not model.use:
        return rows.drop(key, without), weight
    if k is None:
        own = rows.select(F.col(id_col).alias("__id"), F.col(weight).alias("w"), F.col(without).alias("v")).groupBy("__id").agg(F.min("w").alias("w"), F.min("v").alias("v"))
        taught = own.join(F.broadcast(known_labels(labels, most)), "__id").select(F.when(F.col("kind") == 0, F.col("v")).otherwise(F.col("w")).alias("w"), "kind").toArrow()  # at most ``most`` rows
        cut = best_cut(taught.column("w").to_numpy(), taught.column("kind").to_numpy())
        k = rows.where(F.col(weight) >= cut).count()
    return top_k(rows, key, k).drop(key, without), weight
