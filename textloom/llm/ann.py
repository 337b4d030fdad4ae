"""Approximate nearest neighbours by cosine with learned partitions.

On a bounded sample of the vectors (``SAMPLE``) the graph of nearest neighbours is built and cut into parts of equal
size: first by repeated halving along the direction of largest spread, then by moving vectors to the part where most of
their neighbours are while parts stay balanced. A small network learns to predict in which parts a vector's neighbours
lie. Every vector of the table goes to its most probable part; a query goes to its several most probable ones, as many
as reach ``RECALL`` on held-out vectors of the sample, and at least as many as hold ``k`` other vectors. There it is
compared exactly, in double precision.

The vectors of a part are dealt into blocks and so are the queries that visit it; each pair of blocks is one small
matrix product. So no task holds a part, however large or crowded it is.

Edge cases: vectors that are null, zero, hold null or non-finite components, have a null id or another number of
components than most of the sample take no part; rows with the query's own id are not candidates; rows that share
an id are one query and one candidate each, a candidate that ties with itself counting once; equal scores go by id;
with fewer than ``k`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, ship, stash

SAMPLE = 8192
HELD_OUT = 512
NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 40
RECALL = 0.98
BLOCK = 4096


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def nearest(queries: np.ndarray, base: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Places of the ``k`` rows of ``base`` with the largest product, in blocks; with ``own`` row i is not its own neighbour."""
    out = np.empty((len(queries), k), np.int64)
    for s in range(0, len(queries), 1024):
        score = queries[s : s + 1024] @ base.T
        if own:
            score[np.arange(len(score)), np.arange(s, s + len(score))] = -np.inf
        out[s : s + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size by halving along the first principal direction again and again."""
    label = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:
        for p in range(n):
            at = np.flatnonzero(label == p)
            own = x[at] - x[at].mean(axis=0)
            way = np.linalg.eigh(own.T @ own)[1][:, -1]
            order = np.argsort(own @ way, kind="stable")
            label[at[order[len(at) // 2 :]]] = p + n
        n *= 2
    return label


def refined(graph: np.ndarray, label: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Move rows to the part of most of their neighbours, best gains first, while no part outgrows its share by ``slack``."""
    most = int(np.ceil(slack * len(label) / parts))
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(label), parts))
        for column in graph.T:
            np.add.at(votes, (np.arange(len(label)), label[column]), 1)
            np.add.at(votes, (column, label), 1)
        gain = votes - votes[np.arange(len(label)), label][:, None]
        best = gain.argmax(axis=1)
        ahead = gain[np.arange(len(label)), best]
        moved = 0
        for i in np.argsort(-ahead, kind="stable"):
            if ahead[i] <= 0:
                break
            if size[best[i]] < most and best[i] != label[i]:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """One hidden layer; gives each vector the probability of every part. ``probes`` parts reach the recall aimed at."""

    weights: list[np.ndarray]
    parts: int
    width: int
    probes: int = 1

    def scores(self, unit: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.maximum(unit @ w + b, 0) @ v + c


def trained(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int) -> list[np.ndarray]:
    """Cross-entropy against the shares of neighbours in the parts, by Adam."""
    n, parts = target.shape
    weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, 256):
            at = order[s : s + 256]
            h = np.maximum(x[at] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[at]) / len(at)
            dh = (d @ weights[2].T) * (h > 0)
            step += 1
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return weights


def parts_for(rows: int) -> int:
    """About a part for every 4 * sqrt(rows) vectors, a power of two from 1 to 256."""
    return int(2 ** np.clip(np.round(np.log2(max(1.0, rows**0.5 / 4))), 0, 8))


def fit(sample: np.ndarray, rows: int, k: int = 5, recall: float = RECALL, seed: int = 3) -> Router:
    """A router from a sample of a table of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    unit = sample / norms(sample)[:, None]
    unit = unit[rng.permutation(len(unit))]
    held, base = unit[: min(HELD_OUT, len(unit) // 5)], unit[min(HELD_OUT, len(unit) // 5) :]
    parts = parts_for(rows) if len(base) > 4 * NEIGHBOURS else 1
    if parts == 1:
        return Router([np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, sample.shape[1])
    graph = nearest(base, base, NEIGHBOURS, own=True)
    label = refined(graph, halved(base, parts), parts)
    target = np.zeros((len(base), parts))
    np.add.at(target, (np.arange(len(base)), label), NEIGHBOURS / 2)
    for column in graph.T:
        np.add.at(target, (np.arange(len(base)), label[column]), 1)
    router = Router(trained(base, target / target.sum(axis=1, keepdims=True), rng, EPOCHS), parts, sample.shape[1])
    true = nearest(held, base, k)
    home = router.scores(base).argmax(axis=1)
    rank = (-router.scores(held)).argsort(axis=1, kind="stable").argsort(axis=1)
    needed = np.sort(rank[np.arange(len(held))[:, None], home[true]].ravel())
    router.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, vec) that can take part."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.expr("size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null").where(fine)


def search(vectors: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest of each query: rows (query_id, rank, id, score). ``queries`` is SQL over ``id`` that says which rows are queries."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    lengths = [len(r.vec) for r in drawn]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if drawn else 1
    rows = rows.where(F.size("vec") == width)
    total = rows.count()
    matrix = np.array([r.vec for r in drawn if len(r.vec) == width], float).reshape(-1, width)
    scale = np.abs(matrix).max(axis=1, keepdims=True) if len(matrix) else 1
    router = spark.sparkContext.broadcast(fit(matrix / scale, total, k, recall))

    def home(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rows_of(b.column(1), width)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        part = router.value.scores(x / norms(x)[:, None]).argmax(axis=1)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], ["id", "vec", "part"])

    base = stash(arrow_map(rows, home, "id long, vec array<double>, part int"), "partitions")
    sizes = dict(base.groupBy("part").count().collect())  # a row a part
    counts = spark.sparkContext.broadcast(np.array([sizes.get(p, 0) for p in range(router.value.parts)]))

    def route(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rows_of(b.column(1), width)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        order = (-router.value.scores(x / norms(x)[:, None])).argsort(axis=1, kind="stable")
        enough = (np.cumsum(counts.value[order], axis=1) <= k).sum(axis=1) + 1
        probes = np.minimum(np.maximum(router.value.probes, enough), router.value.parts)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[:n].tolist() for o, n in zip(order, probes.tolist(), strict=True)], pa.list_(pa.int32()))], ["id", "vec", "parts"])

    asked = arrow_map(base.where(queries).select("id", "vec"), route, "id long, vec array<double>, parts array<int>")
    asked = stash(asked.select("id", "vec", F.explode("parts").alias("part")), "routes")
    visits = dict(asked.groupBy("part").count().collect())
    blocks = [(p, -(-sizes[p] // block), -(-visits.get(p, 0) // block)) for p in sizes if visits.get(p)]
    plan = F.broadcast(spark.createDataFrame(blocks, "part int, n_base int, n_ask int"))  # a row a part
    salt = F.xxhash64("id", F.lit(17))
    left = base.join(plan, "part").select("part", F.pmod(salt, F.col("n_base")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n_ask") - 1)).alias("q"), F.lit(False).alias("asks"), "id", "vec")
    right = asked.join(plan, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("n_base") - 1)).alias("b"), F.pmod(salt, F.col("n_ask")).cast("int").alias("q"), F.lit(True).alias("asks"), "id", "vec")

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids = group.column("id").to_numpy()
        x = rows_of(group.column("vec").combine_chunks(), width)
        own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        scale = np.abs(x).max(axis=1, keepdims=True)
        unit = x / scale / norms(x / scale)[:, None]
        length = norms(x)
        q_ids, c_ids, scores = [], [], []
        for s in range(0, len(own), 256):
            at = own[s : s + 256]
            rough = unit[at] @ unit[others].T if len(others) else np.empty((len(at), 0))
            rough[ids[at][:, None] == ids[others][None, :]] = -np.inf
            for i, line in zip(at, rough, strict=True):
                least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                near = others[np.flatnonzero((line >= least - 1e-9) & (line > -np.inf))]
                exact = (x[near] * x[i]).sum(axis=1) / (length[near] * length[i])
                if not np.isfinite(exact).all():  # beyond the range of doubles: the same measure on scaled vectors
                    exact = (unit[near] * unit[i]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[:k]
                q_ids.append(np.full(len(best), ids[i]))
                c_ids.append(ids[near][best])
                scores.append(exact[best])
        join = lambda a, t: np.concatenate(a) if a else np.empty(0, t)
        return pa.table({"query_id": pa.array(join(q_ids, np.int64), pa.int64()), "id": pa.array(join(c_ids, np.int64), pa.int64()), "score": pa.array(join(scores, float), pa.float64())})

    pairs = left.unionByName(right).groupBy("part", "b", "q").applyInArrow(compare, "query_id long, id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
