"""Vector best-fit packing of tokenized documents into sequences of bounded size.

A sequence has three capacities: tokens, documents and attention cost (the sum of the squared lengths of what it
holds). A piece is placed where it fits under every one of them; among such sequences the one whose residual
capacities, weighted, lie best along the piece's demands is taken (largest dot product over the norm of the residual),
or the one that it leaves with the smallest residual norm. Pieces are placed longest first.

Pieces of equal length are alike, and so are sequences of equal residuals. So the driver packs a histogram: at most as
many lengths as a sequence has tokens, with their counts, against classes of sequences with their counts. Its work and
memory depend on the sequence length, not on the corpus. Pieces then find their sequence by their number within
their length, which is counted in cells, so that no task sorts all pieces of a length.

Edge cases: a null text is empty; an empty text is the separator alone; a text longer than a sequence is cut into whole
sequences and a rest; repeated ids are packed each on its own; an empty table gives an empty result. Columns besides
id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import gapless, ship, sliced, sole_cache, stash
from textloom.llm.wordbpe import WordBpe

CELLS = 64


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how much each of the three counts when sequences are compared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048**2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.documents, self.attention


def demand(length: int) -> tuple[int, int, int]:
    return length, 1, length * length


def best_fit(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Pack counts of pieces by length. Rows (length, first number, count, first sequence, offset): the pieces of that
    length with these numbers are at this offset of sequences of consecutive numbers.

    Sequences of equal residuals are one class with a count. A chosen sequence takes as many pieces of a length as it
    can, as it stays the best fit for the next; all sequences of its class that are filled alike are filled at once.
    """
    limits, total = capacity.limits(), 0
    weights = np.array(capacity.weights) / np.array(limits, float)
    have = np.full((64, 3), -1, np.int64)  # residuals by class; a class without sequences can take nothing
    runs: list[list[tuple[int, int]]] = []  # of each class: first sequence, count
    classes: dict[tuple[int, ...], int] = {}
    plan: list[tuple[int, int, int, int, int]] = []

    def add(residual: tuple[int, ...], first: int, count: int) -> None:
        nonlocal have
        if not count or not all(residual):
            return
        k = classes.setdefault(residual, len(runs))
        if k == len(runs):
            runs.append([])
            if k == len(have):
                have = np.concatenate([have, np.full_like(have, -1)])
        runs[k].append((first, count))
        have[k] = residual

    for length in sorted(histogram, reverse=True):
        left, number, need = histogram[length], 0, demand(length)
        if any(n > most for n, most in zip(need, limits, strict=True)):
            raise ValueError(f"a piece of {length} tokens is beyond a sequence's capacity")
        while left:
            fits = np.flatnonzero((have[: len(runs)] >= need).all(1))
            if len(fits):
                if capacity.rule == "dot":
                    scaled = have[fits] * weights
                    score = -(scaled @ (np.array(need) * weights)) / np.maximum(np.linalg.norm(scaled, axis=1), 1e-300)
                else:
                    score = np.linalg.norm((have[fits] - need) * weights, axis=1)
                k = int(fits[np.argmin(score)])
                residual = tuple(have[k].tolist())
                first, count = runs[k].pop()
                if not runs[k]:
                    have[k] = -1
            else:
                residual, first, count = limits, total, left
            each = min(r // n for n, r in zip(need, residual, strict=True))
            many, each = (min(count, left // each), each) if left >= each else (1, left)
            for j in range(each):
                plan.append((length, number + j * many, many, first, limits[0] - residual[0] + j * length))
            number, left = number + each * many, left - each * many
            if len(fits):
                add(residual, first + many, count - many)
            else:
                total += many
            add(tuple(r - each * n for n, r in zip(need, residual, strict=True)), first, many)
    return plan


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, separator: int = 0) -> DataFrame:
    """A row (id, piece, start, length, ids) for each piece of each document; ids: little-endian unsigned 32-bit numbers."""
    mark = separator.to_bytes(4, "little")

    def cut(b: pa.RecordBatch, encode: WordBpe) -> pa.RecordBatch:
        rows, piece, start, length, ids = [], [], [], [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            found = encode(text or "") + mark
            n = len(found) // 4
            for j, s in enumerate(range(0, n, tokens)):
                rows.append(k)
                piece.append(j)
                start.append(s)
                length.append(min(tokens, n - s))
                ids.append(found[4 * s : 4 * (s + tokens)])
        columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordBpe.shared(tokenizer)
        sole_cache(encode.words)
        for b in batches:
            for part in sliced(b, "text", 2 << 20):
                yield cut(part, encode)

    ship(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")


def pack(found: DataFrame, capacity: Capacity = Capacity(), order: tuple[str, ...] = ("id", "piece", "start")) -> DataFrame:
    """``found`` (with a column ``length``) with ``sequence`` and ``offset`` added.

    ``found`` is read twice, so it should be a written table. ``order`` makes the result the same in every run.
    """
    spark = found.sparkSession
    histogram = dict(found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each length up to a sequence's
    plan = spark.createDataFrame(best_fit(histogram, capacity), "length long, first long, many long, sequence0 long, offset long")
    runs = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "many", "sequence0", "offset"))).alias("runs"))
    cells = max(CELLS, sum(histogram.values()) >> 20)  # so that one of them holds about a million pieces at most
    celled = found.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    numbered = gapless(celled, ["length"], "__cell", [F.col(c).asc_nulls_first() for c in order], "__number").drop("__cell")
    # the run that holds a number: bisection over the runs of its length
    numbered = numbered.join(F.broadcast(runs), "length") if len(histogram) <= BROADCAST_LENGTHS else numbered.join(runs, "length")
    run = """element_at(runs, aggregate(sequence(1, 32), struct(1 as lo, size(runs) as hi),
        (a, _) -> if(a.lo >= a.hi, a, if(runs[cast((a.lo + a.hi + 1) div 2 as int) - 1].first <= __number,
            struct(cast((a.lo + a.hi + 1) div 2 as int) as lo, a.hi as hi), struct(a.lo as lo, cast((a.lo + a.hi + 1) div 2 as int) - 1 as hi))), a -> a.lo))"""
    return numbered.withColumn("__run", F.expr(run)).withColumn("sequence", F.expr("__run.sequence0 + __number - __run.first")).withColumn("offset", F.expr("__run.offset")).drop("runs", "__run", "__number")


#: The table of lengths is broadcast up to so many rows, with a few runs each.
BROADCAST_LENGTHS = 1 << 16


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), digest: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids, sequence, offset); with ``digest`` the CRC-32 of the ids instead of the ids."""
    found = pieces(docs, tokenizer, id_col, text_col, capacity.tokens)
    if digest:
        found = found.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stash(found, "pieces"), capacity)


def sequences(found: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence, ids, members), ids joined in order of the offsets. A sequence holds
    a bounded number of tokens, so the list of its members is bounded too."""
    member = F.struct("offset", "id", "piece", "start", "length", "ids")
    lists = found.groupBy("sequence").agg(F.array_sort(F.collect_list(member)).alias("members"))
    joined = F.expr("aggregate(members, cast('' as binary), (a, m) -> concat(a, m.ids))")
    return lists.select("sequence", joined.alias("ids"), F.transform("members", lambda m: m.dropFields("ids")).alias("members"))


def waste(plan: list[tuple[int, int, int, int, int]], tokens: int) -> tuple[int, int]:
    """Sequences of a plan, and the fewest that any plan could have by its tokens."""
    fill: dict[int, int] = defaultdict(int)
    for length, _, many, _, _ in plan:
        fill[0] += length * many
    return max((first + many for _, _, many, first, _ in plan), default=0), -(-fill[0] // tokens)
