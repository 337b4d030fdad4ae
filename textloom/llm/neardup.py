"""Near-duplicate documents by SimHash fingerprints, multi-index hashing and exact similarity.

Two texts are near-duplicates when the Jaccard similarity of their sets of five-word shingles is 0.8 or more. A pair at
0.8 differs in 15 of 100 bits of its fingerprints, so a ball of two bits in 64, as in ``simhash``, finds close to none of them.
Fingerprints have 384 bits here, the majority of the hash bits of a text's shingles, and are cut into twelve segments of
32 bits. Every text is stored under its twelve segments and looks up a ball around each of them. Which bits of a near copy
differ is no accident: those whose majority was narrow. So the ball is not one of a radius: it holds the 2048 values that
are the likeliest by how narrow each majority was. Either text of a pair may find the other; a pair at 0.8 is missed once
in 10,000 times (from the simulated rate of one segment), closer ones less often. What is found is verified by the complete distance, at most
``RADIUS`` bits, and then by the shingles.

Lookups are thinned out by a map of all stored segments before they leave the worker; where the table is large, some of the
segments are done at a time. Texts in a crowd (a segment that more than ``SMALL`` share, or more than ``MANY`` hits a segment beyond chance) do not look each other up: all pairs of them are compared by their rarest shingles, as in ``substrings``, which loses none.
They look up the texts outside of crowds like all others, and are looked up by them.
What links them before that is one link at most for each of their keys, to the text that leads it, so that those already of one class need not be compared.

Words are runs of other than ASCII white space, in lower case (A-Z). Edge cases: a text of fewer than five words is one
shingle; texts without words (null, empty, white space) are equal; rows with a null id are compared like any other.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, free_name, ship, sliced, sole_cache, stash
from textloom.llm.substrings import HASHES, MAP_BITS, SIMILAR, SMALL, bit_map, classes, line_shingles, mixed, running, spans_hash, texts_of, whole_text, word_hashes

WIDTH, SEGMENTS, PROBES = 32, 12, 2048
BITS, WORDS = WIDTH * SEGMENTS, WIDTH * SEGMENTS // 64
#: Bits that may differ in all, and in the one word of 64 that is compared at once: far above the 15 of 100 at 0.8.
RADIUS, NEAR = 115, 24
#: Hits a segment beyond chance that make a text one of a crowd.
MANY = 4
#: Places of a segment in the map.
PLACES = 4
SALTS = np.random.default_rng(13).integers(1, 1 << 63, WORDS, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Texts that a worker looks up at once.
CHUNK = 32


def likeliest(width: int = WIDTH, n: int = PROBES + 1, shared: float = 2 * SIMILAR / (1 + SIMILAR)) -> list[tuple[int, ...]]:
    """The ``n`` sets of bits that are the likeliest to differ in a near copy, by their ranks from the narrowest majority on,
    where the sums of two texts correlate by ``shared``. The first is the empty one."""
    normal = NormalDist()
    narrow = [normal.inv_cdf(0.5 + (j + 0.5) / (2 * width)) for j in range(width)]
    flips = [normal.cdf(-x * shared / math.sqrt(1 - shared * shared)) for x in narrow]
    cost = [math.log((1 - p) / p) for p in flips]
    heap, out = [(cost[0], (0,))], [()]
    while len(out) < n:
        c, s = heapq.heappop(heap)
        out.append(s)
        j = s[-1] + 1
        if j < width:
            heapq.heappush(heap, (c + cost[j], (*s, j)))
            heapq.heappush(heap, (c - cost[j - 1] + cost[j], (*s[:-1], j)))
    return out


def steps() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the sets of each size: where they are, where the same without the last rank is (always before), and that rank."""
    sets = likeliest()
    at = {s: i for i, s in enumerate(sets)}
    sizes = sorted({len(s) for s in sets[1:]})
    return [tuple(np.array(x) for x in zip(*((i, at[s[:-1]], s[-1]) for s, i in at.items() if len(s) == k), strict=True)) for k in sizes]


STEPS = steps()


def majorities(shingles: np.ndarray) -> np.ndarray:
    """How far the ones outweigh the zeros in each bit over a set of shingle hashes, in 40ths of a standard deviation, at
    most 127; zero only where they are even."""
    n, total = len(shingles), np.zeros(BITS, np.int64)
    for k in range(0, n, 255):
        hashes = mixed(shingles[k : k + 255, None] + SALTS)
        total += np.add.reduce(np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    lead = 2 * total - n
    return (np.sign(lead) * np.minimum(np.ceil(np.abs(lead) * (40 / math.sqrt(n))), 127)).astype(np.int8)


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes | None]]:
    """Content hashes of texts, and the majorities of the bits of those that have words."""
    words, ends = [], []
    for text in texts:
        words += (text or b"").lower().split()
        ends.append(len(words))
    sums, end = running(word_hashes(words)), np.array(ends, np.int64)
    begin = np.concatenate((np.zeros(1, np.int64), end[:-1]))
    some, prints = end > begin, [None] * len(texts)
    if some.any():
        grams, first = line_shingles(sums, begin[some], end[some])
        for i, own in zip(np.flatnonzero(some).tolist(), np.split(grams, first[1:]), strict=True):
            prints[i] = majorities(np.unique(own)).tobytes()
    return spans_hash(sums, begin, end).view(np.int64), prints


def read(column: pa.Array) -> np.ndarray:
    """The majorities in a column of them: a row a text."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, BITS)


def fingerprints(lead: np.ndarray) -> np.ndarray:
    """The bits where ones outweigh zeros, in words of 64."""
    return np.packbits(lead > 0, axis=1, bitorder="little").view(np.uint64)


def keys(values: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """A number for each value of a segment, the last axis being the segments; no two have the same."""
    return ((values.astype(np.uint64) | segments.astype(np.uint64) << np.uint64(32)) * ODD).view(np.int64)


def balls(lead: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """The likeliest values of segments in near copies of texts, by value (the first is the text's own), text and segment."""
    lead = lead.reshape(len(lead), SEGMENTS, WIDTH)[:, segments].reshape(-1, WIDTH)
    values = np.packbits(lead > 0, axis=1, bitorder="little").view(np.uint32).ravel()
    bits = np.ascontiguousarray((np.uint32(1) << np.argsort(np.abs(lead), axis=1, kind="stable").astype(np.uint32)).T)
    out = np.empty((PROBES + 1, len(values)), np.uint32)
    out[0] = values
    for here, before, rank in STEPS:
        out[here] = out[before] ^ bits[rank]
    return out.reshape(PROBES + 1, -1, len(segments))


def slots(key: str) -> str:
    """SQL for the places of a key in the map."""
    one, step = f"shiftrightunsigned({key}, 37)", f"(shiftrightunsigned({key}, 10) & {MAP_BITS - 1})"
    return f"explode(array({', '.join(f'({one} + {i} * {step}) & {MAP_BITS - 1}' for i in range(PLACES))})) as slot"


def segment_map(rows: DataFrame) -> np.ndarray:
    """The places of the keys of ``rows``, as ``within`` reads them."""
    bits = bit_map(rows.selectExpr(slots("key")), "slot")
    bits[4095] |= (bits[0] & 1) << 7  # the built-in functions put place 0 apart; here it goes before place 1
    return bits


def within(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys may be in a map, by their places in the flat array."""
    flat, at = found.reshape(-1).view(np.uint64), None
    for i in range(PLACES):
        key = flat if at is None else flat[at]
        slot = (key >> np.uint64(37)).view(np.int64)
        if i:
            slot = (slot + i * ((key >> np.uint64(10)).view(np.int64) & (MAP_BITS - 1))) & (MAP_BITS - 1)
        slot = slot + 32767
        hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).view(bool))
        at = hit if at is None else at[hit]
    return at


#: A text under the key of a segment, with a word of its fingerprint that the segment is no part of.
ROW = "content long, key long, word long"


def stored(prints: DataFrame) -> DataFrame:
    """Texts under their own segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = np.arange(SEGMENTS)
        for b in batches:
            words = fingerprints(read(b.column(1)))
            own = keys(words.view(np.uint32), segments)
            other = np.repeat(np.roll(words, -1, axis=1), 2, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), SEGMENTS)), pa.array(own.ravel()), pa.array(other.view(np.int64).ravel()), pa.array(np.tile(segments.astype(np.int32), len(words)))], ["content", "key", "word", "segment"])

    return prints.select("content", "lead").mapInArrow(run, f"{ROW}, segment int")


def looked_up(prints: DataFrame, segments: np.ndarray, bits, crowded=None, most: float = math.inf) -> DataFrame:
    """Texts under those values of their balls that may be stored by the map ``bits``; those that touch a
    ``crowded`` segment or have more than ``most`` hits only under the nearest of both in each segment, and under a null key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                b = batch.slice(k, CHUNK)
                lead = read(b.column(1))
                ball = keys(balls(lead, segments), segments)
                text_of = lambda at: at // len(segments) % len(lead)  # noqa: B023, E731
                nearest = lambda at: at[np.unique(at % ball[0].size, return_index=True)[1]]  # noqa: B023, E731
                crowd, touched = np.zeros(len(lead), bool), np.empty(0, np.int64)
                if crowded is not None:
                    touched = nearest(within(ball[1:], crowded.value))
                    crowd[text_of(within(ball, crowded.value))] = True
                at = within(ball[1:], bits.value)  # its own value is stored already
                crowd |= np.bincount(text_of(at), minlength=len(lead)) > most
                inside = crowd[text_of(at)]
                at = np.concatenate((at[~inside], nearest(at[inside]), touched))
                content, text = b.column(0).to_numpy(), text_of(at)
                word = np.roll(fingerprints(lead), -1, axis=1)[text, segments[at % len(segments)] // 2].view(np.int64)
                empty = np.zeros(crowd.sum(), np.int64)
                key = pa.array(np.concatenate((ball[1:].reshape(-1)[at], empty)), mask=np.concatenate((np.zeros(len(at), bool), empty == 0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((content[text], content[crowd]))), key, pa.array(np.concatenate((word, empty)))], ["content", "key", "word"])

    return prints.select("content", "lead").mapInArrow(run, ROW)


def candidates(prints: DataFrame, small: int = SMALL, many: int = MANY, map_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts that find each other and whose fingerprints differ in at most ``RADIUS`` bits, and the texts
    (content) in crowds, of which all pairs are still to be compared, from distinct rows (content, lead)."""
    context, index, n = prints.sparkSession.sparkContext, stash(stored(prints), "segments"), prints.count()
    crowded = stash(index.groupBy("key").count().where(F.col("count") > small).select("key"), "crowded")
    mapped = lambda rows: context.broadcast(segment_map(rows))
    at_once = min(SEGMENTS, max(1, map_bits // (16 * max(n, 1))))
    parts = [np.arange(k, min(k + at_once, SEGMENTS)) for k in range(0, SEGMENTS, at_once)]

    def found(who: DataFrame, where: DataFrame, crowds=None) -> DataFrame:
        out = []
        for part in parts:
            bits = mapped(where.where(F.col("segment").between(int(part[0]), int(part[-1]))))
            chance = PROBES * len(part) * (n / (1 << WIDTH) + (1 - math.exp(-PLACES * n * len(part) / MAP_BITS)) ** PLACES)
            out.append(stash(looked_up(who, part, bits, crowds, many * len(part) + 2 * chance if crowds else math.inf), "lookups"))
            bits.destroy()
        return functools.reduce(DataFrame.unionByName, out)

    crowds = mapped(crowded)
    rows = found(prints, index, crowds)
    crowds.destroy()
    plain = index.drop("segment")
    hot = stash(rows.where("key is null").unionByName(plain.join(crowded, "key", "left_semi")).select("content").distinct(), "hot")
    rows, crowd = rows.where("key is not null"), lambda rows, is_one: rows.select(*rows.columns, F.lit(is_one).alias("crowd"))
    if hot.isEmpty():
        links, rows, plain = None, crowd(rows, False), crowd(plain, False)
    else:
        links = leader_links(rows.unionByName(plain).join(hot, "content", "left_semi"))
        late = found(prints.join(hot, "content", "left_semi"), index.join(hot, "content", "left_anti"))
        rows = crowd(rows.join(hot, "content", "left_anti"), False).unionByName(crowd(late, True))
        plain = plain.join(crowded, "key", "left_anti").join(crowd(hot, True), "content", "left").fillna(False, "crowd")
        plain = stash(plain.select(rows.columns), "plain")
    near = F.expr(f"p.content <> t.content and not (p.crowd and t.crowd) and bit_count(p.word ^ t.word) <= {NEAR}")
    pairs = rows.unionByName(plain).alias("p").join(plain.alias("t"), "key").where(near).selectExpr("p.content as a", "t.content as b")
    pairs = pairs if links is None else pairs.unionByName(links)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    words = whole_prints(prints)
    left, right = words.withColumnsRenamed({"content": "a", "words": "x"}), words.withColumnsRenamed({"content": "b", "words": "y"})
    differ = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(WORDS))
    return stash(pairs.join(left, "a").join(right, "b").where(f"{differ} <= {RADIUS}").select("a", "b"), "pairs"), hot


def leader_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of texts to the one that leads a key of theirs, the smallest hash for it: one a row at most, so they
    grow with the texts and not with their pairs."""
    lead = F.min(F.struct(F.xxhash64("content", "key").alias("h"), "content", "word")).alias("t")
    shared = rows.groupBy("key").agg(lead, F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("key", "t")
    near = F.expr(f"p.content <> t.content and bit_count(p.word ^ t.word) <= {NEAR}")
    return rows.alias("p").join(shared, "key").where(near).selectExpr("p.content as a", "t.content as b")


def whole_prints(prints: DataFrame) -> DataFrame:
    """Rows (content, words) of the complete fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = fingerprints(read(b.column(1))).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * WORDS), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["content", "words"])

    return prints.select("content", "lead").mapInArrow(run, "content long, words array<long>")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: one with the smallest id, of rows with that id and
    text any one. A null id comes after all others."""
    name, at, schema = free_name(docs, "content"), docs.columns.index(text_col), docs.schema
    lead = free_name(docs, "lead")
    names = [f"c{i}" for i in range(len(schema) + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(HASHES)
        for batch in batches:
            for b in sliced(batch, names[at], 2 << 20):
                content, prints = hashed(as_bytes(b.column(at).cast(pa.string())))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content), pa.array(prints, pa.binary())], names)

    ship(docs.sparkSession)
    types = [f.dataType.simpleString() for f in schema] + ["long", "binary"]
    made = docs.toDF(*names[:-2]).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    rows = stash(made.toDF(*docs.columns, name, lead), "near")
    prints = stash(rows.where(F.col(lead).isNotNull()).select(F.col(name).alias("content"), F.col(lead).alias("lead")).distinct(), "prints")
    pairs, hot = candidates(prints)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("content")).unionByName(hot).distinct()
    roots = classes(texts_of(wanted, rows, text_col, whole_text), pairs, hot, least)
    ids = rows.select(F.col(name).alias("content"), F.col(id_col).alias("id"))
    distinct = ids.groupBy("content").agg(F.min("id").alias("first"))
    named = distinct.join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("content"))).alias("best"))
    chosen = chosen.select(F.col("best.content").alias("__content"), F.coalesce(F.col("best.first").cast("string"), F.lit("")).alias("__key"))
    key = free_name(rows, "id_key")
    rows = rows.drop(lead).withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = rows.join(chosen, (F.col(name) == F.col("__content")) & (F.col(key) == F.col("__key")), "left_semi")
    return kept.dropDuplicates([name, key]).drop(name, key)
