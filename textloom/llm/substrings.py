"""Substring deduplication by paragraph MinHash banding.

Paragraphs are of two kinds. Natural ones are the lines of a document; lines of fewer than ``LEAST`` words are joined with
their neighbours of that kind up to a blank line, so text that is wrapped into short lines is a paragraph as well. Those
of at least ``shortest`` words count. Passages that are copied into other text need not begin or end at a line, so floating
paragraphs are cut as well: windows of ``LEAST`` words, in every stretch of ``STEP`` windows the one with the smallest
hash. Two texts that share ``LEAST + STEP - 1`` words in a row cut the same window out of them, wherever the words stand.

Natural paragraphs get MinHash signatures of their word shingles, banded for high recall: at the similarity of 0.8 a
pair shares one of the bands in 99.8 of 100 cases, and 4.9 of the 12 on average. Equal paragraphs are first brought
together, so comparisons are of different texts only, by exact Jaccard similarity of the shingles. All pairs of a small
band are compared. Paragraphs of a crowded band are compared with the one that leads it, and then, where links do not connect
them yet, by their rarest shingles: so many of each that similar ones share one, at places that leave room for the
similarity. So any similar pair that shares a band ends in one class. Floating windows are equal or not, so one hash is
their only band. Links are clustered by connected components; of each class the first paragraph stays (smallest document,
then place), the others are removals.

Words are runs of other than ASCII white space, in lower case. Edge cases: null and empty texts have no paragraphs;
paragraphs that repeat within one document only are no class of their own (the same document, by id); rows with a null
id are left out, as they could not be told apart; rows that share an id are one document, of which each row keeps its first
copy of a window; a very long text is one row like any other; of equal paragraphs at equal places all are kept or none; an
empty table gives an empty result. Columns besides id and text are not read, so their names do not matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import CACHES, as_bytes, components, ship, sliced, stash

SHINGLE = 5
SIMILAR = 0.8
LEAST = 40
STEP = 11
BANDS, ROWS = 12, 4
#: Bands of more members are compared with a leader first.
SMALL = 24
#: Comparisons for each row of rarest shingles that may be done at once; beyond that leaders thin the groups out, for so
#: many rounds at most before all that are left are done.
AT_ONCE, ROUNDS = 50, 4
#: Longs of a paragraph's mark: a bit for each shingle by its hash, which bounds what two paragraphs can share.
MARK = 8
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """XXH64 of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) >= 100_000:
            self.clear()
        self[word] = found
        return found


HASHES = Hashes()
CACHES.append(HASHES)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of a number modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            rest = np.full(2 * n - 1, self.base, np.uint64)
            self.known = np.concatenate((np.ones(1, np.uint64), np.cumprod(rest, dtype=np.uint64)))
        return self.known[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def running(words: np.ndarray) -> np.ndarray:
    """Sums from the first word up to each place, every word times a power of its place."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.multiply(words, UP(len(words)), out=out[1:], casting="unsafe")
    return np.cumsum(out, out=out)


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from each start to its end, by differences of running sums."""
    return mixed((sums[ends] - sums[starts]) * DOWN(len(sums))[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; of all words, if there are fewer."""
    starts = np.arange(max(1, len(words) - size + 1))
    return spans_hash(running(words), starts, np.minimum(starts + size, len(words)))


def windows(words: np.ndarray, least: int = LEAST, step: int = STEP) -> np.ndarray:
    """Starts of the floating paragraphs: the smallest hash (the last of equals) of each ``step`` windows in a row."""
    return floating(gram_hashes(words, least), step) if len(words) >= least else np.empty(0, np.int64)


def floating(grams: np.ndarray, step: int = STEP) -> np.ndarray:
    n = len(grams)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], min(step, n))
    found = np.zeros(n, bool)
    found[n - 1 - (np.arange(len(view)) + view.argmin(axis=1))] = True
    return np.flatnonzero(found)


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band hashes of sets of shingle hashes that lie one after the other, each from its start on: a row a set."""
    low = np.empty((len(SEEDS), len(starts)), np.uint64)
    for i, seed in enumerate(SEEDS):
        low[i] = np.minimum.reduceat(shingles * seed, starts)  # the hashes are well mixed, so a product permutes them well
    out = np.repeat(np.arange(BANDS, dtype=np.uint64) << np.uint64(32), len(starts)).reshape(BANDS, -1)  # keys of different bands differ
    for i in range(ROWS):
        out = mixed(out + low[i::ROWS] + np.uint64(i + 1))
    return out.T.view(np.int64)


def paragraphs(text: bytes, shortest: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of the word hashes of a text, and the starts and ends in words of its natural paragraphs."""
    words, sizes = [], []
    for line in text.lower().split(b"\n"):
        own = line.split()
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes)
    alone = (sizes >= LEAST) | (sizes == 0)
    first = np.ones(len(sizes), bool)
    first[1:] = alone[1:] | alone[:-1]
    starts = (np.cumsum(sizes) - sizes)[first]
    ends = np.append(starts[1:], len(words))
    fit = ends - starts >= max(shortest, 1)
    return running(word_hashes(words)), starts[fit], ends[fit]


def whole_text(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``paragraphs``, with all words of the text as its only paragraph."""
    words = text.lower().split()
    return running(word_hashes(words)), np.zeros(min(1, len(words)), np.int64), np.array([len(words)] if words else [], np.int64)


def line_shingles(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles within each paragraph, one paragraph after the other, and where each begins."""
    n = np.maximum(ends - starts - SHINGLE + 1, 1)
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    return spans_hash(sums, at, np.minimum(at + SHINGLE, np.repeat(ends, n))), first


KIND = "id long, start int, words int, floating boolean, again boolean, content long, bands array<long>"


def units(docs: DataFrame, id_col: str, text_col: str, shortest: int = SHINGLE) -> DataFrame:
    """The paragraphs: rows (id, start, words, floating, again, content, bands); start and words count words, content is a
    hash of the words; natural paragraphs have their band hashes, floating ones have none. ``again``: a floating one that
    the text has had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, "text", 4 << 20):
                yield cut(part)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        none = np.empty(0, np.int64)
        rows, starts, sizes, floats, again, content, bands = [none], [none], [none], [none.astype(bool)], [none.astype(bool)], [none], [np.empty((0, BANDS), np.int64)]
        for k, text in enumerate(as_bytes(b.column(1))):
            sums, begin, end = paragraphs(text or b"", shortest)
            if len(begin):
                shingles, first = line_shingles(sums, begin, end)
                starts.append(begin)
                sizes.append(end - begin)
                content.append(spans_hash(sums, begin, end).view(np.int64))
                bands.append(signatures(shingles, first))
            n = len(sums) - LEAST
            at = none
            if n > 0:
                every = np.arange(n)
                grams = spans_hash(sums, every, every + LEAST)
                at = floating(grams)
                starts.append(at)
                sizes.append(np.full(len(at), LEAST))
                content.append(grams[at].view(np.int64))
            repeated = np.ones(len(begin) + len(at), bool)
            repeated[: len(begin)] = False
            if n > 0:
                repeated[len(begin) + np.unique(content[-1], return_index=True)[1]] = False
            again.append(repeated)
            rows.append(np.full(len(begin) + len(at), k))
            floats.append(np.arange(len(begin) + len(at)) >= len(begin))
        join = np.concatenate
        is_float = join(floats)
        offsets = np.concatenate(([0], np.cumsum(np.where(is_float, 0, BANDS)))).astype(np.int32)
        columns = [
            b.column(0).take(pa.array(join(rows))),
            pa.array(join(starts).astype(np.int32)),
            pa.array(join(sizes).astype(np.int32)),
            pa.array(is_float),
            pa.array(join(again)),
            pa.array(join(content)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(bands).ravel())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "start", "words", "floating", "again", "content", "bands"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(run, KIND)


#: Bits of the map that thins rows out before a join: 16 MB, whatever the table's size.
MAP_BITS = 1 << 27


def bit_map(wanted: DataFrame, key: str) -> np.ndarray:
    """A bit for each key, by its low bits; of fixed size, so it can be broadcast. Where it fills up it lets more through,
    and the join that follows is exact in any case."""
    slot = f"({key} & {MAP_BITS - 1})"
    parts = wanted.selectExpr(f"{slot} as slot").groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = np.zeros(MAP_BITS // 8 + 4096, np.uint8)
    for number, bits in parts.collect():  # at most MAP_BITS / 32768 rows of 4 kB
        out[4096 * number : 4096 * (number + 1)] = np.frombuffer(bits, np.uint8)
    return out


def maybe(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    # buckets of the built-in functions are of 32768 numbers, the first from 1 to 32768, after one for 0 and less
    low = keys & (MAP_BITS - 1)
    at = np.where(low > 0, low - 1 + 32768, 0)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def thinned(rows: DataFrame, key: str, bits) -> DataFrame:
    """Rows whose key may be wanted."""
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe(b.column(at).to_numpy(), bits.value)))

    return rows.mapInArrow(run, rows.schema)


def band_rows(natural: DataFrame, bits=None) -> DataFrame:
    """Rows (content, key) of the bands of paragraphs (content, bands); with a map only those that may be shared."""
    if bits is None:
        return natural.select("content", F.explode("bands").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).flatten().to_numpy()
            at = np.flatnonzero(maybe(keys, bits.value))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at // BANDS)), pa.array(keys[at])], ["content", "key"])

    return natural.mapInArrow(run, "content long, key long")


def shingled(docs: DataFrame, text_col: str, bits, cut=paragraphs) -> DataFrame:
    """Rows (content, shingles, mark) of the natural paragraphs that may be wanted, shingles as a set of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, shingles, marks = [], [], []
            for text in as_bytes(b.column(0)):
                sums, begin, end = cut(text or b"")
                if not len(begin):
                    continue
                own = spans_hash(sums, begin, end).view(np.int64)
                hit = maybe(own, bits.value)
                if hit.any():
                    begin, end = begin[hit], end[hit]
                    grams, first = line_shingles(sums, begin, end)
                    content += own[hit].tolist()
                    sets = [np.unique(g) for g in np.split(grams, first[1:])]
                    shingles += [g.view(np.int64) for g in sets]
                    marks += [mark_of(g) for g in sets]
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(shingles, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))], ["content", "shingles", "mark"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "content long, shingles array<long>, mark array<long>")


def mark_of(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MARK, bool)
    bits[(shingles >> np.uint64(7)) % np.uint64(64 * MARK)] = True
    return np.packbits(bits).view(np.int64)


def similar(natural: DataFrame, docs: DataFrame, text_col: str, least: float = SIMILAR, cut=paragraphs, small: int = SMALL, at_once: int = AT_ONCE, rounds: int = ROUNDS) -> DataFrame:
    """Classes (content, root) of different paragraphs of exact similarity ``least`` or more, from rows (content, bands)
    with repeats, and the documents they come from, which ``cut`` makes into paragraphs. Any two that share a band and are
    that similar have one root, the smallest content of their class; those without a partner have no row."""
    context = natural.sparkSession.sparkContext
    shared = band_rows(natural).groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("key")
    shared = stash(shared, "shared")
    bits = context.broadcast(bit_map(shared, "key"))
    members = stash(band_rows(natural, bits).distinct().join(shared, "key"), "bands")
    bits.destroy()
    wanted = members.select("content").distinct()
    texts = texts_of(wanted, docs, text_col, cut)
    # small bands: all pairs; crowded ones: each member with the leader, the smallest hash for this band
    leader = F.min(F.struct(F.xxhash64("content", "key").alias("h"), "content"))
    crowded = members.groupBy("key").agg(leader.alias("lead"), F.count(F.lit(1)).alias("n")).where(F.col("n") > small)
    marked = stash(members.join(crowded.select("key", F.col("lead.content").alias("leader")), "key", "left"), "marked")
    plain = marked.where("leader is null")
    pairs = plain.alias("p").join(plain.alias("t"), "key").where("p.content < t.content").selectExpr("p.content as a", "t.content as b")
    stars = marked.where("content <> leader").selectExpr("least(content, leader) as a", "greatest(content, leader) as b")
    hot = marked.where("leader is not null").select("content").distinct()
    return classes(texts, pairs.unionByName(stars), hot, least, small, at_once, rounds)


def texts_of(wanted: DataFrame, docs: DataFrame, text_col: str, cut=paragraphs) -> DataFrame:
    """Rows (content, shingles, mark) of the paragraphs of ``docs`` whose ``content`` is in ``wanted``, each once."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "content"))
    texts = stash(shingled(docs, text_col, bits, cut).dropDuplicates(["content"]).join(wanted, "content", "left_semi"), "shingles")
    bits.destroy()
    return texts


def classes(texts: DataFrame, pairs: DataFrame, hot: DataFrame, least: float = SIMILAR, small: int = SMALL, at_once: int = AT_ONCE, rounds: int = ROUNDS) -> DataFrame:
    """Classes (content, root) by those of ``pairs`` (a, b) and of all pairs within ``hot`` (content) whose exact similarity
    is ``least`` or more; ``texts`` has the shingles of them all."""
    left, right = texts.select(F.col("content").alias("a"), F.col("shingles").alias("x")), texts.select(F.col("content").alias("b"), F.col("shingles").alias("y"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("x", "y"))
        linked = pairs.distinct().join(left, "a").join(right, "b").where(both >= F.lit(least) * (F.size("x") + F.size("y") - both))
        return stash(linked.select("a", "b"), "links")

    roots = merged(None, verified(pairs))
    left_over, turn, before = rarest(texts.join(hot, "content"), least), 0, None
    # pairs that share crowded bands only also share one of their rarest shingles, at places that leave room enough; what
    # their marks differ in they do not share either
    enough = f">= {least / (1 + least)} * (p.size + t.size) - 1e-6"
    differ = " + ".join(f"bit_count(p.mark[{i}] ^ t.mark[{i}])" for i in range(MARK))
    room = f"p.root <> t.root and least(p.size - p.place, t.size - t.place) {enough} and (p.size + t.size - ({differ})) / 2 {enough}"
    while not left_over.isEmpty():
        rows = left_over.join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
        # the leader is the one with least of its own, which the others are most likely to be variants of
        lead = F.min(F.struct("alone", F.xxhash64("content", "shingle", F.lit(turn)).alias("h"), "content", "size", "place", "root", "mark")).alias("lead")
        groups = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), lead)
        rows = stash(rows.join(groups.where("lo < hi").select("shingle", "n", "lead"), "shingle"), "rarest")
        # who has the leader's root need not meet others of that root: only those of other roots look for partners
        seeking = rows.where("root <> lead.root")
        work, size = seeking.agg(F.sum("n")).first()[0] or 0, rows.count()
        # a round that does not halve the work costs more than it saves: leaders thin nothing out there
        last = turn >= rounds or work <= at_once * size or (before is not None and 2 * work > before)
        asking = seeking if last else seeking.where(F.col("n") <= small)
        pairs = asking.alias("p").join(rows.alias("t"), "shingle").where(room).selectExpr("least(p.content, t.content) as a", "greatest(p.content, t.content) as b")
        if last:
            return merged(roots, verified(pairs))
        stars = seeking.where(F.col("n") > small).selectExpr("struct(content, size, place, root, mark) as p", "lead as t").where(room)
        found = verified(pairs.unionByName(stars.selectExpr("least(p.content, t.content) as a", "greatest(p.content, t.content) as b")))
        roots = merged(roots, found)
        # a leader has met all others of its group
        left_over = rows.where((F.col("n") > small) & (F.col("content") != F.col("lead.content"))).select("content", "size", "place", "alone", "mark", "shingle")
        turn, before = turn + 1, work
    return roots


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes (content, root) after more links (a, b): only roots are connected anew, not what they already stand for."""
    if roots is None:
        return components(links, name="similar").select(F.col("node").alias("content"), F.col("component").alias("root"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(roots.withColumnsRenamed({"content": end, "root": f"root_{end}"}), end, "left")
    met = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), name="similar")
    old = roots.join(met.select(F.col("node").alias("root"), "component"), "root", "left").select("content", F.coalesce("component", "root").alias("root"))
    new = met.select(F.col("node").alias("content"), F.col("component").alias("root")).join(roots, "content", "left_anti")
    return stash(old.unionByName(new), "roots")


def rarest(texts: DataFrame, least: float) -> DataFrame:
    """Rows (content, size, place, alone, mark, shingle) of the shingles that are rarest among ``texts`` (content, shingles,
    mark), so many of each that any two of similarity ``least`` share one, with their place in that order; those that only
    one text has are left out, ``alone`` counts them."""
    own = texts.select("content", "mark", F.explode("shingles").alias("shingle"))
    counts = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ordered = own.join(counts, "shingle").groupBy("content").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"), F.count_if(F.col("n") == 1).alias("alone"), F.any_value("mark").alias("mark"))
    size = F.size("all")
    first = F.slice("all", 1, (size - F.ceil(least * size - 1e-6) + 1).cast("int"))
    found = ordered.select("content", size.alias("size"), "alone", "mark", F.posexplode(first).alias("place", "s")).where("s.n > 1")
    return stash(found.select("content", "size", "place", "alone", "mark", F.col("s.shingle").alias("shingle")), "rarest")


#: A floating paragraph with more than this share of all rows is joined in ``SALTS`` parts; so there are at most 1 / HOT of them.
HOT, SALTS = 0.001, 64


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHINGLE) -> DataFrame:
    """A row (id, start, words, floating, class, keep) for each paragraph of a class that two or more documents share;
    natural paragraphs of fewer than ``shortest`` words do not count."""
    rows = stash(units(docs, id_col, text_col, shortest), "units")
    return natural_repeats(rows.where("not floating"), docs.where(F.col(id_col).isNotNull()), text_col, shortest).unionByName(floating_repeats(rows.where("floating")))


def floating_repeats(rows: DataFrame) -> DataFrame:
    """Equal windows of two or more documents. Only their hashes and ids are shuffled to find them."""
    session = rows.sparkSession
    found = rows.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("first < hi")
    found = stash(found.select("content", "first", "n"), "windows")
    hot = [r[0] for r in found.where(F.col("n") > HOT * rows.count()).select("content").collect()]
    bits = session.sparkContext.broadcast(bit_map(found, "content"))
    members = thinned(rows.select("id", "start", "again", "content"), "content", bits)
    salt = lambda part: F.when(F.col("content").isin(hot), part).otherwise(F.lit(0))
    members = members.withColumn("salt", salt(F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int")))
    wanted = found.withColumn("salt", F.explode(F.when(F.col("content").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    joined = members.join(wanted.select("content", "first", "salt"), ["content", "salt"])
    return joined.select("id", "start", F.lit(LEAST).alias("words"), F.lit(True).alias("floating"), F.col("content").alias("class"), ((F.col("id") == F.col("first")) & ~F.col("again")).alias("keep"))


def natural_repeats(rows: DataFrame, docs: DataFrame, text_col: str, shortest: int) -> DataFrame:
    """Equal and similar paragraphs of two or more documents."""
    named = similar(rows.select("content", "bands"), docs, text_col, cut=functools.partial(paragraphs, shortest=shortest))
    spread = rows.groupBy("content").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("hi"))
    classes = stash(spread.join(named, "content", "left").withColumn("class", F.coalesce("root", "content")), "spread")
    shared = classes.groupBy("class").agg(F.min("first").alias("first"), F.max("hi").alias("hi")).where("first.id < hi").select("class", "first")
    wanted = stash(classes.select("class", "content").join(shared, "class"), "classes")
    bits = rows.sparkSession.sparkContext.broadcast(bit_map(wanted, "content"))
    members = thinned(rows.select("id", "start", "words", "content"), "content", bits).join(wanted, "content")
    return members.select("id", "start", "words", F.lit(False).alias("floating"), "class", (F.struct("id", "start") == F.col("first")).alias("keep"))


def removed_spans(found: DataFrame) -> DataFrame:
    """What to cut from each document: rows (id, start, end) in words, the union of its paragraphs that do not stay."""
    cut = found.where(~F.col("keep")).select("id", "start", (F.col("start") + F.col("words")).alias("end")).distinct()
    by_start = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(by_start)
    return cut.withColumn("island", island).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
