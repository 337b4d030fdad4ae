"""Which words set sources apart: term counts by source in mergeable radix tries.

Each task counts the terms of its documents and lays them out, by language, as radix tries of bytes: the leaves in
UTF-8 order, each with the depth at which it leaves the path of the leaf before it, the label from there, and at the
leaf a counter for each source and the number of documents. A trie is cut at prefixes of ``PREFIX`` bytes, so that
equal prefixes of all tasks can be dealt out by ranges and merged: the subtries of one prefix are walked, counters of
equal leaves are added, and the leaves that are in enough documents are laid out again.

A second walk over the merged tries streams, for each leaf, what each source of the language adds to the divergence
from each other source, and the candidates for the most typical terms, which come in the order that settles ties.

The share of a term in a group is p = 1 + floor(10^9 (count + 1) / (N + V)), where V is the number of kept terms of the
language and N the number of their occurrences in the group. All arithmetic is whole numbers; the division by N + V is
made in steps of 1000, which is exact up to 9 * 10^15 occurrences.

Sizes: a task holds the counts of about ``WORDS`` words and ``ENTRIES`` counters, or ``LEAVES`` leaves and those of one
prefix; the number of sources of a language, S, counts as many rows as the result has (S^2 a language), and work on
pairs is done by blocks of leaves.

Edge cases: null text, language and source count as ''; a language without kept terms gives all pairs with value 0
and no terms; a language of one source gives no pairs; equal rows count each; long texts are read in pieces, and terms
of any length are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, ship, stash
from textloom.llm.terms import LETTERS, pieces

PREFIX = 6
#: Words that a task counts at a time, counters that it holds before it hands its tries on, leaves that are merged at a time.
WORDS, ENTRIES, LEAVES = 500_000, 1_000_000, 150_000
#: Numbers in the matrices of the second walk.
CELLS = 1 << 20
SCALE = 1_000_000_000

TRIE = "lang string, prefix binary, depth array<int>, label array<binary>, docs array<long>, ends array<int>, source array<string>, n array<long>"


def walk(depth: list[int], label: list[bytes]) -> Iterator[bytes]:
    """The terms of a trie in UTF-8 order, or of several one after another."""
    path = b""
    for d, rest in zip(depth, label, strict=True):
        path = path[:d] + rest
        yield path


def shared_bytes(terms: list[bytes]) -> np.ndarray:
    """For each term how many bytes it begins with that the one before it begins with too."""
    sizes = np.array([len(t) for t in terms], np.int64)
    data, starts = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(sizes) - sizes
    out = np.zeros(len(terms), np.int64)
    at, j = np.arange(1, len(terms)), 0
    while len(at):
        at = at[(sizes[at] > j) & (sizes[at - 1] > j)]
        at = at[data[starts[at] + j] == data[starts[at - 1] + j]]
        j += 1
        out[at] = j
    return out


class Counts:
    """Counters by language, term and source, and documents by language and term; all arrays are in that order."""

    def __init__(self, langs: list[str], sources: list[str], terms: list[bytes], of: np.ndarray, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, n: np.ndarray):
        self.langs, self.sources, self.terms, self.of, self.docs, self.leaf, self.source, self.n = langs, sources, terms, of, docs, leaf, source, n

    @staticmethod
    def added(langs: list[str], sources: list[str], terms: pa.Array, term: np.ndarray, of: np.ndarray, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, n: np.ndarray) -> Counts:
        """Sum up leaves (term, language ``of``, docs), any number of them for each, and counters (leaf, source, n)."""
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, back = np.unique(of * len(terms) + rank[term], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, docs)
        own = back[leaf] * len(sources) + source
        counters, where = np.unique(own, return_inverse=True)
        sums = np.zeros(len(counters), np.int64)
        np.add.at(sums, where, n)
        words = terms.take(pa.array(order[keys % max(1, len(terms))])).to_pylist()
        return Counts(langs, sources, words, keys // max(1, len(terms)), total, counters // max(1, len(sources)), counters % max(1, len(sources)), sums)

    def at_least(self, docs: int) -> Counts:
        keep = self.docs >= docs
        number = np.cumsum(keep) - 1
        mine = keep[self.leaf]
        return Counts(self.langs, self.sources, [t for t, k in zip(self.terms, keep.tolist(), strict=True) if k], self.of[keep], self.docs[keep], number[self.leaf[mine]], self.source[mine], self.n[mine])

    def laid_out(self, prefix: int) -> pa.RecordBatch | None:
        """Tries, a row for each language and prefix."""
        if not self.terms:
            return None
        depth = shared_bytes(self.terms)
        new = np.ones(len(depth), bool)
        new[1:] = (depth[1:] < prefix) | (self.of[1:] != self.of[:-1])
        depth[new] = 0
        first = np.flatnonzero(new)
        labels = pa.array([t[d:] for t, d in zip(self.terms, depth.tolist(), strict=True)], pa.binary())
        ends = np.searchsorted(self.leaf, np.arange(len(depth)), "right")
        before = np.concatenate(([0], ends))[first]  # counters before each row
        row = np.cumsum(new) - 1
        leaves = pa.array(np.append(first, len(depth)).astype(np.int32))
        counters = pa.array(np.append(before, len(self.leaf)).astype(np.int32))
        lists = lambda offsets, values: pa.ListArray.from_arrays(offsets, values)
        columns = [
            pa.array(self.langs, pa.string()).take(pa.array(self.of[first])), pa.array([self.terms[i][:prefix] for i in first.tolist()], pa.binary()), lists(leaves, pa.array(depth.astype(np.int32))), lists(leaves, labels), lists(leaves, pa.array(self.docs)),
            lists(leaves, pa.array((ends - before[row]).astype(np.int32))), lists(counters, pa.array(self.sources, pa.string()).take(pa.array(self.source))), lists(counters, pa.array(self.n)),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TRIE.split(", ")])


def numbered(values: pa.Array) -> tuple[list, np.ndarray]:
    """Distinct values, and for each row the number of its own."""
    found = values.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def counted(langs: list[str], sources: list[str], words: list[list[bytes]], owner: list[int]) -> Counts:
    """Count lists of words: ``owner`` has the document of each list, ``langs`` and ``sources`` are by document."""
    sizes = np.array([len(w) for w in words], np.int64)
    found = pa.array([t for w in words for t in w], pa.binary()).dictionary_encode()
    term, doc = found.indices.to_numpy().astype(np.int64), np.repeat(np.array(owner, np.int64), sizes)
    lang_names, lang = numbered(pa.array(langs, pa.string()))
    source_names, source = numbered(pa.array(sources, pa.string()))
    width = max(1, len(found.dictionary))
    pairs, n = np.unique(doc * width + term, return_counts=True)  # a document and a term of it
    doc, term = pairs // width, pairs % width
    return Counts.added(lang_names, source_names, found.dictionary, term, lang[doc], np.ones(len(doc), np.int64), np.arange(len(doc)), source[doc], n)


def of_tries(rows: pa.Table) -> Counts:
    """The tries of several tasks, walked and added up."""
    flat = lambda name: rows.column(name).combine_chunks().flatten()
    sizes = pc.list_value_length(rows.column("depth")).to_numpy()
    lang_names, lang = numbered(rows.column("lang").combine_chunks())
    found = pa.array(walk(flat("depth").to_pylist(), flat("label").to_pylist()), pa.binary()).dictionary_encode()
    ends = flat("ends").to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    ahead = np.concatenate(([0], ends[:-1]))
    ahead[first] = 0
    sources, source = numbered(flat("source"))
    return Counts.added(lang_names, sources, found.dictionary, found.indices.to_numpy().astype(np.int64), np.repeat(lang, sizes), flat("docs").to_numpy(), np.repeat(np.arange(len(ends)), ends - ahead), source, flat("n").to_numpy())


def tries(docs: DataFrame, prefix: int = PREFIX, entries: int = ENTRIES, words: int = WORDS) -> DataFrame:
    """The tries of each task over (lang, source, text), cut by prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        lists: list[list[bytes]] = []
        owner: list[int] = []
        langs: list[str] = []
        sources: list[str] = []

        def gathered() -> int:
            """Count what has been read; the number of counters held."""
            if lists:
                held.append(counted(langs, sources, lists, owner).laid_out(prefix))
            for x in (lists, owner, langs, sources):
                x.clear()
            return sum(len(b.column("n").flatten()) for b in held)

        total = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                if len(text) > 4 << 20:  # a long text: its terms are gathered first, so that it is one document
                    parts: dict[bytes, int] = {}
                    for found in pieces(text, LETTERS):
                        for w in found:
                            parts[w] = parts.get(w, 0) + 1
                    terms = pa.array(parts.keys(), pa.binary())
                    one = np.arange(len(parts))
                    made = Counts.added([lang], [source], terms, one, one * 0, one * 0 + 1, one, one * 0, np.fromiter(parts.values(), np.int64, len(parts))).laid_out(prefix)
                    held += [made] if made else []
                    continue
                langs.append(lang)
                sources.append(source)
                found = text.translate(LETTERS).split()
                if found:
                    lists.append(found)
                    owner.append(len(langs) - 1)
                    total += len(found)
                if total > words or len(langs) > 1 << 20:
                    total = 0
                    if gathered() > entries:
                        yield of_tries(pa.Table.from_batches(held)).laid_out(prefix)
                        held.clear()
        gathered()
        if held:
            yield of_tries(pa.Table.from_batches(held)).laid_out(prefix) if len(held) > 1 else held[0]

    ship(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(run, TRIE)


def merge(parts: DataFrame, least_docs: int, prefix: int = PREFIX, leaves: int = LEAVES) -> DataFrame:
    """One trie for each language and prefix, with the leaves of ``least_docs`` documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                held.append(b)
                size += len(b.column("depth").flatten())
                if size < leaves:
                    continue
                rows = pa.Table.from_batches(held)
                last = len(rows) - 1
                key = rows["lang"][last], rows["prefix"][last]
                open_ = pc.and_(pc.equal(rows["lang"], key[0]), pc.equal(rows["prefix"], key[1]))
                done = rows.filter(pc.invert(open_))
                if len(done) and (out := of_tries(done).at_least(least_docs).laid_out(prefix)):
                    yield out
                held = [of_tries(rows.filter(open_)).laid_out(prefix)]  # the last prefix may go on
                size = len(held[0].column("depth").flatten())
        if held and (out := of_tries(pa.Table.from_batches(held)).at_least(least_docs).laid_out(prefix)):
            yield out

    return parts.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(run, TRIE)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / whole), exactly, for counts below ``whole``."""
    out, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, most_terms: int = 200, prefix: int = PREFIX, entries: int = ENTRIES, words: int = WORDS, leaves: int = LEAVES, cells: int = CELLS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): in part ``pair`` the divergence of each source from each other source
    of its language, in part ``term`` the terms most typical of each source, ``most_terms`` at most."""
    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    whole = stash(merge(stash(tries(said, prefix, entries, words), "tries"), least_docs, prefix, leaves), "merged")
    counted = whole.select("lang", F.explode(F.arrays_zip("source", "n")).alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    kept = whole.groupBy("lang").agg(F.sum(F.size("label")).cast("long").alias("v"))
    groups = said.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n", "v"])
    stats = stash(groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.max("v").alias("v")), "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(b.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, at in by_lang.items():
                groups, v = b.column("groups")[at[0]].as_py(), b.column("v")[at[0]].as_py()
                rows = b.select(["prefix", "depth", "label", "ends", "source", "n"]).take(pa.array(at)).to_pylist()
                yield from second_walk(lang, sorted(rows, key=itemgetter("prefix")), groups, v, most_terms, cells)

    streamed = whole.select("lang", "prefix", "depth", "label", "ends", "source", "n").join(stats, "lang")
    found = stash(streamed.mapInArrow(run, "lang string, source string, part string, item string, value long"), "streamed")
    every = stats.select("lang", F.explode("groups.source").alias("source"), "groups").select("lang", "source", F.explode("groups.source").alias("item")).where("source <> item")
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(every.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(order))
    ranked_terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked_pairs.select(columns).unionByName(ranked_terms.select(columns))


def second_walk(lang: str, rows: list[dict], groups: list[dict], v: int, most_terms: int, cells: int) -> Iterator[pa.RecordBatch]:
    """What the leaves of some tries of one language, in order, add to each pair, and the best terms among them."""
    sources = [g["source"] for g in groups]
    occurrences = np.array([g["n"] for g in groups], np.int64)
    sizes, whole = occurrences + v, int(occurrences.sum()) + v
    number = {s: i for i, s in enumerate(sources)}
    leaves = []
    for row in rows:
        start = 0
        for term, end in zip(walk(row["depth"], row["label"]), row["ends"], strict=True):
            leaves.append((term, [number[x] for x in row["source"][start:end]], row["n"][start:end]))
            start = end
    high = max(1, cells // len(sources))  # leaves, and sources in a block of pairs: either matrix is bounded
    for first in range(0, len(sources), high):
        block = range(first, min(first + high, len(sources)))
        sums = np.zeros((len(block), len(sources)), np.int64)
        for at in range(0, len(leaves), high):
            p, counts = matrix(leaves[at : at + high], sizes)
            for k in block:
                mine = p[:, k : k + 1]
                sums[k - first] += ((mine - p) * (mine - p) // p).sum(axis=0)
            if first == 0:
                yield from typical(lang, sources, leaves[at : at + high], p, counts, whole, most_terms)
        a, o = np.nonzero(sums)
        yield answer(lang, [sources[first + i] for i in a.tolist()], "pair", [sources[i] for i in o.tolist()], sums[a, o])


def matrix(leaves: list[tuple], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros((len(leaves), len(sizes)), np.int64)
    at = np.repeat(np.arange(len(leaves)), [len(x[1]) for x in leaves])
    counts[at, [i for x in leaves for i in x[1]]] = [n for x in leaves for n in x[2]]
    return shares(counts, sizes[None, :]), counts


def typical(lang: str, sources: list[str], leaves: list[tuple], p: np.ndarray, counts: np.ndarray, whole: int, most: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` best terms of each source among these leaves; of equal values the first in UTF-8 order."""
    q = shares(counts.sum(axis=1), whole)
    for k, source in enumerate(sources):
        at = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
        if len(at):
            f = (p[at, k] - q[at]) ** 2 // q[at]
            best = np.argsort(-f, kind="stable")[:most]
            yield answer(lang, [source] * len(best), "term", [leaves[i][0].decode() for i in at[best].tolist()], f[best])


def answer(lang: str, sources: list[str], part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    n = len(sources)
    columns = [pa.array([lang] * n, pa.string()), pa.array(sources, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])
