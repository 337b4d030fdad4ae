"""Benchmark decontamination with suffix arrays of the training text.

Each slice of the documents is a shard of its own: the worker turns its words into numbers, sorts the suffixes of the
shard, and binary-searches every suffix of the test items in the sorted array. The range found holds all places where
the first words of that test suffix occur verbatim; the runs of such places along one diagonal are the maximal matches,
returned with their item, place and length.

Only words that occur in the items can match, so all other words share the number 0, and only suffixes that begin with
a run of such words as long as a window enter the array. Nothing that could match is left out.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. Items come
to the workers in blocks of bounded size (``BLOCK_BYTES``); more items mean more passes, and between passes the
documents carry the matches found so far.

Edge cases: a null or wordless document has no words and no hits; an item without words matches nothing; items of
equal text count each under its own id; an item with a null id hits words but is listed nowhere; rows with equal
ids are judged each on its own; an empty table of items leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, as_bytes, free_name, sliced, stash

WINDOW = 10
#: UTF-8 bytes of the items in one pass; the array of their windows takes about ten times that in a worker.
BLOCK_BYTES = 4 << 20
#: Bytes of text in one shard.
SHARD_BYTES = 4 << 20

#: Bytes to lower case, all but digits, letters and what is above ASCII to spaces.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class Items:
    """Test items of one block: numbers of their words and the sorted windows that can be searched."""

    def __init__(self, ids: list[str | None], texts: list[bytes | None], window: int = WINDOW):
        self.ids, self.window = ids, window
        words = [words_of(t) for t in texts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        #: By length of window: the items, the places in them, and the words of the windows.
        self.suffixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for k, ws in enumerate(words):
            numbers = np.array([self.vocabulary[w] for w in ws], np.int64)
            size = min(window, len(ws))
            for i in range(len(ws) - size + 1 if size else 0):
                found.setdefault(size, []).append((k, i, numbers[i : i + size]))
        for size, rows in found.items():
            self.suffixes[size] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.stack([r[2] for r in rows]))

    def matches(self, numbers: np.ndarray) -> np.ndarray:
        """Rows (item, place in the item, place in the shard, words) of all maximal matches of a window or more.

        ``numbers``: the words of the shard, 0 for those of no item and between documents.
        """
        out = [np.empty((0, 4), np.int64)]
        known = numbers != 0
        stops = np.flatnonzero(~np.append(known, False))
        run = stops[np.searchsorted(stops, np.arange(len(numbers)))] - np.arange(len(numbers))
        for size, (items, places, windows) in self.suffixes.items():
            first = np.zeros(len(self.vocabulary) + 1, bool)
            first[windows[:, 0]] = True
            at = np.flatnonzero((run >= size) & first[numbers])
            if not len(at):
                continue
            heads = numbers[at[:, None] + np.arange(size)]
            order = np.lexsort(heads.T[::-1])
            array = text_keys(heads[order])
            probes = text_keys(windows)
            low, high = np.searchsorted(array, probes, "left"), np.searchsorted(array, probes, "right")
            n = high - low
            if not n.sum():
                continue
            which = np.repeat(np.arange(len(n)), n)
            offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, place, where = items[which], places[which], at[order[low[which] + offsets]]
            # a run along one diagonal is one longer match
            way = np.lexsort((where, where - place, item))
            item, place, where = item[way], place[way], where[way]
            new = np.ones(len(way), bool)
            new[1:] = (np.diff(item) != 0) | (np.diff(where - place) != 0) | (np.diff(where) != 1)
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(way))) + size - 1
            out.append(np.stack([item[starts], place[starts], where[starts], lengths], 1))
        return np.concatenate(out)


def text_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as strings that sort alike; a leading 1 in each number keeps zero bytes off the end."""
    wide = (rows.astype(np.uint64) << np.uint64(8)) | np.uint64(1)
    return np.ascontiguousarray(wide.astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel()


def search(items: Items, texts: list[bytes | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Word counts of the texts; the matches of one shard, with places within their documents; and their documents."""
    get, counts, parts = items.vocabulary.get, [], []
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    numbers = np.concatenate(parts) if parts else np.empty(0, np.int64)
    begins = np.cumsum([0, *[n + 1 for n in counts]])[:-1]
    found = items.matches(numbers)
    docs = np.searchsorted(begins, found[:, 2], "right") - 1
    found[:, 2] -= begins[docs] if len(found) else 0
    return counts, found, docs


def blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list[str | None], list[bytes | None]]]:
    """The items in blocks of ``most`` bytes of text or one item; only one block is on the driver at a time."""
    ids, texts, total = [], [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        text = None if row[1] is None else row[1].encode()
        n = len(text or b"")
        if total and total + n > most:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(row[0])
        texts.append(text)
        total += n
    yield ids, texts


def matches(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the number of words, and all maximal matches of a window or
    more as an array of (item_id, item_start, doc_start, words), all in words. Without ``keep_text`` the text is null."""
    n_name = free_name(docs, "n_words")
    m_name = free_name(docs, "matches")
    kind = "array<struct<item_id:string,item_start:int,doc_start:int,words:int>>"
    kind_arrow = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
    now, text_at, width = docs, docs.columns.index(text_col), len(docs.columns)
    now = now.withColumn(n_name, F.lit(0).cast("long")).withColumn(m_name, F.expr(f"cast(array() as {kind})"))
    schema = now.schema
    names = [f"c{i}" for i in range(len(schema))]
    now = now.toDF(*names)
    first, ahead = True, blocks(items, item_id, item_text, block_bytes)
    following = next(ahead)
    while following:
        (ids, texts), following = following, next(ahead, None)
        empty = not keep_text and following is None
        block = now.sparkSession.sparkContext.broadcast(Items(ids, texts, window))

        def batch(b: pa.RecordBatch, block=block, fresh=first, empty=empty) -> pa.RecordBatch:
            out = []
            for part in sliced(b, names[text_at], SHARD_BYTES):
                counts, found, owner = search(block.value, as_bytes(part.column(text_at)))
                lists: list[list] = [[] for _ in counts] if fresh else [x or [] for x in part.column(width + 1).to_pylist()]
                for k, (item, i, j, n) in zip(owner.tolist(), found.tolist(), strict=True):
                    lists[k].append({"item_id": block.value.ids[item], "item_start": i, "doc_start": j, "words": n})
                kept = part.columns[:width]
                if empty:
                    kept[text_at] = pa.nulls(len(part), kept[text_at].type)
                columns = [*kept, pa.array(counts, pa.int64()), pa.array(lists, kind_arrow)]
                out.append(pa.RecordBatch.from_arrays(columns, names))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        if not first:
            now = stash(now, "matches")
        now, first = arrow_map(now, batch, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))), False
    return now.toDF(*[f.name for f in schema]), n_name, m_name


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """A row for each document: id, n_words, hit words, the sorted ids of the items with a window in it, the matches."""
    found, n_words, found_at = matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), items, keep_text=False, **more)
    # words covered by the union of the matches: a fold over them in order of their start
    covered = f"""aggregate(array_sort(transform({found_at}, m -> struct(m.doc_start as s, m.doc_start + m.words as e))), struct(0L as n, 0 as up_to),
        (a, m) -> struct(a.n + greatest(0, m.e - greatest(m.s, a.up_to)) as n, greatest(a.up_to, m.e) as up_to), a -> a.n)"""
    listed = f"array_sort(array_distinct(filter(transform({found_at}, m -> m.item_id), i -> i is not null)))"
    return found.selectExpr("id", f"{n_words} as n_words", f"{covered} as n_hit", f"{listed} as items", f"{found_at} as matches")


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    found, n_words, found_at = matches(docs, items, text_col=text_col, **more)
    return found.where(F.size(found_at) == 0).drop(n_words, found_at)
