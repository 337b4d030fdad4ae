"""Language identification by n-gram filters with a bit for each language.

Learning: n-grams of one to four signs are counted by language over labelled texts, in lower case and with each run of
what is no letter as one space. At most about ``SAMPLE`` labelled rows a language are read, drawn by a hash of the id.
An n-gram belongs to the languages in which its share is at least ``SHARE`` of its largest share in any; each
language keeps its ``KEPT`` most frequent ones. They go into bit-sliced Bloom filters: a table of slots whose bits
stand for languages, eight to a slice. An n-gram sets its languages' bits in ``HASHES`` slots, and a look-up takes the
bits set in all of them, which gives all languages that contain the n-gram at once, and now and then one more.

Prediction: the bits are counted for each language over all n-grams of the whole text, repeats included. A filter
filled to f answers yes by chance to f^k of all look-ups, so a count c of n is corrected to (c - n f^k) / (1 - f^k).
The largest decides; the score is its share of the sum of all.

Sizes: the filters hold ``KEPT`` n-grams a language whatever the table's size, and go to the workers by broadcast.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learnt;
equal counts go to the language with more labelled rows, then to the first name, and so does, with score 0, a text
none of whose n-grams is known; rows without language or text teach nothing; rows of one id are predicted each by
itself; long texts are read in pieces, cut at a space, where there is one; all columns stay, and the new ones get
another name where theirs is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import free_name, ship, sliced

SIZES = (1, 2, 3, 4)
SAMPLE, SHARE, KEPT, HASHES = 40_000, 0.5, 30_000, 3
#: Signs that are turned into n-grams at a time.
PIECE = 1 << 19
UNKNOWN = "und"


@dataclass
class Model:
    """``slots``: by slice of eight languages, the bits of each slot; ``chance``: what a language's filter lets through."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    sizes: tuple[int, ...]


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, each between spaces and closed by 0; the text of each; the letters by text."""
    lowered = [f" {t.lower()} \0" for t in texts]
    sizes = np.array([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = letters()[codes]
    found = np.bincount(owner[letter], minlength=len(texts))
    codes[~letter] = 32
    codes[np.cumsum(sizes) - 1] = 0
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[kept].astype(np.uint64), owner[kept], found


def grams(codes: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie within one text, and their texts."""
    hashes, owners = [], []
    rolled = np.zeros(len(codes) + 1, np.uint64)
    for size in range(1, max(sizes) + 1):
        if len(codes) < size:
            break
        rolled = rolled[: len(codes) - size + 1] * np.uint64(0x100000001B3) + codes[size - 1 :]
        if size in sizes:
            within = (owner[size - 1 :] == owner[: len(owner) - size + 1]) & (codes[size - 1 :] != 0)
            h = (rolled[within] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            hashes.append(h * np.uint64(0xBF58476D1CE4E5B9))
            owners.append(owner[size - 1 :][within])
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *owners])


def parts_of(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in lots of about ``most`` signs, long ones in pieces: the places of the texts, and the pieces."""
    places, lot, total = [], [], 0
    for k, text in enumerate(texts):
        start, text = 0, text or ""
        while start < len(text):
            end = len(text)
            if end - start > most:
                space = text.find(" ", start + most)
                end = start + most if space < 0 or space > start + 2 * most else space
            places.append(k)
            lot.append(text[start:end])
            total += end - start
            start = end
            if total >= most:
                yield places, lot
                places, lot, total = [], [], 0
    if lot:
        yield places, lot


def slots_of(hashes: np.ndarray, slots: int, k: int = HASHES) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(k):
        yield ((hashes + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64)


def counted(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Rows (lang, gram, n) of each task, over (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for whole in batches:
            for b in sliced(whole, "text", 2 << 20):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    for _, lot in parts_of(texts):
                        codes, owner, _ = signs(lot)
                        parts = held.setdefault(lang, [])
                        parts.append(np.unique(grams(codes, owner, sizes)[0], return_counts=True))
                        if len(parts) == 16:
                            held[lang] = [summed(parts)]
        for lang, parts in held.items():
            found, n = summed(parts)
            for at in range(0, len(found), 1 << 16):
                part = found[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["lang", "gram", "n"])

    ship(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, share: float = SHARE, kept: int = KEPT, sizes: tuple[int, ...] = SIZES) -> Model:
    """Learn from the rows that have a language and a text."""
    labelled = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("draw"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # as many as there are languages
    languages = [r["lang"] for r in rows]
    slots = 1 << max(3, (8 * kept - 1).bit_length())
    if not languages:
        return Model([], np.zeros((1, slots), np.uint8), np.zeros(0), sizes)
    rates = F.create_map(*[F.lit(x) for r in rows for x in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = labelled.where(F.col("draw").bitwiseAND(F.lit((1 << 20) - 1)) < rates[F.col("lang")] * (1 << 20))
    sums = counted(drawn, sizes).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    shares = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= share * F.col("most"))
    best = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= kept)
    table = np.zeros(((len(languages) + 7) // 8, slots), np.uint8)
    number = {lang: i for i, lang in enumerate(languages)}
    found = best.select("lang", "gram").toArrow().combine_chunks()  # ``kept`` rows a language at most
    which = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    hashes = found.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    chance = np.zeros(len(languages))
    for i in range(len(languages)):
        for at in slots_of(hashes[which == i], slots):
            table[i // 8, at] |= np.uint8(1 << (i % 8))
        chance[i] = (table[i // 8] >> (i % 8) & 1).mean() ** HASHES
    return Model(languages, table, chance, sizes)


BITS = np.array([[m >> i & 1 for i in range(8)] for m in range(256)], np.int64)


def judged(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and its share of the corrected counts."""
    languages = len(model.languages)
    hits, looked, seen = np.zeros((len(texts), 8 * len(model.slots)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for places, lot in parts_of(texts):
        codes, owner, found = signs(lot)
        hashes, owners = grams(codes, owner, model.sizes)
        at = np.array(places)
        np.add.at(seen, at, found)
        np.add.at(looked, at, np.bincount(owners, minlength=len(lot)))
        slots = list(slots_of(hashes, model.slots.shape[1]))
        for s, bits in enumerate(model.slots):
            mask = bits[slots[0]]
            for x in slots[1:]:
                mask &= bits[x]
            counts = np.bincount(owners * 256 + mask, minlength=len(lot) * 256).reshape(-1, 256) @ BITS
            np.add.at(hits, (at, slice(8 * s, 8 * s + 8)), counts)
    right = np.maximum(0, (hits[:, :languages] - looked[:, None] * model.chance) / np.maximum(1e-9, 1 - model.chance))
    known = (seen > 0) & (languages > 0)
    best = right.argmax(axis=1) if languages else np.zeros(len(texts), np.int64)
    total = right.sum(axis=1)
    top = right.max(axis=1) if languages else total
    scores = np.where(known & (total > 0), top / np.maximum(total, 1e-9), 0.0)
    return [model.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)], np.clip(scores, 0, 1).tolist()


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, str, str]:
    """``docs`` with the language and the score of each row, and the names of these two columns; without ``keep_text``
    the text is null."""
    lang_name = free_name(docs, "lang_pred")
    score_name = free_name(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns) + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, names[at], 2 << 20):
                langs, scores = judged(shared.value, b.column(at).to_pylist())
                columns = b.columns
                if not keep_text:
                    columns[at] = pa.nulls(len(b), columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    ship(docs.sparkSession)
    types = [f.dataType.simpleString() for f in docs.schema] + ["string", "double"]
    found = docs.toDF(*names[:-2]).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    return found.toDF(*docs.columns, lang_name, score_name), lang_name, score_name
