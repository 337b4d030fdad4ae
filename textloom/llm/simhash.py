"""Near-duplicate detection by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits, the majority of the XXH64 bits of the word shingles of a text. Two texts are linked when
their fingerprints differ in at most two bits. Links are found by multi-index hashing: the fingerprint is cut into two
segments of 32 bits. Two fingerprints at distance 2 or less differ in at most one bit of the first segment, or agree
in the second, so it is enough to look up the Hamming ball of radius 1 of the first segment and the second segment
itself, and to verify the complete distance of what is found. A flipped bit is only tried from 0 to 1: of two
segments that differ in one bit, exactly one has the 0.

A segment value that many fingerprints share would give all pairs of them. Such a bucket is split again by the other
segment, cut into two halves of 16 bits under the same rule, so nothing is lost and 47 or 48 of the 64 bits agree
within what is compared.

Edge cases: a text of one or two words is one shingle; a text without words (null, empty, white space) has fingerprint
zero, which is linked like any other; each row gets its own result, also when ids repeat; rows with a null id are
linked but give no component id of their own (a component of only such rows has a null id). Columns besides id and
text are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, as_bytes, components, free_name, stash

SEED, BLOCK = 42, 1 << 14
#: A segment value that more fingerprints share is split by the other segment.
HOT_BUCKET = 48
#: A fingerprint that more rows share is told to all tasks, so that those rows meet in none.
HEAVY = 4096


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The SimHash of one text as an unsigned integer."""
    words = (text or b"").lower().split()  # A-Z and ASCII white space only, as both work on bytes here
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        parts = map(joined.__getitem__, map(slice, starts[k : k + BLOCK], ends[k : k + BLOCK]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", min(BLOCK, n - k))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """A row (id, fp) for each row; fp holds the 64 bits as a signed long."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), batch, f"id {kind}, fp long")


def links(distinct_fps: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """All pairs (a, b) of fingerprints at a distance of one or two bits, each once or more, from a table of distinct ``fp``."""
    fps = distinct_fps.select("fp")
    high, low = "cast(shiftright(fp, 32) as int)", "cast(((fp & 4294967295L) ^ 2147483648L) - 2147483648L as int)"
    members = fps.selectExpr("fp", f"stack(2, 0, {high}, 1, {low}) as (seg, key)")
    crowded = stash(members.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("seg", "key", F.lit(True).alias("crowded")), "crowded")
    # left: bits that may still differ in the other segment
    balls = fps.selectExpr("fp", f"{high} as h", f"{low} as l").selectExpr(
        "fp",
        """inline(concat(array(struct(0 as seg, h as key, 2 as left), struct(1 as seg, l as key, 2 as left)),
                  transform(filter(sequence(0, 31), i -> (shiftright(h, i) & 1) = 0), i -> struct(0 as seg, h | shiftleft(1, i) as key, 1 as left))))""",
    )
    # merges throughout: what grows with the rows is not to be collected by the driver for a broadcast
    members, balls = (x.join(crowded.hint("merge"), ["seg", "key"], "left") for x in (members, balls))
    far = "bit_count(p.fp ^ t.fp) <= 2 and (p.left = 1 or p.fp < t.fp)"
    plain = balls.where("crowded is null").alias("p").join(members.where("crowded is null").hint("merge").alias("t"), F.expr(f"p.seg = t.seg and p.key = t.key and {far}"))
    other = f"case seg when 0 then {low} else {high} end"
    parts = f"({other} & 65535)", f"(shiftrightunsigned({other}, 16))"
    deep_members = members.where("crowded").selectExpr("fp", "seg", "key", f"inline(array(struct(0 as half, {parts[0]} as part), struct(1 as half, {parts[1]} as part)))")
    deep_balls = balls.where("crowded").selectExpr("fp", "seg", "key", "left", f"{parts[0]} as x", f"{parts[1]} as y").selectExpr(
        "fp",
        "seg",
        "key",
        "left",
        """inline(concat(array(struct(0 as half, x as part, true as same), struct(1 as half, y as part, true as same)),
                  if(left = 2, transform(filter(sequence(0, 15), i -> (shiftright(x, i) & 1) = 0), i -> struct(0 as half, x | shiftleft(1, i) as part, false as same)), array())))""",
    )
    far = "bit_count(p.fp ^ t.fp) <= 2 and (p.left = 1 or not p.same or p.fp < t.fp)"
    deep = deep_balls.alias("p").join(deep_members.hint("merge").alias("t"), F.expr(f"p.seg = t.seg and p.key = t.key and p.half = t.half and p.part = t.part and {far}"))
    return plain.selectExpr("p.fp as a", "t.fp as b").unionByName(deep.selectExpr("p.fp as a", "t.fp as b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, hot: int = HOT_BUCKET, heavy: int = HEAVY) -> DataFrame:
    """A row (id, fp, component) for each row of ``docs``: its fingerprint and the smallest id of its component."""
    prints = stash(fingerprints(docs, id_col, text_col, size), "fps")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = components(links(distinct, hot), name="simhash", merge=True).selectExpr("node as fp", "component as root")
    named = distinct.join(found.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    by_fp = stash(named.join(lowest.hint("merge"), "root").select("fp", "component", (F.col("n") > heavy).alias("heavy")), "components")
    # at most one fingerprint in ``heavy`` rows is broadcast; the others are merged
    few = by_fp.where("heavy").select("fp", F.struct("component").alias("told"))
    rows = prints.join(F.broadcast(few), "fp", "left")
    rest = rows.where("told is null").join(by_fp.where("not heavy").hint("merge"), "fp")
    return rows.where("told is not null").select("id", "fp", "told.component").unionByName(rest.select("id", "fp", "component"))


def hex16(fp: str) -> str:
    """SQL for the 16 lowercase hex digits of a signed long."""
    return f"lower(lpad(hex({fp}), 16, '0'))"




def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """``docs`` with one row of each component: one with the smallest id, of rows with that id and fingerprint any one.
    A null id comes after all others."""
    name, at, schema = free_name(docs, "fp"), docs.columns.index(text_col), docs.schema
    names = [f"c{i}" for i in range(len(schema) + 1)]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in as_bytes(b.column(at).cast(pa.string()))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names)

    types = [f.dataType.simpleString() for f in schema] + ["long"]
    rows = stash(arrow_map(docs.toDF(*names[:-1]), batch, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))).toDF(*docs.columns, name), "prints")
    prints = rows.select(F.col(name).alias("fp"), F.col(id_col).alias("id"))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(distinct, hot), name="simhash", merge=True).selectExpr("node as fp", "component as root")
    named = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("fp"))).alias("best"))
    chosen = chosen.select(F.col("best.fp").alias("__fp"), F.coalesce(F.col("best.first").cast("string"), F.lit("")).alias("__key"))
    key = free_name(rows, "id_key")
    rows = rows.withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = rows.join(chosen.hint("merge"), (F.col(name) == F.col("__fp")) & (F.col(key) == F.col("__key")), "left_semi")
    return kept.dropDuplicates([name, key]).drop(name, key)
