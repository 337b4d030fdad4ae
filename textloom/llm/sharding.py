"""Sharding by fixed virtual slots, with DataFrame functions only.

A record is hashed into one of a fixed number of virtual slots. Bytes are summed per slot, and a small table maps slots
to shards. That map is versioned and stored: version 0 deals slots out in turn, and each later version is an edit of the one
before it that moves as few slots as it can, from shards above the mean to shards below it. Records never move unless their
slot does. A caller that keeps the map passes its last version the next time; slots that it does not have are dealt out in turn.

The number of slots is a parameter; all work on the map is on that many rows at most, so it folds over one array.

Edge cases: a null text has no bytes and size 1; rows without an id are placed by their text; repeated rows share a
slot; a very long text is one record like any other; an empty table gives an empty result. Columns besides id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import gapless, stash

SLOTS = 4096


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """A row (id, size, crc, vslot) for each row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), text)), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot in use; at most as many rows as there are slots."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: slots dealt out in turn, whatever they hold."""
    return loads.select(F.lit(0).alias("version"), "vslot", "bytes", F.pmod("vslot", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map``: largest first, a slot leaves its shard for the one that holds least, if that leaves
    the first no lighter than the mean and makes the other no heavier; then, if it brings the two nearer. A slot of a shard
    that is no more always leaves.

    Two folds over one array of all slots (their number is fixed) carry the loads of the shards.
    """
    slot = F.struct((-F.col("bytes")).alias("minus"), "vslot", F.col("shard").alias("was"), "version")
    ordered = slot_map.agg(F.array_sort(F.collect_list(slot)).alias("slots"), F.sum("bytes").alias("total"))
    at = lambda loads, i: F.element_at(loads, i + 1)
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate("slots", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["was"] == i, -x["minus"]).otherwise(F.lit(0).cast("long"))))

    def fold(of, mean, start, gentle):
        def place(acc, x):
            size, was = -x["minus"], x["was"]
            least = F.array_min(acc["loads"])
            known = was < F.lit(shards)
            own = at(acc["loads"], F.when(known, was).otherwise(0))
            better = (own - size >= mean) & (least + size <= mean) if gentle else size < own - least
            to = F.when(known & ~better, was).otherwise(F.array_position(acc["loads"], least).cast("int") - 1)
            moved = F.transform(acc["loads"], lambda load, i: load + F.when((i == to) & (to != was), size).otherwise(F.lit(0).cast("long")) - F.when((i == was) & (to != was), size).otherwise(F.lit(0).cast("long")))
            return F.struct(moved.alias("loads"), F.concat(acc["dealt"], F.array(F.struct(x["minus"].alias("minus"), x["vslot"].alias("vslot"), to.alias("was"), x["version"].alias("version")))).alias("dealt"))

        return F.aggregate(of, start, place)

    kind = "array<struct<minus:bigint,vslot:int,was:int,version:int>>"
    empty = lambda loads_: F.struct(loads_.alias("loads"), F.array().cast(kind).alias("dealt"))
    mean = F.col("total") / F.lit(shards)
    once = ordered.select("total", fold(F.col("slots").cast(kind), mean, empty(loads), True).alias("a"))
    twice = once.select(fold(F.col("a.dealt"), mean, empty(F.col("a.loads")), False).getField("dealt").alias("dealt"))
    placed = twice.select(F.explode("dealt").alias("x")).select("x.*")
    return placed.select((F.col("version") + 1).alias("version"), "vslot", (-F.col("minus")).alias("bytes"), F.col("was").alias("shard"))


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` with one shard more than ``shards``: each old shard hands over its smallest
    slots up to an equal share of its bytes, to the new shard only. All other slots stay."""
    by_size = Window.partitionBy("shard").orderBy("bytes", "vslot")
    before = F.coalesce(F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    share = F.sum("bytes").over(Window.partitionBy("shard")) / F.lit(shards + 1)
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", "bytes", F.when(before <= share, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def known_map(loads: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """The last version of a stored ``slot_map`` with the present loads; slots that it lacks are dealt out in turn."""
    last = slot_map.where(F.col("version") == F.lit(slot_map.agg(F.max("version")).first()[0])).select("vslot", "shard", "version")
    dealt = loads.join(F.broadcast(last), "vslot", "left")  # at most one row a slot
    version = F.coalesce("version", F.max("version").over(Window.partitionBy()))
    return dealt.select(version.alias("version"), "vslot", "bytes", F.coalesce("shard", F.pmod("vslot", F.lit(shards)).cast("int")).alias("shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, slots: int = SLOTS, slot_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (id, size, crc, vslot, shard, place) and the versions of the slot map (version, vslot, bytes, shard), a
    stored table: the one before, from ``slot_map`` if given, and its edit.

    ``place`` numbers the rows of a shard from 0 without gaps: slot by slot, within a slot by id.
    """
    rows = stash(records(docs, id_col, text_col, slots), "records")
    loads = slot_bytes(rows)
    first = first_map(loads, shards) if slot_map is None else known_map(loads, slot_map, shards)
    versions = stash(first.unionByName(rebalanced(first, shards)), "slotmap")
    last = versions.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))
    placed = rows.join(F.broadcast(last), "vslot")  # a row a slot
    numbered = gapless(placed, ["shard"], "vslot", [F.col("id").asc_nulls_first(), F.col("crc"), F.col("size")], "place")
    return numbered.select("id", "size", "crc", "vslot", "shard", "place"), versions
