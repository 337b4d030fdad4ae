import zlib
from collections import Counter

from textloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size int, vslot int"


def run(spark, texts, ids=None, **more):
    rows = [(i if ids is None else ids[i], t, "x", 1, 2) for i, t in enumerate(texts)]
    got, versions = sharding.shard(spark.createDataFrame(rows, SCHEMA), **more)
    return got.collect(), versions.collect()


def test_whole_and_balanced(spark):
    texts = [None, "", "é" * 3000] + [f"text {i} " * (i % 37) for i in range(3000)] + ["same"] * 1500
    got, versions = run(spark, texts)
    assert sorted(r.id for r in got) == list(range(len(texts)))
    for r in got:
        t = (texts[r.id] or "").encode()
        assert (r.size, r.crc) == (len(t) + 1, zlib.crc32(t))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= 0.01 * max(loads.values())
    for s in range(8):
        assert sorted(r.place for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    last = {r.vslot: r.shard for r in versions if r.version == 1}
    assert all(last[r.vslot] == r.shard for r in got) and {r.version for r in versions} == {0, 1}


def test_grown_map_moves_only_into_the_new_shard(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    first = sharding.first_map(sharding.slot_bytes(sharding.records(rows)), 8)
    new = {r.vslot: r.shard for r in sharding.grown(first, 8).collect()}
    old = {r.vslot: r.shard for r in first.collect()}
    moved = [k for k in old if old[k] != new[k]]
    assert moved and all(new[k] == 8 for k in moved)
    loads = Counter()
    for r in sharding.grown(first, 8).collect():
        loads[r.shard] += r.bytes
    assert max(loads.values()) < 1.2 * min(loads.values())


def test_few_null_repeated_and_no_rows(spark):
    got, _ = run(spark, ["a", "a", None, None, "b"], [1, 1, None, None, 2])
    assert len(got) == 5 and sorted(r.size for r in got) == [1, 1, 2, 2, 2]
    assert run(spark, []) == ([], [])


def test_edits_move_few_slots(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    more = rows.unionByName(spark.range(20000, 21000).selectExpr("id as doc_id", "repeat('y', 30) as text"))
    _, versions = sharding.shard(rows)
    got, later = sharding.shard(more, slot_map=versions)
    first = {r.vslot: r.shard for r in versions.where("version = 1").collect()}
    second = {r.vslot: r.shard for r in later.where("version = 2").collect()}
    assert sum(first[k] != second[k] for k in first) < 0.02 * len(first)
    dealt = {r.vslot: r.shard for r in versions.where("version = 0").collect()}
    assert sum(first[k] != dealt[k] for k in first) < 0.1 * len(first)
    loads = Counter()
    for r in got.collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.005 * max(loads.values())
    _, fewer = sharding.shard(more, shards=6, slot_map=versions)
    assert {r.shard for r in fewer.where("version = 2").collect()} == set(range(6))
