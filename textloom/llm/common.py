"""Helpers that the corpus operators share: tables written to the cluster's shared folder, Arrow maps, gapless
numbering without a large group in one task, and connected components by alternating stars."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a local one, if there are no other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"file://{FALLBACK_DIR}").rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a context; they need not share the driver's folders."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    context._textloom_shipped = True


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = per_batch(batch)
            if out is not None and out.num_rows:
                yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Caches that live as long as a worker process.
CACHES: list[dict] = []


def sole_cache(cache: dict | None) -> None:
    """Empty the worker's other caches, which earlier operators filled, and give their memory back."""
    old = [c for c in CACHES if c is not cache and c]
    for c in old:
        c.clear()
    pa.default_memory_pool().release_unused()
    if old:
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def sliced(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` that hold about ``most`` bytes of ``column`` each, or one row."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.large_binary())]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gapless(df: DataFrame, group: list[str], cell: str, order: list[Column], out: str, totals: str | None = None) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps.

    ``cell`` splits each group into parts that one task can sort: rows are numbered within (group, cell), and each
    cell starts where the cells before it end. The table of cells is small: groups times cells. ``totals`` names an
    optional column for the size of the group. Keys may be null; they form a group of their own.
    """
    keys = [*group, cell]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(F.col(cell).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        *([F.sum("__n").over(Window.partitionBy(*group)).alias(totals)] if totals else []),
    )
    numbered = df.withColumn("__in_cell", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(starts, on)
    return joined.withColumn(out, (F.col("__start") + F.col("__in_cell") - 1).cast("long")).drop(
        "__in_cell", "__start", *[f"__k{i}" for i in range(len(keys))]
    )


#: A node with more neighbours is told to all tasks, where joins are merges.
MANY = 256


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "stars", merge: bool = False) -> DataFrame:
    """Connected components of an undirected graph: a row (node, component) for each node of an edge between two
    different nodes, component being the smallest node reachable.

    Alternating large-star and small-star steps; each step aggregates a minimum per node (combined before the
    shuffle) and joins it back, so no node's neighbours are gathered in one place. Every round is written to the
    shared folder. Null ends and loops are ignored. With ``merge`` the tables of nodes are not collected by the driver to
    be broadcast, but for the few nodes with many neighbours, whose rows would meet in one task.
    """

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if not merge:
            return rows.join(least.drop("n"), "u")
        known = rows.join(F.broadcast(least.where(F.col("n") > MANY).select("u", F.col("m").alias("told"))), "u", "left")
        rest = known.where("told is null").drop("told").join(least.where(F.col("n") <= MANY).drop("n").hint("merge"), "u")
        return known.where("told is not null").withColumnRenamed("told", "m").unionByName(rest)

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stash(pairs, name)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stash(small.where("u <> v").distinct(), name)
        # done when every node that has a smaller one has just that one, which has none
        ends = now.selectExpr("u as node", "1 as up", "0 as down").unionByName(now.selectExpr("v as node", "0 as up", "1 as down"))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
