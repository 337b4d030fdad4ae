import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import batches, text
from textloom.operators import dictionaries


def test_slices_are_small_and_lose_no_row():
    seen = []

    def of(a, b):
        seen.append(len(a))
        return pa.array([f"{x}{y}" for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    a = pa.array([*map(str, range(1000)), None])
    assert batches.sliced(of, a, a).to_pylist() == [f"{x}{x}" for x in a.to_pylist()] and max(seen) == batches.ROWS
    assert len(batches.sliced(of, a.slice(0, 0), a.slice(0, 0))) == 0


def test_all_rows_of_a_batch_come_back(spark):
    docs = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("One. Two the "), F.col("id").cast("string"))).alias("text"))
    for made in (text.split_sentences(F.col("text")), dictionaries.forced(F.col("text"), {"the"})):
        rows = docs.select("id", "text", made.alias("p")).collect()
        assert len(rows) == 300 and all((r["p"] is None) == (r["text"] is None) for r in rows)
        assert all(r["text"][p["start"] : p["end"]] == p["text"] for r in rows if r["p"] for p in r["p"])
