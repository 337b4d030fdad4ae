from pyspark.sql import functions as F

from textloom.operators import relations


def test_the_nearest_anchor_is_found_without_pairs(spark):
    pronouns = spark.createDataFrame([("d", 1, 10, "x"), ("d", 2, 3, "x"), ("d", 3, 10, "y"), ("e", 4, 10, "x"), ("d", 5, None, "x")], "doc_id string, mention_id int, start int, kind string")
    anchors = spark.createDataFrame([("d", 7, 10, "x"), ("d", 8, 4, "x"), ("d", 9, 11, "x"), ("d", 6, 10, "x"), ("d", 5, None, "y")], "doc_id string, anchor_id int, end int, kind string")
    found = relations.nearest_before(pronouns, anchors)
    assert {(r["mention_id"], r["anchor_id"]) for r in found.collect()} == {(1, 7), (2, None), (3, None), (4, None), (5, None)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_of_one_kind(spark):
    rows = spark.range(60000).select(F.lit("d").alias("doc_id"), F.col("id").alias("n"), F.lit(0).alias("kind"))
    pronouns, anchors = rows.select("doc_id", F.col("n").alias("mention_id"), (F.col("n") * 2).alias("start"), "kind"), rows.select("doc_id", F.col("n").alias("anchor_id"), (F.col("n") * 2).alias("end"), "kind")
    assert relations.nearest_before(pronouns, anchors).where("anchor_id = mention_id").count() == 60000
