"""Readers of annotated corpora: one row a token or span, sentences kept whole while they are parsed.

Sentences that blank lines separate are put together from lines, so a file of any size is split into many tasks and no file
is a single row; lines may end as on any system, and a line of white space is blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONLL = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, sent_id, block) of what stands between blank lines, numbered from 0 within each file.

    Lines are numbered within their split of the file; a small table of the splits tells how many sentences come before.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")]
    rows = spark.read.text(path).select(*meta, "value").withColumn("blank", F.trim(F.regexp_replace("value", r"[\r\t]", "")) == "")
    order = Window.partitionBy("file", "split").orderBy("line")
    rows = rows.withColumn("first", ~F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(True)))
    rows = rows.withColumn("number", F.sum(F.col("first").cast("long")).over(order))
    splits = rows.groupBy("file", "split").agg(F.max("number").alias("n"), F.min_by("blank", "line").alias("head"), F.max_by("blank", "line").alias("tail"))
    by_file = Window.partitionBy("file").orderBy("split")
    goes_on = (~F.col("head") & ~F.coalesce(F.lag("tail").over(by_file), F.lit(True))).cast("long")
    splits = splits.withColumn("goes_on", goes_on)
    before = F.coalesce(F.sum(F.col("n") - F.col("goes_on")).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before - F.col("goes_on") - 1).alias("before"))
    found = rows.where("not blank").join(splits, ["file", "split"]).groupBy("file", (F.col("number") + F.col("before")).alias("sent_id"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("split", "line", "value"))), lambda x: x["value"])
    return found.agg(F.array_join(in_order, "\n").alias("block"))


def lines(block: Column) -> Column:
    return F.filter(F.split(block, "\r?\n"), lambda s: F.trim(s) != "")


def read_conll(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CoNLL-X and CoNLL-U: rows (file, sent_id, the columns). Comments, ranges such as 1-2 and empty nodes such as 8.1 are skipped."""
    names = columns or CONLL
    rows = blocks(spark, path).select("file", "sent_id", F.posexplode(lines(F.col("block"))).alias("line", "value")).where(~F.startswith("value", F.lit("#")))
    parts = F.split("value", r"\t| {2,}")
    out = rows.select("file", "sent_id", *[F.when(F.try_element_at(parts, F.lit(i + 1)) != "_", F.try_element_at(parts, F.lit(i + 1))).alias(n) for i, n in enumerate(names)])
    out = out.where(F.col("id").rlike(r"^\d+$")).withColumn("id", F.col("id").cast("int"))
    return out.withColumn("head", F.expr("try_cast(head as int)")) if "head" in names else out


def read_tagged(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Two columns a line, a blank line between sentences: rows (file, sent_id, tok_idx, token, tag)."""
    rows = blocks(spark, path).select("file", "sent_id", F.posexplode(lines(F.col("block"))).alias("tok_idx", "value"))
    parts = F.split("value", separator)
    return rows.select("file", "sent_id", "tok_idx", F.element_at(parts, 1).alias("token"), F.element_at(parts, -1).alias("tag"))


def read_tokenized(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """A sentence a line, its tokens separated: rows (sent_id, tokens)."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.monotonically_increasing_id().alias("sent_id"), F.filter(F.split("value", separator), lambda t: t != "").alias("tokens"))


NER_SCHEMA = "doc_key string, sentences array<array<string>>, ner array<array<array<string>>>, srl array<array<array<string>>>, clusters array<array<array<int>>>"


def read_json_spans(spark: SparkSession, path: str, field: str = "ner", rename: dict[str, str] | None = None, only: list[str] | None = None) -> DataFrame:
    """JSON lines of documents with sentences and spans counted through the document: rows (doc_key, sent_idx, start,
    end, label), counted within the sentence, end exclusive, each span once."""
    rows = spark.read.schema(NER_SCHEMA).json(path)
    offsets = F.transform(F.sequence(F.lit(1), F.size("sentences")), lambda i: F.aggregate(F.slice("sentences", 1, i - 1), F.lit(0), lambda a, s: a + F.size(s)))
    rows = rows.select("doc_key", F.posexplode(F.arrays_zip(F.col(field).alias("spans"), offsets.alias("offset"))).alias("sent_idx", "z"))
    rows = rows.select("doc_key", "sent_idx", "z.offset", F.explode("z.spans").alias("s"))
    label = F.element_at("s", -1)
    out = rows.select("doc_key", "sent_idx", (F.element_at("s", 1).cast("int") - F.col("offset")).alias("start"), (F.element_at("s", 2).cast("int") - F.col("offset") + 1).alias("end"), label.alias("label"))
    if only:
        out = out.where(F.col("label").isin(*only))
    if rename:
        out = out.replace(rename, subset=["label"])
    return out.distinct()


def read_table(spark: SparkSession, path: str, separator: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.option("sep", separator).option("header", header).csv(path)


def read_backwards(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text, the last first, with their number by place."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return rows.orderBy(F.col("place").desc())


def split_rows(rows: DataFrame, key: str, shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> list[DataFrame]:
    """Disjoint parts by a hash of ``key``, the same in every run."""
    unit = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out, low = [], 0.0
    for i, s in enumerate(shares):
        high = 1.0 + 1e-9 if i == len(shares) - 1 else low + s
        out.append(rows.where((unit >= low) & (unit < high)))
        low = high
    return out


def k_folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(k)).cast("int"))


def read_dictionary(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """Dictionary layers from text files of ``keyword<TAB>category<TAB>confidence`` lines, in order of growing precedence:
    rows (keyword, category, confidence, layer)."""
    out = None
    for i, (name, path) in enumerate(layers.items()):
        rows = spark.read.option("sep", "\t").schema("keyword string, category string, confidence double").csv(path)
        rows = rows.where("keyword is not null and keyword not like '#%'").withColumn("layer", F.lit(i)).withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of whole files, to check dictionaries against their metadata."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("length"), F.md5("content").alias("md5"))
