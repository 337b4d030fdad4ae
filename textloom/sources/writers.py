"""Results as text: CoNLL, JSON documents, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.readers import CONLL


def to_conll(rows: DataFrame, key: str = "sent_id") -> DataFrame:
    """A row (key, conll) for each sentence, from rows with an ``id`` and any of the CoNLL columns."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in rows.columns else F.lit("_")
    line = F.concat_ws("\t", *[cell(c) for c in CONLL])
    by = F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(by, lambda x: x["line"]), "\n").alias("conll"))


def to_documents(meta: DataFrame, key: str = "doc_id", **tables: DataFrame) -> DataFrame:
    """One JSON document a row: the columns of ``meta`` and, nested, the rows of each table of the same key."""
    out = meta
    for name, table in tables.items():
        columns = [c for c in table.columns if c != key]
        nested = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(nested, key, "left").withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), nested.schema[name].dataType)))
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("document"))


def to_markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))


def to_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON-RPC to (id, method, tool, text, error): unknown methods and bad JSON get their codes."""
    parsed = F.from_json(value, "jsonrpc string, id string, method string, params struct<name:string,arguments:struct<text:string,mode:string>>")
    p = lines.select(parsed.alias("p"))
    tools = ["analyze_text", "summarize_text", "generate_title"]
    method, tool = F.col("p.method"), F.col("p.params.name")
    error = F.when(method.isNull(), -32603).when(~method.isin("initialize", "tools/list", "tools/call"), -32601).when((method == "tools/call") & ~F.coalesce(tool.isin(*tools), F.lit(False)), -32602)
    return p.select(F.col("p.id").alias("id"), method.alias("method"), tool.alias("tool"), F.col("p.params.arguments.text").alias("text"), error.alias("error"))
