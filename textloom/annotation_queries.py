"""Queries of the operators on annotations, decoders and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import derived
from textloom import fixtures as fx
from textloom.functions import text
from textloom.operators import annotations, decoding, dictionaries, metrics, modifiers
from textloom.queries import docs, query, table

WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')"


@query(derived.with_tables("entities", "tokens") + """ SELECT e.doc_id, e.entity_id, CAST(min(tok_idx) AS INTEGER) AS tok_start, CAST(max(tok_idx) + 1 AS INTEGER) AS tok_end FROM entities e LEFT JOIN tokens t ON t.doc_id = e.doc_id AND t.start < e."end" AND t."end" > e.start GROUP BY ALL""")
def entity_token_spans(spark, sf_dir):
    found = annotations.token_spans(derived.frame(spark, sf_dir, "entities"), derived.frame(spark, sf_dir, "tokens"))
    return found.select("doc_id", "entity_id", F.col("tok_start").cast("int"), F.col("tok_end").cast("int"))


@query(
    """WITH o AS (SELECT item_id, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 2) = 'th')) AS i FROM benchmark),
best AS (SELECT item_id, i FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY abs(i + 1 - 105.0), i) = 1)
SELECT item_id, CAST(coalesce(i, 0) AS INTEGER) AS start, CAST(coalesce(i + 2, 0) AS INTEGER) AS "end" FROM benchmark LEFT JOIN best USING (item_id)"""
)
def nearest_occurrences(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", annotations.nearest_span(F.col("text"), F.lit("th"), F.lit(100), F.lit(110)).alias("s")).select("item_id", "s.start", "s.end")


TAGS = ["名詞,地名", "名詞,人名", "名詞,官職名", "名詞,一般名詞,動物", "名詞,固有名詞", "動詞", "地名", "人名", "名詞,制度", "官名", "名詞,天文", "", "名詞,朝代", "固定物", "名詞,固定物", "名詞,人,姓"]
CATEGORIES = ["LOCATION", "PERSON", "TITLE", "UNKNOWN", "LOCATION", None, "LOCATION", "PERSON", "INSTITUTION", "TITLE", "ASTRONOMY", None, "ERA", None, "LOCATION", None]
NAMES = {"清华大学": "ORGANIZATION", "社会": "UNKNOWN", "海淀区": "LOCATION", "智能手机": "PRODUCT", "北京大街": "LOCATION", "有限": "UNKNOWN", "阿里巴巴": "UNKNOWN", "省城市区": "LOCATION", "软件中心": "ORGANIZATION"}


def as_values(rows) -> str:
    """Numbered values of SQL."""
    quote = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(rows))


def picked(spark, sf_dir, values):
    """One of the values for each line of an order, by its part."""
    which = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("part") % len(values) + 1).cast("int"))
    return derived.frame(spark, sf_dir, "order_lines").select("doc_id", "line", which.alias("said"))


@query(f"{derived.with_tables('order_lines')}, t(i, said, category) AS (VALUES {as_values(zip(TAGS, CATEGORIES, strict=True))}) SELECT doc_id, line, said, category FROM order_lines JOIN t ON i = part % {len(TAGS)}")
def xpos_categories(spark, sf_dir):
    """Against categories worked out by hand, a tag for each line of an order."""
    return picked(spark, sf_dir, TAGS).withColumn("category", annotations.xpos_category(F.col("said")))


@query(f"{derived.with_tables('order_lines')}, t(i, said, category) AS (VALUES {as_values(NAMES.items())}) SELECT doc_id, line, said, category FROM order_lines JOIN t ON i = part % {len(NAMES)}")
def suffix_categories(spark, sf_dir):
    """Against categories worked out by hand, a name for each line of an order."""
    return picked(spark, sf_dir, list(NAMES)).withColumn("category", annotations.suffix_category(F.col("said")))


@query(
    """WITH r AS (SELECT o_orderkey, round(o_totalprice % 1, 3) AS c, CASE o_orderkey % 3 WHEN 0 THEN 'srl/x' WHEN 1 THEN 'bridge/y' ELSE 'dep' END AS source, o_orderkey % 2 = 0 AS s, o_orderkey % 5 = 0 AS o, o_custkey % 20 AS n FROM orders),
b AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN greatest(c, 0.65) WHEN 1 THEN least(c, 0.5) ELSE c END AS base FROM r),
e AS (SELECT *, CASE WHEN s AND o THEN least(1.0, base + 0.05) WHEN s OR o THEN least(1.0, base + 0.02) ELSE base END AS ends FROM b)
SELECT o_orderkey, CAST(round(CASE WHEN n <= 10 THEN least(1.0, ends + 0.03) ELSE ends END, 6) AS DOUBLE) AS confidence FROM e"""
)
def relation_confidences(spark, sf_dir):
    key = F.col("o_orderkey")
    source = F.when(key % 3 == 0, "srl/x").when(key % 3 == 1, "bridge/y").otherwise("dep")
    found = annotations.dynamic_confidence(F.round(F.col("o_totalprice") % 1, 3), source, F.when(key % 2 == 0, "s"), F.when(key % 5 == 0, "o"), F.lit(0), F.col("o_custkey") % 20)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(found, 6).alias("confidence"))


SCORES = """n AS (SELECT sent_id, {fields}, count(*) AS n FROM gold GROUP BY ALL), m AS (SELECT sent_id, {fields}, count(*) AS n FROM found GROUP BY ALL),
b AS (SELECT sent_id, sum(least(coalesce(n.n, 0), coalesce(m.n, 0))) AS m, sum(coalesce(n.n, 0)) AS g, sum(coalesce(m.n, 0)) AS p FROM n FULL JOIN m USING (sent_id, {fields}) GROUP BY sent_id)
SELECT '{kind}' AS kind, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS found, round(sum(m) / sum(p), 6) AS "precision", round(sum(m) / sum(g), 6) AS recall, round(2 * sum(m) / (sum(g) + sum(p)), 6) AS f1, round(avg(CAST(m = g AND m = p AS INTEGER)), 6) AS complete FROM b"""


def both_scores(tables: str, labelled: str, unlabelled: str) -> str:
    part = lambda fields, kind: f"SELECT * FROM (WITH {tables}, {SCORES.format(fields=fields, kind=kind)})"
    return f"{part(labelled, 'labelled')} UNION ALL {part(unlabelled, 'unlabelled')}"


def rounded(found):
    return found.select("kind", "matches", "gold", "found", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "complete")])


@query(both_scores('gold AS (SELECT l_orderkey AS sent_id, l_linenumber // 2 AS start, l_linenumber AS "end", l_returnflag AS label FROM lineitem), found AS (SELECT l_orderkey AS sent_id, l_linenumber // 2 AS start, l_linenumber AS "end", CASE WHEN l_quantity > 40 THEN \'N\' ELSE l_returnflag END AS label FROM lineitem WHERE l_quantity > 5)', 'start, "end", label', 'start, "end"'))
def bracket_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sent_id"), F.expr("l_linenumber div 2").alias("start"), F.col("l_linenumber").alias("end"), F.col("l_returnflag").alias("label"), "l_quantity")
    found = rows.where("l_quantity > 5").withColumn("label", F.when(F.col("l_quantity") > 40, "N").otherwise(F.col("label")))
    return rounded(metrics.bracket_scores(rows, found, rows.count()))


@query(both_scores("gold AS (SELECT l_orderkey AS sent_id, l_linenumber AS child, l_linenumber - 1 AS head, l_linestatus AS rel FROM lineitem), found AS (SELECT l_orderkey AS sent_id, l_linenumber AS child, CASE WHEN l_quantity < 10 THEN 0 ELSE l_linenumber - 1 END AS head, l_linestatus AS rel FROM lineitem)", "child, head, rel", "child, head"))
def arc_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("child"), (F.col("l_linenumber") - 1).alias("head"), F.col("l_linestatus").alias("rel"), "l_quantity")
    return rounded(metrics.arc_scores(rows, rows.withColumn("head", F.when(F.col("l_quantity") < 10, 0).otherwise(F.col("head"))), rows.count()))


@query(
    """WITH s AS (SELECT label % 8 AS gold, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), r AS (SELECT len(list_filter(range(1, 9), lambda i: v[i] > v[gold + 1] OR (v[i] = v[gold + 1] AND i < gold + 1))) AS better FROM s)
SELECT round(avg(CAST(better < 3 AS INTEGER)), 6) AS accuracy, count(*) AS n FROM r"""
)
def top_three_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 8).alias("gold"), F.slice("embedding", 1, 8).cast("array<double>").alias("scores"))
    return metrics.top_k_accuracy(rows, 3).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query("""SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS INTEGER) AS child, CAST(l_linenumber - 2 AS INTEGER) AS head, l_returnflag AS rel FROM lineitem""")
def dependency_rows(spark, sf_dir):
    arcs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.struct((x["l_linenumber"] - 1).alias("head"), x["l_returnflag"].alias("rel")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(arcs.alias("dep"))
    return annotations.dependencies(rows).select("doc_id", "child", F.col("head").cast("int"), "rel")


@query(
    rf"""WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), t AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, w FROM w)
SELECT conv_id AS doc_id, turn AS seg_idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INTEGER) AS tok_idx, w[i] AS text FROM t"""
)
def token_numbers(spark, sf_dir):
    w = F.posexplode(text.words(F.col("text"))).alias("tok_idx", "text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_idx"), w)
    return annotations.renumbered(rows)


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(text, 'tion|the|th|une|der'), ' ')) AS known, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def dictionary_pieces(spark, sf_dir):
    """Longest matches; the pieces cover the text."""
    p = dictionaries.forced(F.col("text"), {"the", "th", "tion", "une", "der"})
    rows = docs(spark, sf_dir).select("doc_id", p.alias("p"))
    known = F.array_join(F.transform(F.filter("p", lambda x: x["known"]), lambda x: x["text"]), " ")
    return rows.select("doc_id", F.md5(known).alias("known"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("n_chars"))


@query(rf"SELECT doc_id, md5(array_to_string(list_transform({WORDS}, lambda w: CASE w WHEN 'the' THEN 'DT' WHEN 'and' THEN 'CC' WHEN 'und' THEN 'CC' ELSE 'X' END), ' ')) AS tags FROM documents")
def tag_overrides(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", text.words(F.col("text")).alias("w"))
    tags = dictionaries.overridden(F.col("w"), F.transform("w", lambda _: F.lit("X")), {"the": "DT", "and": "CC", ("und",): ("CC",)})
    return rows.select("doc_id", F.md5(F.array_join(tags, " ")).alias("tags"))


@query(rf"SELECT DISTINCT w AS form, lower(w[1:1]) || w[2:length(w) - 2] AS lemma FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents) WHERE length(w) > 4")
def lemmas_by_rule(spark, sf_dir):
    """Rules made of pairs of form and lemma, applied to the forms again."""
    w = F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("form")
    rows = docs(spark, sf_dir).select(w).where("length(form) > 4").distinct()
    want = F.concat(F.lower(F.substring("form", 1, 1)), F.expr("substring(form, 2, length(form) - 3)"))
    return rows.select("form", decoding.lemma(F.col("form"), decoding.lemma_rule(F.col("form"), want, True)).alias("lemma"))


@query()
def tag_paths(spark, sf_dir):
    """Best tag sequences of a chain model over slices of the vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 4 + 1, 4)).cast("array<array<double>>").alias("e"))
    return rows.select("vec_id", decoding.viterbi(F.col("e"), [[0.5, -0.5, 0, 0], [-0.5, 0.5, 0, 0], [0, 0, 0.2, 0], [0.1, 0, 0, 0]]).alias("tags"))


@query()
def dependency_trees(spark, sf_dir):
    """Best projective trees, and whether they are trees, of scores from the vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice("embedding", i * 5 + 1, 5)).cast("array<array<double>>").alias("s"))
    heads = decoding.dependency_heads(F.col("s"))
    return rows.select("vec_id", heads.alias("heads"), decoding.is_tree(heads).alias("tree"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text[91:210], 'tion|the|and|der|le'), ' ') AS words FROM documents")
def span_modifiers(spark, sf_dir):
    """Words around one span a document, characters 100 to 200."""
    found = modifiers.modifiers(F.col("text"), F.lit(100), F.lit(200), {"degree": ["the", "and"], "scope": ["tion", "der", "le", "the"]})
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(found, lambda m: m["text"]), " ").alias("words"))
