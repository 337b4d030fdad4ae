"""Entities: quality gates, numbers and dates, negation, conflicts, containment, duplicates, dictionary look-ups.

An entity table has at least (doc_id, entity_id, text, category, start, end, source, confidence). Per-document joins have
``doc_id`` in their key. What depends on order is a fold over the entities of one document, which one document bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spans, text
from textloom.operators.gathering import bound, each, gathered, has

# Categories.
CATEGORIES = ["PERSON", "ORGANIZATION", "LOCATION", "FACILITY", "PRODUCT", "DATE", "NUMBER", "MATERIAL", "STANDARD", "PARAMETER", "SECTION_REF", "UNKNOWN", "TITLE", "ERA", "INSTITUTION", "ASTRONOMY"]
NUMERIC = ["NUMBER", "STANDARD", "PARAMETER", "UNKNOWN"]
SECTION_PATTERNS = [r"\d+\.\d+", r"第\s*\d+", r"\d+\s*章", r"\d+\s*节", r"\d+\s*条"]


@dataclass(frozen=True)
class QualityPolicy:
    section_patterns: tuple[str, ...] = tuple(SECTION_PATTERNS)
    demote_bare_numbers: bool = True
    gates: bool = True
    least: float = 0.6
    least_by_source: dict[str, float] = field(default_factory=dict)
    demoted: tuple[str, ...] = ("NUMBER", "STANDARD", "PRODUCT", "UNKNOWN")
    keywords_must_be_given: bool = True


def with_quality(entities: DataFrame, policy: QualityPolicy = QualityPolicy(), given: list[str] | None = None) -> DataFrame:
    """``entities`` with keep, filter, filter_reason, and the category of section references changed.

    Shape comes first: a section reference is relabelled and then exempt from the bare-number rule; evidence and
    confidence follow for what is still kept. One case chain, no shuffle.
    """
    t, category, source, confidence = F.col("text"), F.col("category"), F.col("source"), F.col("confidence")
    section = category.isin(*NUMERIC) & t.rlike("|".join(f"(?:{p})" for p in policy.section_patterns)) if policy.section_patterns else F.lit(False)
    category = F.when(section, "SECTION_REF").otherwise(category)
    bare = F.lit(policy.demote_bare_numbers) & (category == "NUMBER") & text.strip(t).rlike(r"^\d{1,4}$")
    injected = t.isin(*given) if given else F.lit(False)
    standard, unit = text.is_standard_code(t), text.has_unit(t)
    numeric = unit | (F.startswith(source, F.lit("numeric/")) & ((source != "numeric/date") | text.is_date(t)))
    keyword = F.lit(policy.keywords_must_be_given) & F.startswith(source, F.lit("keyword")) & ~injected
    least = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in policy.least_by_source.items()], F.lit(policy.least))
    gated = category.isin(*policy.demoted)
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    reason = (
        F.when(bare, F.concat(F.lit("bare number '"), t, F.lit("' (no unit/context)")))
        .when(F.lit(not policy.gates), F.lit(None))
        .when(keyword, F.concat(F.lit("keyword '"), t, F.lit("' not in injected entity_categories")))
        .when(~gated, F.lit(None))
        .when((category == "NUMBER") & ~numeric, F.concat(F.lit("NUMBER not corroborated (source="), source, F.lit(")")))
        .when((category == "STANDARD") & ~(standard | injected), F.lit("STANDARD not corroborated (no standard-code match / not injected)"))
        .when((category == "PRODUCT") & ~((confidence >= 0.85) | injected), F.concat(F.lit("PRODUCT not corroborated (confidence "), two(confidence), F.lit(" < 0.85)")))
        .when((category == "UNKNOWN") & ~(unit | standard | (confidence >= 0.75) | injected), F.concat(F.lit("UNKNOWN not corroborated (confidence "), two(confidence), F.lit(" < 0.75)")))
        .when(unit | standard, F.lit(None))
        .when(confidence < least, F.concat(F.lit("confidence "), two(confidence), F.lit(" < "), two(least), F.lit(" ("), source, F.lit(")")))
    )
    which = F.when(bare, "F1_shape").when(reason.isNotNull(), "F2_confidence")
    return entities.select(*[category.alias(c) if c == "category" else F.col(c) for c in entities.columns], reason.isNull().alias("keep"), which.alias("filter"), reason.alias("filter_reason"))


# What counts as a number, in order of precedence; units in order of trial.
SCALES = "万|亿|千万"
UNITS = "万|亿|千万|个|件|台|辆|艘|张|把|支|根|条|块|片|份|次|回|月|天|小时|分钟|秒|米|公里|厘米|毫米|克|千克|吨|升|毫升|度|摄氏度|人|口|家|所|座|栋|页|章|节|篇|首|幅|部|集|卷|册|本|期|班|组|队|团|军|师|营|连|排|名|位"
NUMBER_PATTERNS = [
    ("numeric/date", r"\d{4}年(?:\d{1,2}月)?(?:\d{1,2}日)?"),
    ("numeric/date", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"),
    ("numeric/date", r"\d{4}\.\d{1,2}\.\d{1,2}"),
    ("numeric/date", r"(?<!\d)\d{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)"),
    ("numeric/currency", rf"\d+(?:\.\d+)?(?:{SCALES})?(?:元|美元|欧元|英镑|日元|人民币|万元|亿美元)"),
    ("numeric/currency", rf"[¥$€£]\d+(?:\.\d+)?(?:{SCALES})?"),
    ("numeric/percentage", r"\d+(?:\.\d+)?%"),
    ("numeric/quantity", rf"\d+(?:\.\d+)?(?:{UNITS})"),
]


def pattern_spans(c: Column, pattern: str) -> Column:
    """Structs (text, start, end) of all matches, in code points: the lengths of what is between them add up."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    # what is between the matches, by splitting at them; with lookarounds a match may need its context, which split has too
    between = F.split(c, pattern, -1)
    start = F.struct(F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(pair["hit"].alias("text"), begin.alias("start"), end.alias("end")))).alias("out"), end.alias("at"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: list[tuple[str, str]] | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Dates, amounts of money, percentages and quantities: rows (doc_id, text, start, end, source, normalized, category, confidence).

    Patterns are tried in order; a match that overlaps an earlier one, or one of the spans ``taken`` (doc_id, start, end), is
    left out. One fold over all matches of a text.
    """
    kind = "array<struct<text:string,start:int,end:int,source:string>>"

    def labelled(source: str, pattern: str) -> Column:
        return F.transform(pattern_spans(F.col(text_col), pattern), lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(source).alias("source")))

    every = F.concat(*[labelled(*p) for p in patterns or NUMBER_PATTERNS])
    if taken is not None:
        own = taken.groupBy(F.col("doc_id").alias(id_col)).agg(F.collect_list(F.struct("start", "end")).alias("__taken"))
        docs = docs.where(F.col(text_col).rlike(r"\d")).join(own, id_col, "left")
        every = F.filter(every, lambda m: ~F.exists(F.coalesce("__taken", F.array().cast(own.schema["__taken"].dataType)), lambda o: (m["start"] < o["end"]) & (m["end"] > o["start"])))
    kept = F.aggregate(every, F.array().cast(kind), lambda acc, m: F.when(F.exists(acc, lambda o: (m["start"] < o["end"]) & (m["end"] > o["start"])), acc).otherwise(F.concat(acc, F.array(m))).cast(kind))
    found = docs.where(F.col(text_col).rlike(r"\d")).select(F.col(id_col).alias("doc_id"), F.explode(kept).alias("m")).select("doc_id", "m.text", "m.start", "m.end", "m.source")
    normal = F.when(F.col("source") == "numeric/date", text.normal_date(F.col("text"))).otherwise(F.col("text"))
    return found.select("*", normal.alias("normalized"), F.lit("NUMBER").alias("category"), F.lit(0.75).alias("confidence"))


# Negation words.
NEGATIONS = ["没有", "不曾", "未尝", "未始", "未能", "不", "没", "未", "非", "无", "勿", "别", "莫", "弗", "毋", "罔", "微"]
SCOPE, NEGATED = 20, 0.7


def negations(docs: DataFrame, wanted: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end) of the negation words, longest first at each place."""
    pattern = "|".join(sorted(wanted or NEGATIONS, key=lambda w: -len(w)))
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(pattern_spans(F.col(text_col), pattern)).alias("m"))
    return found.select("doc_id", "m.start", "m.end")


def with_negation(rows: DataFrame, negation_rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``rows`` with is_negated and a lowered confidence where a negation ends at most ``scope`` characters before. The
    nearest one before decides: a range join, reduced to one row an end by grouping."""
    ends = negation_rows.groupBy("doc_id").agg(F.collect_set("end").alias("__ends"))
    near = F.exists(F.coalesce("__ends", F.array().cast("array<int>")), lambda e: (F.col("start") >= e) & (F.col("start") - e <= scope))
    out = rows.join(ends, "doc_id", "left").withColumn("is_negated", near).drop("__ends")
    return out.withColumn("confidence", F.when(F.col("is_negated"), F.col("confidence") * NEGATED).otherwise(F.col("confidence")))


def hierarchy(entities: DataFrame) -> DataFrame:
    """``entities`` with parent_entity_id: the shortest entity of the same category that contains them and is longer."""
    p = entities.select("doc_id", "category", F.col("entity_id").alias("p_id"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("confidence").alias("p_conf"), F.col("text").alias("p_text"))
    inside = entities.join(p, ["doc_id", "category"]).where(spans.contains(F.col("ps"), F.col("pe"), F.col("start"), F.col("end")) & (F.col("p_id") != F.col("entity_id")))
    best = inside.groupBy("doc_id", "entity_id").agg(F.min(F.struct((F.col("pe") - F.col("ps")).alias("n"), "p_id", "p_text", "p_conf")).alias("p"))
    return entities.join(best, ["doc_id", "entity_id"], "left").select(*entities.columns, F.col("p.p_id").alias("parent_entity_id"), F.col("p.p_text").alias("parent_text"), F.least("confidence", "p.p_conf").alias("part_of_confidence"))


def part_of(with_parents: DataFrame) -> DataFrame:
    """PART_OF relations from the result of ``hierarchy``."""
    return with_parents.where("parent_entity_id is not null").select(
        "doc_id", F.col("text").alias("subject"), F.lit("PART_OF").alias("predicate"), F.col("parent_text").alias("object"), F.col("start"), F.col("end"), F.least("confidence", "part_of_confidence").alias("confidence"), F.lit("hierarchy/containment").alias("source")
    )


def resolve_conflicts(candidates: DataFrame) -> DataFrame:
    """Candidates of several recognizers without the losers of a dispute, with ner_disputed and ner_labels.

    Two conflict if they overlap by more than 0.8 (intersection over union), or 0.5 with one text in the other. A group
    of linked ones that disagree on the category keeps the most confident (of equals the first by id).
    """
    fields = ["entity_id", "text", "category", "start", "end", "source", "confidence"]
    kind = candidates.select(*fields).schema.simpleString().removesuffix(">") + ",ner_disputed:boolean,ner_labels:map<string,string>>"
    last = lambda v: (v is None, v)

    def of_document(part: list[dict]) -> list[dict]:
        part.sort(key=lambda x: (last(x["start"]), last(x["end"]), last(x["entity_id"])))
        root = list(range(len(part)))

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(part):
            for j in range(i + 1, len(part)):
                b = part[j]
                if b["start"] >= a["end"]:
                    break
                shared = min(a["end"], b["end"]) - max(a["start"], b["start"])
                ratio = shared / ((a["end"] - a["start"]) + (b["end"] - b["start"]) - shared) if shared > 0 else 0.0
                if ratio > 0.8 or (ratio > 0.5 and (a["text"] in b["text"] or b["text"] in a["text"])):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
        groups: dict[int, list[dict]] = {}
        for i, a in enumerate(part):
            groups.setdefault(find(i), []).append(a)
        out = []
        for own in groups.values():
            disputed = len({x["category"] for x in own} - {None}) > 1
            labels = {x["source"]: x["category"] for x in own} if disputed else {}
            if disputed:
                own = [min(own, key=lambda x: (last(None if x["confidence"] is None else -x["confidence"]), last(x["entity_id"])))]
            out += [x | {"ner_disputed": disputed, "ner_labels": list(labels.items())} for x in own]
        return out

    # one call for a batch of documents: a call for each would cost more than the work
    @F.arrow_udf(f"array<{kind}>")
    def resolved(documents: pa.Array) -> pa.Array:
        made = pa.struct([*documents.type.value_type, pa.field("ner_disputed", pa.bool_()), pa.field("ner_labels", pa.map_(pa.string(), pa.string()))])
        return pa.array([of_document(d) for d in documents.to_pylist()], pa.list_(made))

    listed = candidates.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    return listed.select("doc_id", F.inline(resolved("rows")))


def collapse_same_text(entities: DataFrame) -> DataFrame:
    """One entity for each text and category of a document: the most confident, of equals the first; the others' ids in merged_from."""
    order = Window.partitionBy("doc_id", "text", "category").orderBy(F.col("confidence").desc(), "start", "entity_id")
    ids = F.collect_list("entity_id").over(Window.partitionBy("doc_id", "text", "category").orderBy("start", "entity_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = entities.withColumn("__rank", F.row_number().over(order)).withColumn("__ids", ids).where("__rank = 1")
    return out.withColumn("merged_from", F.filter("__ids", lambda i: i != F.col("entity_id"))).drop("__rank", "__ids")


def without_crossings(entities: DataFrame) -> DataFrame:
    """A fold over each document's entities, longest first, then by place: of equal spans of two categories the more confident
    stays, the earlier one of equals; an entity within one of another category goes if it is part of its text, has two
    characters and at least half of its length, and is behind by more than 0.2; within one of its own category it stays; of two of one
    category that cross the more confident stays, the later one of equals."""
    fields = "entity_id,text,category,start,end,source,confidence".split(",")
    one = F.struct((F.col("start") - F.col("end")).alias("order"), F.col("start").alias("at"), *fields)
    docs = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    kind = docs.schema["e"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        same = lambda o: o["category"] == x["category"]
        holds = lambda o, i: (o["start"] <= i["start"]) & (o["end"] >= i["end"])
        equal = lambda o: holds(o, x) & holds(x, o)
        rival = F.filter(acc, lambda o: ~same(o) & equal(o))
        part = lambda o: ~same(o) & holds(o, x) & F.contains(o["text"], x["text"]) & (F.length(x["text"]) >= 2) & (F.length(x["text"]) >= F.length(o["text"]) * 0.5) & (x["confidence"] < o["confidence"] - 0.2)
        crossing = F.filter(acc, lambda o: same(o) & (x["start"] < o["end"]) & (x["end"] > o["start"]) & (~holds(x, o) | equal(o)))
        instead = lambda o: F.concat(F.filter(acc, lambda k: k["entity_id"] != o["entity_id"]), F.array(x))
        return (
            F.when(F.size(rival) > 0, F.when(x["confidence"] > rival[0]["confidence"], instead(rival[0])).otherwise(acc))
            .when(F.exists(acc, part), acc)
            .when(F.exists(acc, lambda o: same(o) & holds(o, x) & ~equal(o)) | (F.size(crossing) == 0), F.concat(acc, F.array(x)))
            .when(x["confidence"] >= crossing[0]["confidence"], instead(crossing[0]))
            .otherwise(acc)
        )

    kept = docs.select("doc_id", F.explode(F.aggregate("e", F.array().cast(kind), step)).alias("e"))
    return kept.select("doc_id", *[f"e.{f}" for f in fields])


# Arcs by which a word modifies the one before it.
MODIFIERS = ["nn", "compound", "nmod"]


def merge_touching(entities: DataFrame, deps: DataFrame | None = None, tokens: DataFrame | None = None, by: tuple[str, ...] = ("start", "end", "entity_id")) -> DataFrame:
    """Neighbours of one category become one where the second begins just where the first ends and neither holds a sign that
    is no letter, number or space. With arcs (doc_id, child, head, rel) and tokens (doc_id, tok_idx, start, end) a token of
    the second must besides hang on one of the first, as nn, compound or nmod. The first gives id and source, and all
    other columns; the least confidence counts; ``parts`` tells how many there were.

    Neighbours are such in the order ``by``. Runs of touching entities are short; within one, arcs are gone through in
    order, since what a later part may hang on is what has been joined before it."""
    if deps is None or tokens is None:
        return touching_of(gathered(entities=entities), by).select(*entities.columns, "parts")
    order = Window.partitionBy("doc_id").orderBy(*by)
    plain = F.col("text").rlike(r"^[\p{L}\p{N}\s]*$")
    before = lambda c: F.lag(c).over(order)
    joins = F.coalesce((before("category") == F.col("category")) & (before("end") == F.col("start")) & plain & before(plain), F.lit(False))
    rows = entities.withColumns({"__nth": F.row_number().over(order), "__joins": joins})
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__joins"), 0).otherwise(1)).over(order))
    # the tokens of each entity, and the words that they hang on
    t = tokens.select("doc_id", "tok_idx", F.col("start").alias("__s"), F.col("end").alias("__e"))
    own = rows.select("doc_id", "__nth", "start", "end").join(t, "doc_id").where("__s < end and __e > start").select("doc_id", "__nth", "tok_idx")
    hung = deps.where(F.lower(F.trim("rel")).isin(MODIFIERS)).select("doc_id", F.col("child").alias("tok_idx"), F.col("head").alias("__head"))
    seen = own.join(hung, ["doc_id", "tok_idx"], "left").groupBy("doc_id", "__nth").agg(F.min("tok_idx").alias("__lo"), F.max("tok_idx").alias("__hi"), F.array_sort(F.collect_set("__head")).alias("__heads"))
    rows = rows.join(seen, ["doc_id", "__nth"], "left")
    part = F.struct("__nth", "__lo", "__hi", "__heads")
    runs = rows.groupBy("doc_id", "__run").agg(F.array_sort(F.collect_list(part)).alias("m"))
    # where each part's compound begins: with itself, or where that of the part before does
    start = F.array().cast("array<struct<first:int,nth:int,lo:int,hi:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        on = F.exists(x["__heads"], lambda h: h.between(last["lo"], last["hi"]))
        joined = F.coalesce((F.size(acc) > 0) & on, F.lit(False))
        fields = {"first": F.when(joined, last["first"]).otherwise(x["__nth"]), "nth": x["__nth"], "lo": F.when(joined, last["lo"]).otherwise(x["__lo"]), "hi": F.when(joined, F.greatest(last["hi"], x["__hi"])).otherwise(x["__hi"])}
        return F.concat(acc, F.array(F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])))

    firsts = runs.select("doc_id", F.inline(F.aggregate("m", start, step, lambda acc: F.transform(acc, lambda x: F.struct(x["nth"].alias("__nth"), x["first"].alias("__first"))))))
    rows = rows.drop("__lo", "__hi", "__heads").join(firsts, ["doc_id", "__nth"])
    text_at = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__nth", "text"))), lambda x: x["text"]), "")
    same = {"text": text_at, "end": F.max("end"), "confidence": F.min("confidence")}
    first = [same[c].alias(c) if c in same else F.min_by(c, "__nth").alias(c) for c in entities.columns if c != "doc_id"]
    return rows.groupBy("doc_id", "__first").agg(*first, F.count(F.lit(1)).alias("parts")).select(*entities.columns, "parts")


def touching_of(docs: DataFrame, by: tuple[str, ...] = ("start", "end", "entity_id")) -> DataFrame:
    """The same without arcs, of gathered documents (doc_id, entities): one shuffle."""
    fields = docs.schema["entities"].dataType.elementType.names
    plain = lambda e: e["text"].rlike(r"^[\p{L}\p{N}\s]*$")
    placed = F.array_sort(F.transform("entities", lambda e: F.struct(*[e[c].alias(f"__{c}") for c in by], e.alias("e"), plain(e).alias("plain"))))
    joins = lambda x, y: F.coalesce((y["e"]["category"] == x["e"]["category"]) & (y["e"]["end"] == x["e"]["start"]) & x["plain"] & y["plain"], F.lit(False))
    begins = lambda r: F.filter(F.transform(r, lambda x, i: F.when((i == 0) | ~joins(x, F.get(r, i - 1)), i)), lambda i: i.isNotNull())
    runs = bound(placed, lambda r: bound(begins(r), lambda b: F.transform(b, lambda at, k: F.slice(r, at + 1, F.coalesce(F.get(b, k + 1), F.size(r)) - at))))
    same = {"text": lambda g: F.array_join(F.transform(g, lambda x: x["e"]["text"]), ""), "end": lambda g: F.array_max(F.transform(g, lambda x: x["e"]["end"])), "confidence": lambda g: F.array_min(F.transform(g, lambda x: x["e"]["confidence"]))}
    one = lambda g: F.struct(*[(same[c](g) if c in same else F.get(g, 0)["e"][c]).alias(c) for c in fields], F.size(g).cast("long").alias("parts"))
    return each(docs.withColumn("__r", F.transform(runs, one)), "__r", "e", "doc_id").select("doc_id", "e.*")


def mapped_labels(found: DataFrame, label_map: DataFrame) -> DataFrame:
    """Recognizer labels to categories by (source, label); unmapped ones are dropped. The map is a small dimension."""
    return found.join(label_map.select("source", "label", "category"), ["source", "label"])


def keyword_category(c: Column) -> Column:
    """Fallback of a keyword look-up: three or more characters that start with a digit are a parameter."""
    return F.when((F.length(c) >= 3) & c.rlike(r"^\p{Nd}"), "PARAMETER")


def keywords(tokens: DataFrame, dictionary: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Tokens (doc_id, text, start, end) that a dictionary (keyword, category, layer) lists, the highest layer deciding,
    without spans already taken."""
    order = Window.partitionBy("keyword").orderBy(F.col("layer").desc(), "category")
    best = dictionary.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(F.col("keyword").alias("text"), "category")
    found = tokens.join(best, "text").where("category <> 'UNKNOWN'")
    if taken is not None:
        found = found.join(taken.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")
    return found.select("doc_id", "text", "start", "end", "category", F.lit("keyword").alias("source"))


def union_layers(*layers: DataFrame) -> DataFrame:
    """Layers of entities in order of precedence; a span of a later layer goes if an earlier one has the same."""
    rows = None
    for i, layer in enumerate(layers):
        one = layer.withColumn("__layer", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    order = Window.partitionBy("doc_id", "start", "end").orderBy("__layer")
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__layer")


def without_overlaps(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows of ``later`` (doc_id, start, end, ...) whose span overlaps none of ``earlier``: of what begins before such a span
    ends, nothing may end after it begins; found by a running maximum, without pairs of rows."""
    upto = Window.partitionBy("doc_id").orderBy("__at", F.col("__earlier").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans_ = earlier.select("doc_id", "start", "end", F.col("start").alias("__at"), F.lit(True).alias("__earlier"))
    both = later.withColumns({"__at": F.col("end"), "__earlier": F.lit(False)}).unionByName(spans_, allowMissingColumns=True)
    reach = F.max(F.when(F.col("__earlier"), F.col("end"))).over(upto)
    return both.withColumn("__reach", reach).where(~F.col("__earlier") & (F.col("__reach").isNull() | (F.col("__reach") <= F.col("start")))).select(later.columns)


def with_ids(entities: DataFrame, prefix: str = "ent", key: str = "entity_id") -> DataFrame:
    """Ids by place, numbered through each document; of rows of equal text and span the first by category and then source, if
    there are such columns, stays."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "text")
    best = Window.partitionBy("doc_id", "text", "start", "end").orderBy(*[c for c in ("category", "source") if c in entities.columns] or ["start"])
    one = entities.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return one.withColumn(key, spans.numbered(prefix, F.row_number().over(order)))


def determiner_compounds(entities: DataFrame, tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """``entities`` and one more for each that is a single token with determiners: the text from the first to the last of them
    and the token, with the category, source and confidence of the entity and no id (``with_ids`` numbers them). Of several
    entities at one token the last has it. An entity whose token is a determiner of an earlier one goes."""
    words = tokens.select("doc_id", "tok_idx", "start", "end", "text")
    return determiners_of(gathered(entities=entities, tokens=words, deps=deps.select("doc_id", "child", "head", "rel"))).select(*entities.columns)


def determiners_of(docs: DataFrame) -> DataFrame:
    """The same of gathered documents (doc_id, entities, tokens, deps)."""
    fields = docs.schema["entities"].dataType.elementType.names
    words = F.array_sort(F.transform("tokens", lambda t: F.struct(*[t[c].alias(c) for c in ("tok_idx", "start", "end", "text")])))
    same = lambda e, t: (e["start"] == t["start"]) & (e["end"] == t["end"]) & (e["text"] == t["text"])
    named = lambda t: F.struct(t["tok_idx"].alias("tok_idx"), F.array_max(F.transform(F.filter("entities", lambda e: same(e, t)), lambda e: e["entity_id"])).alias("entity_id"))
    det = F.transform(F.filter("deps", lambda d: F.lower(F.trim(d["rel"])) == "det"), lambda d: F.struct(d["child"].alias("child"), d["head"].alias("head")))
    docs = docs.withColumns({"__w": words, "__d": det}).withColumn("__at", F.filter(F.transform("__w", named), lambda a: a["entity_id"].isNotNull()))
    # where the determiners of each of these tokens are
    kids = lambda a: F.transform(F.filter("__d", lambda d: d["head"] == a["tok_idx"]), lambda d: d["child"])
    reach = lambda a: bound(kids(a), lambda k: F.struct(a["entity_id"].alias("entity_id"), k.alias("kids"), F.least(F.array_min(k), a["tok_idx"]).alias("lo"), F.greatest(F.array_max(k), a["tok_idx"]).alias("hi")))
    docs = docs.withColumn("__reach", F.filter(F.transform("__at", reach), lambda r: F.size(r["kids"]) > 0))
    taken = F.transform(F.filter("__at", lambda a: has("__reach", lambda r: (r["entity_id"] < a["entity_id"]) & F.array_contains(r["kids"], a["tok_idx"]))), lambda a: a["entity_id"])
    left = bound(taken, lambda gone: F.filter("entities", lambda e: ~F.coalesce(F.array_contains(gone, e["entity_id"]), F.lit(False))))
    made = lambda e, run: F.struct(*[{"entity_id": F.lit(None).cast("string"), "text": F.array_join(F.transform(run, lambda w: w["text"]), ""), "start": F.get(run, 0)["start"], "end": F.try_element_at(run, F.lit(-1))["end"]}.get(c, e[c]).alias(c) for c in fields])
    run = lambda r: F.filter("__w", lambda w: w["tok_idx"].between(r["lo"], r["hi"]))
    more = lambda e: F.transform(F.filter("__reach", lambda r: r["entity_id"] == e["entity_id"]), lambda r: bound(run(r), lambda w: made(e, w)))
    own = lambda e: F.struct(*[e[c].alias(c) for c in fields])
    rows = bound(left, lambda es: F.concat(F.transform(es, own), F.flatten(F.transform(es, more))))
    return each(docs.withColumn("__rows", rows), "__rows", "e", "doc_id").select("doc_id", "e.*")


def discovered_entities(found: DataFrame, docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Discovered words (doc_id, word, score) as UNKNOWN entities at their first place in the text, unless an entity has that
    span; the score sets the confidence, 0.85 at most."""
    at = found.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id").withColumn("start", F.instr("__text", F.col("word")) - 1).where("start >= 0")
    rows = at.select(
        "doc_id", F.col("word").alias("text"), F.lit("UNKNOWN").alias("category"), "start", (F.col("start") + F.length("word")).alias("end"), F.lit("discover").alias("source"), F.least(F.lit(0.85), 0.5 + F.col("score") * 0.05).alias("confidence")
    )
    return rows.join(entities.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti").select(*rows.columns)


def invalid(entities: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Rows that break the rules of the schema, with the rule."""
    rule = F.when((F.col("start") < 0) | (F.col("start") > F.col("end")), "span").when(~F.col("category").isin(*(categories or CATEGORIES)), "category").when(~F.col("confidence").between(0, 1), "confidence").when(F.length("text") == 0, "text")
    return entities.withColumn("rule", rule).where("rule is not null")


def longest_prefix_matches(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of dictionary words, the longest at each place, none overlapping: rows (doc_id, start, end, text). The
    words are sent to the workers: give them in a bounded list; longer ones go through ``all_matches``."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    # of alternatives the first that fits counts, so longer ones stand before their beginnings
    longest_first = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    pattern = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc_id, m.start(), m.end(), m[0]) for doc_id, t in zip(b["doc_id"], b["t"], strict=True) if t is not None for m in pattern.finditer(t)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, start int, end int, text string")


def all_matches(docs: DataFrame, dictionary: DataFrame, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All matches, overlapping ones too, of a dictionary (keyword, category) of any size: every substring of up to
    ``longest`` characters joined by equality."""
    c = F.col(text_col)
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(c) - i + 1)), lambda n: F.struct((i - 1).alias("start"), (i - 1 + n).alias("end"), F.substring(c, i, n).alias("keyword")))))
    rows = docs.where(F.length(c) > 0).select(F.col(id_col).alias("doc_id"), F.explode(places).alias("m")).select("doc_id", "m.*")
    return rows.join(dictionary, "keyword").select("doc_id", "start", "end", F.col("keyword").alias("text"), "category")
