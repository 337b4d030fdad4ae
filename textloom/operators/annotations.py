"""Annotations of recognizers as tables: dependencies, frames, spans and categories, with built-in functions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories by parts of fine-grained tags, in order of preference, for nouns and for other classes.
NOUN_TAGS = [("TITLE", ["官职", "官名", "爵位", "官職"]), ("ERA", ["时代", "朝代", "年代"]), ("INSTITUTION", ["典章", "制度", "礼制"]), ("ASTRONOMY", ["天文", "历法", "星宿"]), ("LOCATION", ["地名", "地形"])]
LATER_NOUN_TAGS = [("ORGANIZATION", ["組織"]), ("PRODUCT", ["作品"]), ("LOCATION", ["固有名詞", "固定物"]), ("UNKNOWN", ["主体", "動物", "植物"])]
OTHER_TAGS = [("TITLE", ["官職", "官名", "爵位"]), ("ERA", ["朝代", "时代", "年代"]), ("INSTITUTION", ["典章", "制度", "礼制"]), ("ASTRONOMY", ["天文", "历法", "星宿"]), ("LOCATION", ["地名", "地形"]), ("PERSON", ["人名"]), ("ORGANIZATION", ["組織"]), ("PRODUCT", ["作品"])]
# Categories by endings, proper-noun tags, and words that are part of no name.
SUFFIXES = [("ORGANIZATION", ["公司", "集团", "有限", "股份", "中心", "大学", "学院", "学校", "医院", "银行", "委员会", "协会", "学会"]), ("LOCATION", ["省", "市", "区", "县", "公路", "大街", "省城", "市区"]), ("PRODUCT", ["手机", "电脑", "汽车", "系统", "平台", "软件", "服务", "产品", "技术", "芯片"])]
PROPER = ["NNP", "PROPN", "NR"]
NO_NAMES = ["的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "把", "被", "对", "从", "到"]
# Rules (priority, left, right, result) for neighbours of two categories.
MERGE_RULES = [(10, "LOCATION", "ORGANIZATION", "ORGANIZATION"), (10, "ORGANIZATION", "ORGANIZATION", "ORGANIZATION"), (20, "MATERIAL", "MATERIAL", "MATERIAL"), (20, "LOCATION", "LOCATION", "LOCATION"), (15, "LOCATION", "FACILITY", "FACILITY"), (25, "ORGANIZATION", "PRODUCT", "PRODUCT")]


def dependencies(rows: DataFrame, column: str = "dep") -> DataFrame:
    """Arcs array<struct<head,rel>> with heads from 1 (0: the root) as rows (doc_id, child, head, rel) from 0, -1 the root."""
    each = rows.select("doc_id", F.posexplode(column).alias("child", "arc"))
    return each.select("doc_id", "child", (F.col("arc.head") - 1).alias("head"), F.col("arc.rel").alias("rel"))


def valid_frames(frames: Column) -> Column:
    """Frames array<array<array<string>>> of two or more items, with their items (text, role, first token, end) that have
    all four and numbers for the places; frames without any go."""
    number = lambda c: F.regexp_replace(F.trim(c), r"\.\d*$", "").try_cast("int")
    good = lambda i: (F.size(i) >= 4) & number(F.try_element_at(i, F.lit(3))).isNotNull() & number(F.try_element_at(i, F.lit(4))).isNotNull()
    item = lambda i: F.struct(i[0].alias("text"), i[1].alias("role"), number(i[2]).alias("start"), number(i[3]).alias("end"))
    kept = F.transform(F.filter(frames, lambda f: F.size(f) >= 2), lambda f: F.transform(F.filter(f, good), item))
    return F.filter(kept, lambda f: F.size(f) > 0)


def rebased(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans counted within segments (doc_id, seg_idx, start) counted through the document instead."""
    s = segments.select("doc_id", "seg_idx", F.col("start").alias("__offset"))
    return found.join(s, ["doc_id", "seg_idx"]).withColumn("start", F.col("start") + F.col("__offset")).withColumn("end", F.col("end") + F.col("__offset")).drop("__offset")


def renumbered(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, seg_idx, tok_idx, ...) numbered through the document, segment by segment."""
    order = Window.partitionBy("doc_id").orderBy("seg_idx", "tok_idx")
    return tokens.withColumn("tok_idx", (F.row_number().over(order) - 1).cast("int"))


def token_spans(found: DataFrame, tokens: DataFrame, key: str = "entity_id") -> DataFrame:
    """``found`` (doc_id, key, start, end) with tok_start and tok_end, the tokens it overlaps, end exclusive; null if none."""
    t = tokens.select("doc_id", "tok_idx", F.col("start").alias("__s"), F.col("end").alias("__e"))
    hit = found.select("doc_id", key, "start", "end").join(t, "doc_id").where("__s < end and __e > start")
    range_ = hit.groupBy("doc_id", key).agg(F.min("tok_idx").alias("tok_start"), (F.max("tok_idx") + 1).alias("tok_end"))
    return found.join(range_, ["doc_id", key], "left")


def nearest_span(c: Column, target: Column, hint_start: Column | None = None, hint_end: Column | None = None) -> Column:
    """The span (start, end) of the occurrence whose centre is nearest to the hint's, the first of equals and without a hint;
    (0, 0) if there is none. Occurrences may overlap."""
    none = F.lit(None).cast("int")

    @F.arrow_udf("struct<start:int,end:int>")
    def run(texts: pa.Array, targets: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, own, a, b in zip(*(x.to_pylist() for x in (texts, targets, starts, ends)), strict=True):
            best, far, at = (0, 0), None, text.find(own) if text and own else -1
            while at >= 0:
                away = 0 if a is None or b is None else abs(at + len(own) / 2 - (a + b) / 2)
                if far is not None and away >= far:
                    break  # beyond the nearest they only get farther
                best, far, at = (at, at + len(own)), away, text.find(own, at + 1)
            out.append({"start": best[0], "end": best[1]})
        return pa.array(out, pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    return run(c, target, none if hint_start is None else hint_start.cast("int"), none if hint_end is None else hint_end.cast("int"))


def has_any(c: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(p)) for p in parts])


def chain(c: Column, rules: list[tuple[str, list[str]]], start: Column | None = None) -> Column:
    out = start
    for category, parts in rules:
        out = (F if out is None else out).when(has_any(c, parts), category)
    return out


def xpos_category(c: Column) -> Column:
    """Category of a fine-grained tag, ``class,kind,...`` or a single word; null if it says nothing."""
    parts = F.transform(F.split(c, ","), F.trim)
    compound = F.size(parts) > 1
    kind = F.when(compound, F.array_join(F.slice(parts, 2, F.size(parts)), ",")).otherwise(c)
    noun = chain(kind, NOUN_TAGS).when(F.contains(kind, F.lit("人")) & F.contains(kind, F.lit("名")), "PERSON")
    noun = chain(kind, LATER_NOUN_TAGS, noun)
    return F.when(F.contains(F.when(compound, parts[0]).otherwise(c), F.lit("名詞")), noun).otherwise(chain(c, OTHER_TAGS))


def suffix_category(c: Column) -> Column:
    """Category of a name of three or more characters by its ending, else UNKNOWN."""
    out = F.when(F.length(c) < 3, "UNKNOWN")
    for category, endings in SUFFIXES:
        out = out.when(c.rlike("(?:" + "|".join(endings) + ")$"), category)
    return out.otherwise("UNKNOWN")


def proper_names(tokens: DataFrame, taken: DataFrame) -> DataFrame:
    """Names that no recognizer found: proper nouns that touch, from the first of two or more characters that is no
    recognized span on; those that overlap a recognized span (doc_id, start, end) go."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    name = F.col("pos").isin(PROPER)
    rows = tokens.withColumn("__goes_on", F.coalesce(name & F.lag(name).over(order) & (F.col("start") == F.lag("end").over(order)) & ~F.col("text").isin(NO_NAMES), F.lit(False)))
    rows = rows.withColumn("__run", F.sum((~F.col("__goes_on")).cast("int")).over(order)).where(name)
    spans = taken.select("doc_id", "start", "end").distinct()
    known = spans.withColumn("__known", F.lit(True))
    rows = rows.join(known, ["doc_id", "start", "end"], "left").withColumn("__may", (F.length("text") >= 2) & F.col("__known").isNull())
    run = Window.partitionBy("doc_id", "__run")
    rows = rows.withColumn("__from", F.min(F.when(F.col("__may"), F.col("tok_idx"))).over(run)).where("tok_idx >= __from")
    merged = rows.groupBy("doc_id", "__run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"]), "").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
    other = spans.select("doc_id", F.col("start").alias("__s"), F.col("end").alias("__e"))
    found = merged.join(other, (merged.doc_id == other.doc_id) & (merged.start < other["__e"]) & (merged.end > other["__s"]), "left_anti")
    return found.select("doc_id", "text", suffix_category(F.col("text")).alias("category"), "start", "end", F.lit("pos/nnp").alias("source"), F.lit(0.55).alias("confidence"))


def dynamic_confidence(confidence: Column, source: Column, subject_id: Column, object_id: Column, start: Column, end: Column) -> Column:
    """Confidence of a relation by where it comes from, which ends are entities, and how short its evidence is."""
    base = F.when(F.contains(source, F.lit("srl/")), F.greatest(confidence, F.lit(0.65))).when(F.contains(source, F.lit("bridge/")), F.least(confidence, F.lit(0.50))).otherwise(confidence)
    has = lambda c: F.coalesce(c != "", F.lit(False))
    base = F.when(has(subject_id) & has(object_id), F.least(F.lit(1.0), base + 0.05)).when(has(subject_id) | has(object_id), F.least(F.lit(1.0), base + 0.02)).otherwise(base)
    return F.when(end - start <= 10, F.least(F.lit(1.0), base + 0.03)).otherwise(base)


def cross_category(entities: DataFrame, rules: list[tuple[int, str, str, str]] | None = None) -> DataFrame:
    """Neighbours that touch become one entity where a rule says so: rule by rule in order of priority, each in one pass from
    left to right in which what was merged is not merged again."""
    one = F.struct("start", "end", "entity_id", "text", "category", "source", "confidence")
    lists = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    kind = lists.schema["e"].dataType.simpleString()
    merged = F.col("e")

    def pass_of(left: str, right: str, result: str):
        def step(acc: Column, x: Column) -> Column:
            last = F.try_element_at(acc["out"], F.lit(-1))
            fits = F.coalesce(acc["free"] & (last["category"] == left) & (x["category"] == right) & (last["end"] == x["start"]), F.lit(False))
            both = F.struct(last["start"].alias("start"), x["end"].alias("end"), last["entity_id"].alias("entity_id"), F.concat(last["text"], x["text"]).alias("text"), F.lit(result).alias("category"), last["source"].alias("source"), F.least(last["confidence"], x["confidence"]).alias("confidence"))
            out = F.when(fits, F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc["out"], F.array(x)))
            return F.struct(out.cast(kind).alias("out"), (~fits).alias("free"))

        return step

    for _, left, right, result in sorted(rules or MERGE_RULES, key=lambda r: r[0]):
        merged = F.aggregate(merged, F.struct(F.array().cast(kind).alias("out"), F.lit(True).alias("free")), pass_of(left, right, result), lambda acc: acc["out"])
    return lists.select("doc_id", F.explode(merged).alias("x")).select("doc_id", "x.*")


# --- documents as maps of annotations ------------------------------------------------------------------------------


def by_prefix(annotations: Column, prefix: str) -> Column:
    """The value of the first key, in order, that is the prefix or begins with it and a slash."""
    keys = F.array_sort(F.filter(F.map_keys(annotations), lambda k: (k == prefix) | F.startswith(k, F.lit(prefix + "/"))))
    return F.try_element_at(annotations, F.try_element_at(keys, F.lit(1)))


def translated(tags: Column, names: dict[str, str]) -> Column:
    """Tags by a table of names; the others as they are."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t))


def squeezed(sentences: Column) -> Column:
    """The only element of a list of one sentence; null if there are more."""
    return F.when(F.size(sentences) == 1, F.try_element_at(sentences, F.lit(1)))
