"""Small tables of annotations, the same as DataFrames and as VALUES of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "texts": (
        "doc_id long, text string",
        [
            (1, "子曰：学而时习之，不亦说乎？有朋自远方来，不亦乐乎？"),
            (2, "我们的公司在2024年1月15日发布了3个产品，增长50%。"),
            (3, "The company was founded in California. It has 20 offices."),
            (4, "陈胜者，阳城人也，字涉。"),
            (5, "没有100万元，也不是2024-02-30。编号63906433，价格¥3.5万，共20240115。"),
            (6, "𠀀中12%和𠀀3.5亿"),
            (7, ""),
            (8, "ab"),
        ],
    ),
    "dates": ("id long, text string", list(enumerate(["2024年1月15日", "2024年1月", "2024年", "2024-1-5", "2024/01/15", "2024.1.5", "20240115", "63906433", "20241340", "abc", "2024-01-15T00", ""]))),
    "entities": (
        "doc_id long, entity_id string, text string, category string, start int, end int, source string, confidence double",
        [
            (1, "ent_001", "北京大学", "ORGANIZATION", 0, 4, "ner", 0.9),
            (1, "ent_002", "北京", "ORGANIZATION", 0, 2, "ner", 0.6),
            (1, "ent_003", "京大", "ORGANIZATION", 1, 3, "ner", 0.5),
            (1, "ent_004", "4.3.2", "NUMBER", 10, 15, "ner", 0.8),
            (1, "ent_005", "12", "NUMBER", 20, 22, "ner", 0.9),
            (1, "ent_006", "2500V", "NUMBER", 25, 30, "ner", 0.3),
            (1, "ent_007", "GB50150", "STANDARD", 31, 38, "ner", 0.4),
            (1, "ent_008", "abc", "STANDARD", 40, 43, "ner", 0.9),
            (2, "ent_001", "widget", "PRODUCT", 0, 6, "ner", 0.8),
            (2, "ent_002", "gadget", "PRODUCT", 7, 13, "ner", 0.9),
            (2, "ent_003", "thing", "UNKNOWN", 14, 19, "discover", 0.7),
            (2, "ent_004", "steel", "MATERIAL", 20, 25, "keyword", 0.85),
            (2, "ent_005", "steel", "MATERIAL", 30, 35, "ner", 0.95),
            (2, "ent_006", "第5章", "UNKNOWN", 36, 39, "ner", 0.9),
            (2, "ent_007", "123456", "NUMBER", 40, 46, "numeric/quantity", 0.55),
        ],
    ),
    "candidates": (
        "doc_id long, entity_id string, text string, category string, start int, end int, source string, confidence double",
        [
            (1, "a", "北京市", "LOCATION", 0, 3, "pku", 0.7),
            (1, "b", "北京市", "ORGANIZATION", 0, 3, "msra", 0.9),
            (1, "c", "上海", "LOCATION", 5, 7, "pku", 0.7),
            (1, "d", "上海", "LOCATION", 5, 7, "msra", 0.8),
            (1, "e", "abcdef", "PERSON", 10, 16, "pku", 0.5),
            (1, "f", "abcd", "LOCATION", 10, 14, "msra", 0.5),
        ],
    ),
    "relations": (
        "doc_id long, rel_id string, sentence_index int, subject string, predicate string, predicate_verb string, object string",
        [
            (1, "rel_001", 0, "碳钢", "HAS_PROPERTY", "具有", "高强度和高韧性"),
            (1, "rel_002", 0, "碳钢", "RELATES_TO", "具有", "硬度"),
            (1, "rel_003", 1, "张三和李四", "RELATES_TO", "去", "北京"),
            (1, "rel_004", 1, "张三", "RELATES_TO", "", "上海"),
            (2, "rel_001", 0, "x", "RELATES_TO", "是", "x"),
            (2, "rel_002", 0, "y", "RELATES_TO", "是", "z"),
        ],
    ),
    "frames": (
        "doc_id long, frame_idx int, text string, role string, start int, end int",
        [(1, 0, "公司", "ARG0", 0, 2), (1, 0, "发布", "PRED", 4, 6), (1, 0, "产品 ", "ARG1", 6, 8), (1, 0, "去年", "ARGM-TMP", 2, 4), (1, 0, "东西", "ARG1", 9, 11), (1, 1, "住", "PRED", 12, 13), (1, 1, "他", "ARG1", 11, 12), (1, 1, "北京", "ARGM-LOC", 13, 15)],
    ),
    "tokens": (
        "doc_id long, tok_idx int, text string, pos string, start int, end int",
        [(1, 0, "张三", "NR", 0, 2), (1, 1, "喜欢", "VV", 2, 4), (1, 2, "红色", "NN", 4, 6), (1, 3, "苹果", "NN", 6, 8), (1, 4, "。", "PU", 8, 9), (2, 0, "水", "NN", 0, 1), (2, 1, "流动", "VV", 1, 3)],
    ),
    "deps": ("doc_id long, child int, head int, rel string", [(1, 0, 1, "nsubj"), (1, 1, -1, "root"), (1, 2, 3, "nn"), (1, 3, 1, "dobj"), (1, 4, 1, "punct"), (2, 0, 1, "nsubj"), (2, 1, -1, "root")]),
    "events": (
        "doc_id long, event_id string, sentence_index int, trigger string, start int, end int, agent string, patient string, has_agent boolean, is_root boolean, predicate string, semantic_class string",
        [
            (1, "evt_001", 0, "发布", 4, 6, "公司", "产品", True, True, "PRODUCES", "create"),
            (1, "evt_002", 0, "发布", 4, 6, None, "东西", False, True, "RELATES_TO", None),
            (1, "evt_003", 1, "去", 10, 11, None, None, False, False, "RELATES_TO", None),
            (1, "evt_004", 0, "发布", 4, 6, "公司", "产品", True, False, "RELATES_TO", None),
        ],
    ),
    "arguments": (
        "doc_id long, event_id string, role string, text string, disputed boolean",
        [(1, "evt_001", "Agent", "公司", False), (1, "evt_001", "Patient", "产品", None), (1, "evt_002", "Patient", "很长很长很长很长很长很长很长很长的东西。", True), (1, "evt_004", "Agent", "公司", None), (1, "evt_004", "Patient", "产品", None)],
    ),
    "facts": (
        "doc_id long, subject_id string, subject string, predicate string, object_id string, object string",
        [
            (1, "ent_001", "北京大学", "IS_A", None, "大学"),
            (1, "ent_001", "北京大学", "LOCATED_AT", "ent_002", "北京"),
            (1, "ent_001", "北京大学", "HAS_PROPERTY", None, "著名"),
            (2, "ent_002", "gadget", "LOCATED_AT", None, "Paris"),
            (2, "ent_001", "widget", "PRODUCES", "ent_002", "gadget"),
        ],
    ),
    "named": (
        "doc_id long, entity_id string, text string, category string, start int, end int",
        [
            (1, "ent_001", "北京大学", "ORGANIZATION", 0, 4),
            (1, "ent_002", "北京", "LOCATION", 0, 2),
            (1, "ent_003", "张三", "PERSON", 6, 8),
            (1, "ent_004", "2024", "DATE", 8, 12),
            (1, "ent_005", "2024年", "DATE", 8, 13),
            (1, "ent_006", "去年", "DATE", 30, 32),
            (1, "ent_007", "北京", "LOCATION", 34, 36),
            (1, "ent_008", "图书馆", "FACILITY", 38, 41),
            (2, "ent_001", "widget company", "ORGANIZATION", 0, 14),
            (2, "ent_002", "widget", "PRODUCT", 20, 26),
            (2, "ent_003", "gadget", "PRODUCT", 30, 36),
        ],
    ),
    "sentence_places": ("doc_id long, sent_idx int, start int, end int, text string", [(1, 0, 0, 25, "北京大学，张三2024年访问。"), (1, 1, 26, 45, "他去年在北京的图书馆读书。"), (2, 0, 0, 40, "widget company makes widget and gadget")]),
    "spoken": (
        "doc_id long, arg_id int, text string, start int",
        [(1, 0, "张三", 6), (1, 1, "图书馆", None), (1, 2, "北京大学的学生", 99), (1, 3, "大学", -1), (1, 4, "无", None), (1, 5, "", 3), (1, 6, None, None), (2, 0, "the gadget and the widget", 40), (2, 1, "widget company", 39), (3, 0, "张三", 0)],
    ),
    "claims": (
        "doc_id long, rel_id string, subject string, subject_raw string, predicate string, predicate_verb string, object string, object_raw string, source string",
        [
            (1, "r1", "张三", "张三", "RELATES_TO", "至", "北京", "北京", "srl/至"),
            (1, "r2", "该校", "该校", "RELATES_TO", "有", "图书馆的书", "图书馆的书", "srl/有"),
            (1, "r3", "他的", "他的", "KNOWS", "识", "无", "无", "srl/识"),
            (1, "r4", "之", "之", "KNOWS", "识", "张三", "张三", "srl/识"),
            (1, "r5", "该校", "该校", "HAS_STYLE_NAME", "字", "张三", "张三", "classical_pattern/zi"),
            (1, "r6", "大学", "大学", "IS_A", "是", "北京大学", "北京大学", "dep"),
            (1, "r7", "北京", "北京", "RELATES_TO", "来", "张三", "张三", "dep"),
            (2, "r1", "the company", "the company", "RELATES_TO", "makes", "gadgets", "gadgets", "srl/makes"),
            (2, "r2", "widget company", "widget company", "RELATES_TO", "makes", "gadget", "gadget", "srl/makes"),
            (3, "r1", "之", "之", "RELATES_TO", "为", "x", "x", "dep"),
        ],
    ),
    "mentions": (
        "doc_id long, chain_id int, text string, representative string",
        [(1, 0, "该校", "该大学"), (1, 0, "北京大学", "该大学"), (1, 1, "他", "李四"), (1, 2, "他", "张三"), (1, 2, "他的", "张三"), (2, 0, "the company", "widget"), (2, 0, "the", "gadget"), (3, 0, "之", "本")],
    ),
    "category_pairs": ("subject_category string, object_category string, predicate string", [("ORGANIZATION", "PRODUCT", "PRODUCES"), ("PERSON", "ORGANIZATION", "MEMBER_OF")]),
    "verb_predicates": ("verb string, predicate string", [("识", "KNOWS"), ("有", "HAS_PART")]),
    "triggers": ("doc_id long, event_id string, sentence_index int, start int, end int", [(1, "e1", 0, 13, 15), (1, "e2", 1, 42, 44), (1, "e3", -1, 0, 1), (1, "e4", 1, 32, 33), (2, "e1", 0, 15, 20)]),
    "trigger_arguments": ("doc_id long, event_id string, role string, text string", [(1, "e1", "Agent", "张三"), (1, "e1", "Location", "北京"), (1, "e2", "Patient", "图书馆"), (2, "e1", "Agent", "widget company")]),
    "characters": ("doc_id long, tok_idx int, text string, start int, end int", [(1, 0, "唐", 0, 1), (1, 1, "太", 1, 2), (1, 2, "子", 2, 3), (1, 3, "少师", 3, 5), (1, 4, "李", 6, 7), (1, 5, "白", 7, 8), (1, 6, "杜", 8, 9), (1, 7, "甫", 10, 11), (2, 0, "长安", 0, 2), (2, 1, "李", 2, 3), (2, 2, "白", 3, 4)]),
    "register": ("text string, category string", [("唐", "ERA"), ("唐", "LOCATION"), ("太子", "TITLE"), ("太子少师", "TITLE"), ("李白", "PERSON"), ("杜甫", "PERSON"), ("长安", "PERSON"), ("长安", "LOCATION"), ("白", "COLOUR"), ("唐太子少师", "TITLE")]),
    "cup_tokens": ("doc_id long, tok_idx int, text string, start int, end int", [(1, 0, "这", 0, 1), (1, 1, "届", 1, 2), (1, 2, "世界杯", 2, 5), (1, 3, "很", 5, 6), (1, 4, "大", 6, 7), (2, 0, "北京", 0, 2), (2, 1, "那", 2, 3), (2, 2, "些", 3, 4), (2, 3, "人", 4, 5)]),
    "cup_deps": ("doc_id long, child int, head int, rel string", [(1, 0, 2, "det"), (1, 1, 0, "clf"), (1, 2, 4, "nsubj"), (1, 3, 4, "advmod"), (1, 4, -1, "root"), (2, 1, 3, "DET"), (2, 2, 3, "det"), (2, 0, 3, "nmod"), (2, 3, -1, "root")]),
    "cup_entities": (
        "doc_id long, entity_id string, text string, category string, start int, end int, source string, confidence double",
        [(1, "ent_001", "世界杯", "EVENT", 2, 5, "ner", 0.9), (1, "ent_002", "很大", "UNKNOWN", 5, 7, "ner", 0.5), (2, "ent_001", "北京", "LOCATION", 0, 2, "ner", 0.9), (2, "ent_002", "人", "PERSON", 4, 5, "ner", 0.6)],
    ),
    "discovered": ("doc_id long, word string, score double", [(1, "世界", 4.0), (1, "世界杯", 9.0), (1, "很大", 3.0), (1, "没有", 3.5), (2, "那些", 12.0), (2, "些人", 3.2)]),
    "tags": ("id long, tags string", [(1, "B-PER I-PER O B-LOC B-LOC"), (2, "I-PER I-LOC I-LOC O"), (3, "S-PER B-LOC I-LOC E-LOC E-LOC"), (4, "U-A B-B L-B O"), (5, "B-A M-A E-A S-B"), (6, "O O")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def with_values(*names: str) -> str:
    """WITH clauses of the named tables, to go before a query or further clauses."""
    parts = []
    for name in names:
        schema, rows = TABLES[name]
        columns = ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))
        parts.append(f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})")
    return "WITH " + ", ".join(parts)
