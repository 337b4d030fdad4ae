"""Operators on fixtures, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import fixtures as fx
from textloom.derived_queries import clause_documents
from textloom.functions import language, spans, text
from textloom.operators import discovery, entities, frame_events, relations, sentences, summary, tags, titles
from textloom.operators.gathering import gathered
from textloom.plans.analyze import Options, analyze, by_document
from textloom.sources import readers, writers
from textloom.streaming.streams import busy_windows, by_batch


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.clean_html, "H<sub>2</sub>O &amp;lt; <br/>1 < 2", "H2O < 1 < 2"),
        (text.clean_cjk, "碳 钢(A36)的,强度", "碳钢36的强度"),
        (text.strip, " 　a\n", "a"),
        (text.digits_to_zero, "a1２b", "a00b"),
        (text.sentence_type, "好吗？ ", "interrogative"),
        (text.end_mark, "好！", "！"),
        (text.rhetorical_form, "春风得意，秋月无边。", "parallel"),
        (text.constructions, "陈胜者，阳城人也", ["judgment_sentence"]),
        (text.split_clauses, "a。b！ c\n\nd", ["a", "b", "c", "d"]),
        (text.split_patterns, "甲。乙？丙", ["甲。", "乙？", "丙"]),
        (text.split_quoted, "他说：“好。”然后走了。再见", ["他说：“好。”", "然后走了。", "再见"]),
        (lambda c: F.array_sort(text.all_segmentations(c)), "abc", [["a", "b", "c"], ["a", "bc"], ["ab", "c"], ["abc"]]),
        (text.words, "é日本 a_1-b", ["é日本", "a_1", "b"]),
        (text.is_date, "20241340", False),
        (text.has_unit, "2500V", True),
        (text.has_unit, "12", False),
        (text.is_standard_code, "gb/t 20840", True),
        (lambda c: text.ngrams(c, 2), "𠀀中a", ["𠀀中", "中a"]),
        (lambda c: text.truncate(c, 3), "abcd", "ab…"),
        (lambda c: text.cut_long(F.array(c), 6), "abc,de,fghijklm", ["abc,", "de,", "fghijk", "lm"]),
        (lambda c: text.bigrams(text.chars(c)), "abc", ["ab", "bc", "c"]),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_sentence_spans_count_code_points(spark):
    t = "𠀀。  同。同。A b. C d? no"
    got = one(spark, t, text.split_sentences)
    assert [s.text for s in got] == ["𠀀。", "同。", "同。", "A b.", "C d? no"]
    assert all(t[s.start : s.end] == s.text for s in got)


@pytest.mark.parametrize(
    "value,label",
    [("学而时习之，不亦说乎？", "classical"), ("我们的公司发布了新产品。", "modern"), ("The cat is here.", "english"), ("Zzyx qwrt", "english"), ("ab", "modern"), ("北京立方庭位于海淀区", "modern")],
)
def test_language(spark, value, label):
    assert one(spark, value, language.detect).label == label


def test_segments(spark):
    d = spark.createDataFrame([(1, "学而时习之，不亦说乎？不亦乐乎？The cat is here. It was there.")], "doc_id long, text string")
    got = sentences.segments(sentences.labelled_sentences(d)).orderBy("segment").collect()
    assert [(r.label, r.sentences) for r in got] == [("classical", 2), ("english", 2)]


def test_textrank():
    assert summary.textrank([]).tolist() == [] and summary.textrank(["a"]).tolist() == [1.0]
    scores = summary.textrank(["a b c", "a b d", "x y z", "a b"])
    assert scores.max() == 1.0 and scores.argmin() == 2
    many = [f"w{i} w{i + 1} shared" for i in range(50)]
    whole = summary.textrank(many)
    summary.BLOCK_CELLS, kept = 100, summary.BLOCK_CELLS
    try:
        assert abs(summary.textrank(many) - whole).max() < 1e-12
    finally:
        summary.BLOCK_CELLS = kept


def test_selection_skips_and_goes_on():
    assert summary.chosen([5, 5, 5], [0.1, 0.9, 0.5], 20) == [0, 1, 2]
    assert summary.chosen([50, 9, 4], [0.9, 0.5, 0.4], 10) == [0]
    assert summary.chosen([5, 9, 4], [0.9, 0.5, 0.4], 10) == [0, 2]


def test_selection_by_fold_agrees(spark):
    rows = [(1, 0, "aaaaa", 0.9), (1, 1, "bbbbbbbbb", 0.5), (1, 2, "cccc", 0.4), (2, 0, "x", 0.1)]
    got = {r.doc_id: (r.summary_text, r.sentence_indexes) for r in summary.select(spark.createDataFrame(rows, "doc_id long, sent_idx int, text string, score double"), "10").collect()}
    assert got == {1: ("aaaaacccc", [0, 2]), 2: ("x", [0])}


def test_numbers(spark):
    got = {(r.doc_id, r.text, r.start, r.source, r.normalized) for r in entities.numbers(fx.frame(spark, "texts")).collect()}
    assert {g for g in got if g[0] == 2} == {(2, "2024年1月15日", 6, "numeric/date", "2024-01-15"), (2, "3个", 19, "numeric/quantity", "3个"), (2, "50%", 26, "numeric/percentage", "50%")}
    assert {g[1] for g in got if g[0] == 5} == {"100万元", "2024-02-30", "¥3.5万", "20240115"}
    assert {(g[1], g[2]) for g in got if g[0] == 6} == {("12%", 2), ("3.5亿", 7)}


def test_negation(spark):
    t = fx.frame(spark, "texts")
    got = {(r.doc_id, r.text): r.is_negated for r in entities.with_negation(entities.numbers(t), entities.negations(t)).collect()}
    assert got[(5, "100万元")] and got[(5, "2024-02-30")] and not got[(2, "50%")]


def test_conflicts_and_hierarchy(spark):
    got = {r.entity_id: (r.category, r.ner_disputed) for r in entities.resolve_conflicts(fx.frame(spark, "candidates")).collect()}
    assert got == {"b": ("ORGANIZATION", True), "c": ("LOCATION", False), "d": ("LOCATION", False), "e": ("PERSON", True)}
    h = {r.entity_id: r.parent_entity_id for r in entities.hierarchy(fx.frame(spark, "entities").where("doc_id = 1")).collect()}
    assert h["ent_002"] == "ent_001" and h["ent_003"] == "ent_001" and h["ent_001"] is None
    assert entities.part_of(entities.hierarchy(fx.frame(spark, "entities"))).count() == 2


def test_quality_reasons(spark):
    got = {(r.doc_id, r.entity_id): (r.keep, r.category, r.filter_reason) for r in entities.with_quality(fx.frame(spark, "entities"), given=["abc"]).collect()}
    assert got[(1, "ent_004")][:2] == (True, "SECTION_REF") and got[(1, "ent_005")] == (False, "NUMBER", "bare number '12' (no unit/context)")
    assert got[(1, "ent_006")][0] and got[(1, "ent_007")][0] and got[(1, "ent_008")][0]
    assert got[(2, "ent_001")][2] == "PRODUCT not corroborated (confidence 0.80 < 0.85)"
    assert got[(2, "ent_007")][2] == "confidence 0.55 < 0.60 (numeric/quantity)"


def test_iou(spark):
    row = spark.range(1).select(spans.iou(F.lit(0), F.lit(3), F.lit(0), F.lit(2)).alias("a"), spans.iou(F.lit(0), F.lit(2), F.lit(2), F.lit(4)).alias("b")).first()
    assert abs(row.a - 2 / 3) < 1e-12 and row.b == 0


def test_tags(spark):
    got = {r.id: [(s.label, s.start, s.end) for s in r.s] for r in fx.frame(spark, "tags").select("id", tags.tags_to_spans(F.split("tags", " ")).alias("s")).collect()}
    assert got[1] == [("PER", 0, 2), ("LOC", 3, 4), ("LOC", 4, 5)]
    assert got[2] == [("PER", 0, 1), ("LOC", 1, 3)] and got[3] == [("PER", 0, 1), ("LOC", 1, 4), ("LOC", 4, 5)]
    assert got[4] == [("A", 0, 1), ("B", 1, 3)] and got[5] == [("A", 0, 3), ("B", 3, 4)] and got[6] == []
    back = fx.frame(spark, "tags").where("id = 1").select(F.array_join(tags.bio_to_iobes(F.split("tags", " ")), " ").alias("t"), tags.spans_to_tags(tags.tags_to_spans(F.split("tags", " ")), F.lit(5)).alias("b")).first()
    assert back.t == "B-PER E-PER O S-LOC S-LOC" and back.b == "B-PER I-PER O B-LOC B-LOC".split()


def test_relations_and_events(spark):
    got = relations.argument_roles(spark.createDataFrame([(1, "x", 0, 2), (1, "y", 5, 8)], "doc_id long, arg_id string, start int, end int"), fx.frame(spark, "tokens"), fx.frame(spark, "deps"))
    assert {r.arg_id: (r.syntactic_role, r.governing_verb) for r in got.collect()} == {"x": ("Subject", "喜欢"), "y": ("Object", "喜欢")}
    assert relations.crossing_arcs(fx.frame(spark, "deps")).count() == 0
    ok = {r.doc_id: r.ok for r in relations.acceptable(fx.frame(spark, "tokens"), fx.frame(spark, "deps")).collect()}
    assert ok == {1: True, 2: True}


def test_entity_titles(spark):
    got = {r.doc_id: (r.title_text, r.parts, r.location) for r in titles.entity_titles(fx.frame(spark, "entities"), fx.frame(spark, "facts")).collect()}
    assert got[1] == ("北京大学——大学、著名", ["大学", "著名"], "北京")
    assert got[2] == ("gadget——widget", ["widget"], "Paris")


def test_token_functions(spark):
    row = spark.range(1).select(
        text.token_windows(F.array(*map(F.lit, "abcdefg")), 4, 2).alias("w"), text.prepend_space(F.array(F.lit("ab"), F.lit("c"), F.lit("d")), F.lit("ab c" + "d")).alias("p"),
        text.mapped(F.array(F.lit("x"), F.lit("y")), {"x": "z"}).alias("m"), text.translate_chars(F.lit("漢語a"), {"漢": "汉", "語": "语"}).alias("c"),
    ).first()
    assert ["".join(w) for w in row.w] == ["abcd", "cdef", "efg"] and row.p == ["ab", " c", "d"] and row.m == ["z", "y"] and row.c == "汉语a"


def test_discovery_finds_a_repeated_word(spark):
    d = spark.createDataFrame([(1, "碳钢很硬。碳钢很强。他买碳钢了。我有碳钢吗。碳钢可用。这是碳钢。那是碳钢。看碳钢吧")], "doc_id long, text string")
    found = discovery.discover(d)
    got = {r.word: r for r in found.collect()}
    assert got["碳钢"].frequency == 8 and got["碳钢"].cohesion == 0.5 and got["碳钢"].left_entropy > 1
    kept = discovery.without_parts(found).orderBy("rank").collect()
    words = [(r.word, r.score) for r in kept]
    assert all(not (a in b and a != b and s <= t) for a, s in words for b, t in words)


def test_conll_round_trip(spark, tmp_path):
    lines = "# text\n1\tA\ta\tX\t_\t_\t2\tnsubj\t_\t_\n1-2\tAB\t_\t_\t_\t_\t_\t_\t_\t_\n2\tB\tb\tY\t_\t_\t0\troot\t_\t_\n\n1\tC\tc\tZ\t_\t_\t0\troot\t_\t_\n"
    (tmp_path / "x.conllu").write_text(lines)
    rows = readers.read_conll(spark, str(tmp_path / "x.conllu"))
    assert [(r.form, r.head) for r in rows.orderBy("sent_id", "id").collect()] == [("A", 2), ("B", 0), ("C", 0)]
    out = sorted(r.conll for r in writers.to_conll(rows).collect())
    assert out == ["1\tA\ta\tX\t_\t_\t2\tnsubj\t_\t_\n2\tB\tb\tY\t_\t_\t0\troot\t_\t_", "1\tC\tc\tZ\t_\t_\t0\troot\t_\t_"]


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("A\tB-X\nB\tO\n\nC\tO\n")
    assert [(r.token, r.tag) for r in readers.read_tagged(spark, str(tmp_path / "t.tsv")).orderBy("sent_id", "tok_idx").collect()] == [("A", "B-X"), ("B", "O"), ("C", "O")]
    (tmp_path / "n.jsonl").write_text(json.dumps({"doc_key": "d", "sentences": [["a", "b"], ["c"]], "ner": [[[0, 1, "P"], [0, 1, "P"]], [[2, 2, "L"]]]}) + "\n")
    assert sorted((r.sent_idx, r.start, r.end, r.label) for r in readers.read_json_spans(spark, str(tmp_path / "n.jsonl"), rename={"L": "LOC"}).collect()) == [(0, 0, 2, "P"), (1, 0, 1, "LOC")]
    parts = readers.split_rows(spark.range(1000), "id")
    assert sum(p.count() for p in parts) == 1000 and 700 < parts[0].count() < 900
    (tmp_path / "d0.tsv").write_text("# version: 1\n碳钢\tMATERIAL\t0.9\n")
    (tmp_path / "d1.tsv").write_text("碳钢\tPRODUCT\t0.8\n")
    d = readers.read_dictionary(spark, {"seed": str(tmp_path / "d0.tsv"), "user": str(tmp_path / "d1.tsv")})
    t = spark.createDataFrame([(1, "碳钢", 0, 2)], "doc_id long, text string, start int, end int")
    assert [r.category for r in entities.keywords(t, d).collect()] == ["PRODUCT"]


def test_writers(spark):
    meta = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, source string")
    s = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, sent_idx int, text string")
    docs = {r.doc_id: json.loads(r.document) for r in writers.to_documents(meta, sentences=s).collect()}
    assert docs[1]["sentences"] == [{"sent_idx": 0, "text": "a"}, {"sent_idx": 1, "text": "b"}] and docs[2]["sentences"] == []
    req = spark.createDataFrame([('{"id":1,"method":"tools/call","params":{"name":"summarize_text","arguments":{"text":"t"}}}',), ('{"id":2,"method":"nope"}',), ("bad",)], "value string")
    assert [r.error for r in writers.to_requests(req).collect()] == [None, -32601, -32603]


def test_analyze(spark):
    got = analyze(fx.frame(spark, "texts"), fx.frame(spark, "tokens"), fx.frame(spark, "deps"), fx.frame(spark, "frames"), fx.frame(spark, "candidates"))
    assert {"sentences", "segments", "patterns", "entities", "part_of", "relations", "noun_signals", "summary", "title"} <= set(got)
    assert all(t.count() >= 0 for t in got.values())
    assert got["entities"].where("category = 'NUMBER'").count() > 0
    assert entities.invalid(got["entities"]).count() == 0


def test_the_whole_analysis(spark):
    text = "陈胜者，阳城人也，字涉。碳钢公司生产钢材。该公司具有高强度。"
    words = "陈胜/NR 者/X ，/PU 阳城/NR 人也/X ，/PU 字涉/X 。/PU 碳钢/NN 公司/NN 生产/VV 钢材/NN 。/PU 该/DT 公司/NN 具有/VV 高强度/NN 。/PU".split()
    rows, at = [], 0
    for i, w in enumerate(words):
        word, tag = w.split("/")
        rows.append((1, i, word, tag, at, at + len(word)))
        at += len(word)
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    tokens = spark.createDataFrame(rows, "doc_id int, tok_idx int, text string, pos string, start int, end int")
    deps = spark.createDataFrame([(1, 9, 10, "nsubj"), (1, 8, 9, "nn"), (1, 10, -1, "root"), (1, 11, 10, "dobj"), (1, 14, 15, "nsubj"), (1, 15, 10, "conj"), (1, 16, 15, "dobj")], "doc_id int, child int, head int, rel string")
    frames = spark.createDataFrame([(1, 0, "碳钢公司", "ARG0", 8, 10), (1, 0, "生产", "PRED", 10, 11), (1, 0, "钢材", "ARG1", 11, 12), (1, 1, "该公司", "ARG0", 13, 15), (1, 1, "具有", "PRED", 15, 16), (1, 1, "高强度", "ARG1", 16, 17)], "doc_id int, frame_idx int, text string, role string, start int, end int")
    named = [("碳钢公司", "ORGANIZATION"), ("钢材", "PRODUCT"), ("陈胜", "PERSON"), ("阳城", "LOCATION"), ("高强度", "PARAMETER")]
    recognized = spark.createDataFrame([(1, f"r{i}", t, k, text.find(t), text.find(t) + len(t), "ner", 0.9) for i, (t, k) in enumerate(named)], "doc_id int, entity_id string, text string, category string, start int, end int, source string, confidence double")
    got = analyze(docs, tokens, deps, frames, recognized, options=Options(language="classical"))
    triples = {(r["subject"], r["predicate_verb"], r["object"]) for r in got["relations"].collect()}
    assert triples == {("碳钢公司", "生产", "钢材"), ("碳钢公司", "具有", "高强度")}  # 该公司 stands for the company
    assert {(r["subject"], r["predicate"], r["object"]) for r in got["classical_relations"].collect()} >= {("陈胜", "LOCATED_AT", "阳城"), ("陈胜", "HAS_STYLE_NAME", "涉")}
    assert {r["trigger"] for r in got["events"].collect()} == {"生产", "具有"}
    assert ("碳钢公司", "该公司") in {tuple(sorted([r["text"] for r in got["mentions"].where(f"chain_id = '{c['chain_id']}'").collect()], key=len, reverse=True)) for c in got["chains"].collect()}
    assert got["entity_titles"].count() == 1 and entities.invalid(got["entities"]).count() == 0
    again = analyze(docs, tokens, deps, frames, recognized, options=Options(discover=True))
    assert "new_words" in again and "events" not in again and again["tokens"].count() <= tokens.count()


def test_tables_by_document_stay_where_they_are(spark):
    tokens, deps = by_document(fx.frame(spark, "tokens")), by_document(fx.frame(spark, "deps"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = tokens.join(deps.withColumnRenamed("child", "tok_idx").hint("merge"), ["doc_id", "tok_idx"])
    for df in (tokens.groupBy("doc_id", "pos").count(), gathered(tokens=tokens, deps=deps), pairs):
        assert "Exchange" not in plan(df)
    # events and arguments are made of rows that are written once
    docs, seen = clause_documents(spark, "/root/testdata/sf0.001", "clause_frames"), []
    frame_events.of_frames(docs, lambda df: seen.append(df) or df)
    assert len(seen) == 1 and {"made", "doc_id"} <= set(seen[0].columns)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_similarities_by_pairs(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 7 + k % 3}" for k in range(i % 9)) for i in range(60)] + ["", "!"]
    words = [set(summary.WORD.findall(t)) for t in texts]
    told = [[len(a & b) / len(a | b) if i != j and a | b else 0.0 for j, b in enumerate(words)] for i, a in enumerate(words)]
    for pairs in (1, 40, 1 << 20):
        monkeypatch.setattr(summary, "PAIRS", pairs)  # so many are counted at a time
        monkeypatch.setattr(summary, "BLOCK_CELLS", 7 * len(texts))
        blocks = list(summary.similarity_rows(texts))
        assert [b.start for b, _ in blocks] == list(range(0, len(texts), 7))
        assert [row for _, sim in blocks for row in sim.tolist()] == told


def test_texts_are_ranked_by_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"One {i}. Two {i}. Three.") for i in range(40)], "doc_id long, text string").coalesce(1)
    for rows in (summary.summarize_text(docs), summary.ranked(docs)):
        assert rows.select("doc_id", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count() > 1


def test_compounds_of_tokens(spark):
    said = "石/NN 墨/NN 烯/NN 材/NN 料/NN 很/AD 好/VV 。/PU 石/NN 墨/JJ 的/DEG 石/NN 墨/VV 电池/NN 电池/VV".split()
    tokens = spark.createDataFrame([(1, i, *w.split("/")) for i, w in enumerate(said)], "doc_id int, tok_idx int, text string, pos string")
    text = "".join(w.split("/")[0] for w in said)
    sents = spark.createDataFrame([(1, 0, text[:8]), (1, 1, text[8:])], "doc_id int, sent_idx int, text string")
    got = {r["word"]: (r["frequency"], round(r["left_entropy"], 4), round(r["right_entropy"], 4), round(r["score"], 4)) for r in discovery.compounds(tokens, sents).collect()}
    # five single signs are a run of four, and one that is alone; 石墨 stands at two beginnings of sentences
    assert got == {"石墨烯材": (1, 0.0, 0.0, 6.0), "石墨": (3, 0.0, 1.585, 3.5), "电池": (2, 0.0, 0.0, 5.5)}
    assert discovery.compounds(tokens.where("doc_id > 1"), sents).count() == 0


def test_engine_sentences(spark):
    cases = {
        "叶": ["叶"], "他说：“加油。”谢谢": ["他说：“加油。”", "谢谢"], "Go to example.com. Yes.": ["Go to example.com.", "Yes."], "Mr. Fox met Dr. Owl. They left": ["Mr. Fox met Dr. Owl.", "They left"],
        "The U.S. army came. Ok": ["The U.S. army came.", "Ok"], "a\nb c": ["a", "b c"], "": [], "One!  Two? 3.5 three": ["One!", "Two?", "3.5 three"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.split_engine(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == list(cases.values())


def test_numbers_leave_out_what_is_taken(spark):
    docs = spark.createDataFrame([(1, "增长50%，共3个"), (2, "50%")], "doc_id int, text string")
    taken = spark.createDataFrame([(1, 2, 5)], "doc_id int, start int, end int")
    plain = {(r["doc_id"], r["text"]) for r in entities.numbers(docs).collect()}
    assert {(r["doc_id"], r["text"]) for r in entities.numbers(docs, taken=taken).collect()} == plain - {(1, "50%")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A b. C d."), (2, "E.")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = by_batch(stream, sentences.sentences, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    s = busy_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), length="1 hour", least=3)
    q = s.writeStream.format("memory").queryName("busy").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("busy").count() == busy_windows(events, length="1 hour", least=3).count()


def test_touching_entities_merge_only_as_they_should(spark):
    schema = "doc_id int, entity_id string, text string, category string, start int, end int, source string, confidence double"
    rows = [
        (1, "a", "北京", "LOCATION", 0, 2, "ner", 0.9), (1, "b", "立方庭", "LOCATION", 2, 5, "kw", 0.5), (1, "c", "海淀区", "LOCATION", 6, 9, "ner", 0.8), (1, "d", "中关村", "LOCATION", 9, 12, "ner", 0.8),
        (2, "a", "北京大学", "ORGANIZATION", 0, 4, "ner", 0.9), (2, "b", "北京", "ORGANIZATION", 0, 2, "ner", 0.9), (3, "a", "北京", "LOCATION", 0, 2, "ner", 0.9), (3, "b", "京大", "LOCATION", 1, 3, "ner", 0.9),
        (4, "a", "A/B", "PRODUCT", 0, 3, "ner", 0.9), (4, "b", "C", "PRODUCT", 3, 4, "ner", 0.9), (5, "a", "碳", "MATERIAL", 0, 1, "ner", 0.9), (5, "b", "钢", "LOCATION", 1, 2, "ner", 0.9),
    ]
    e = spark.createDataFrame(rows, schema)
    by_place = {(r["doc_id"], r["entity_id"]): (r["text"], r["start"], r["end"], r["confidence"], r["source"], r["parts"]) for r in entities.merge_touching(e).collect()}
    assert by_place[(1, "a")] == ("北京立方庭", 0, 5, 0.5, "ner", 2) and by_place[(1, "c")][0] == "海淀区中关村"
    assert sorted(k for k in by_place if k[0] > 1) == [(2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "a"), (4, "b"), (5, "a"), (5, "b")]
    tokens = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 2), (2, 5), (5, 6), (6, 9), (9, 12)])], "doc_id int, tok_idx int, start int, end int")
    deps = spark.createDataFrame([(1, 1, 0, "NN"), (1, 4, 2, "nn"), (1, 3, 4, "nn")], "doc_id int, child int, head int, rel string")
    by_arc = {r["entity_id"]: r["text"] for r in entities.merge_touching(e.where("doc_id = 1"), deps, tokens).collect()}
    assert by_arc == {"a": "北京立方庭", "c": "海淀区", "d": "中关村"}
