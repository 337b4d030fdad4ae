"""Decoders against all possible answers, other operators against cases worked out by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import annotations, decoding, dictionaries, entities, modifiers, relations
from textloom.sources import readers


def test_best_tags_against_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        e, t, s, z = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
        score = lambda p: s[p[0]] + z[p[-1]] + sum(e[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))
        assert tuple(decoding.best_tags(e.tolist(), t.tolist(), s.tolist(), z.tolist())) == max(itertools.product(range(3), repeat=n), key=score)
    assert decoding.best_tags([], [[0]]) is None


def reaches_root(heads):
    for i in range(1, len(heads) + 1):
        at, steps = i, 0
        while at:
            at, steps = heads[at - 1], steps + 1
            if steps > len(heads):
                return False
    return True


def crossing(heads):
    arcs = [(min(i, h), max(i, h)) for i, h in enumerate(heads, 1)]
    return any(a < c < b < d for a, b in arcs for c, d in arcs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_trees_against_all_trees(n):
    rng = np.random.default_rng(n)
    every = [h for h in itertools.product(range(n + 1), repeat=n) if all(i != x for i, x in enumerate(h, 1)) and reaches_root(h)]
    for _ in range(20):
        s = rng.normal(size=(n + 1, n + 1))
        total = lambda h: sum(s[i, x] for i, x in enumerate(h, 1))
        assert total(decoding.spanning_heads(s.tolist())) == pytest.approx(max(map(total, every)))
        got = decoding.projective_heads(s.tolist())
        assert reaches_root(got) and not crossing(got)
        assert total(got) == pytest.approx(max(total(h) for h in every if not crossing(h)))
    for h in itertools.product(range(n + 1), repeat=n):
        assert decoding.tree(list(h)) == (sum(x == 0 for x in h) == 1 and reaches_root(h))


def test_brackets_against_all_bracketings():
    def all_of(i, j):
        if j - i == 1:
            return [[(i, j)]]
        return [[(i, j), *a, *b] for k in range(i + 1, j) for a in all_of(i, k) for b in all_of(k, j)]

    rng = np.random.default_rng(3)
    for n in range(1, 7):
        s = rng.normal(size=(n + 1, n + 1, 3))
        got = decoding.best_brackets(s.tolist())
        assert sum(s[i, j, x] for i, j, x in got) == pytest.approx(max(sum(s[i, j].max() for i, j in t) for t in all_of(0, n)))


def test_lemma_rules():
    for form, lemma, rule in [("walked", "walk", "↓0;d¦--"), ("Running", "run", "↓0;d¦----"), ("is", "be", "↓0;abe"), ("paris", "Paris", "↑0¦↓1;d¦"), ("a+b-", "a+", "↓0;d¦--")]:
        assert decoding.rule_of(form, lemma) == rule and decoding.by_rule(form, rule) == lemma
    rng = random.Random(2)
    for _ in range(500):
        form, lemma = ("".join(rng.choice("abAB+-é") for _ in range(rng.randint(1, 7))) for _ in range(2))
        for copies in (False, True):
            assert decoding.by_rule(form, decoding.rule_of(form, lemma, copies)) == lemma
    assert decoding.by_rule("Word", "_") == "word" and decoding.by_rule("a", "↓0;d----¦") == "a"


def test_dictionaries(spark):
    rows = spark.createDataFrame([("商品和服务行业", ["商品", "和", "服务", "行业"]), ("", []), (None, None)], "text string, tokens array<string>")
    pieces = [r[0] for r in rows.select(F.transform(dictionaries.forced(F.col("text"), {"和服", "服务行业"}), lambda p: p["text"])).collect()]
    assert pieces == [["商品", "和服", "务行业"], [], None]
    pieces = rows.select(dictionaries.forced(F.col("text"), {"和服务": ["和", "服务"]})).first()[0]
    assert [(p.text, p.start, p.end, p.known) for p in pieces] == [("商品", 0, 2, False), ("和", 2, 3, True), ("服务", 3, 5, True), ("行业", 5, 7, False)]
    assert [r[0] for r in rows.select(dictionaries.combined(F.col("tokens"), {"和服", "服务行业"})).collect()] == [["商品", "和", "服务行业"], [], None]
    assert rows.select(dictionaries.combined(F.col("tokens"), {("商品", "和"), ("和服务", "行业")})).first()[0] == ["商品和", "服务", "行业"]
    tags = rows.select(dictionaries.overridden(F.col("tokens"), F.array(*[F.lit("X")] * 4), {("和", "服务"): ("A", "B"), "服务": "C", "商品": "D"})).first()[0]
    assert tags == ["D", "A", "B", "X"]
    spans = spark.createDataFrame([([("P", 0, 1), ("P", 1, 2), ("Q", 2, 3)], ["商", "品", "和"], [0.5, 1.0])], "s array<struct<label:string,start:int,end:int>>, t array<string>, c array<double>")
    kept = spans.select(dictionaries.with_confidence(dictionaries.allowed_spans(F.col("s"), F.col("t"), {"和"}, {"P"}, ""), F.col("c"))).first()[0]
    assert [tuple(k) for k in kept] == [("P", 0, 2, 0.75)]
    kept = spans.select(dictionaries.with_confidence(dictionaries.allowed_spans(F.col("s"), F.col("t"), {"x"}), F.col("c"))).first()[0]
    assert [tuple(k) for k in kept] == [("P", 0, 1, 0.5), ("P", 1, 2, 1.0), ("Q", 2, 3, 1.0)]


ENTITY = "doc_id long, entity_id string, text string, category string, start int, end int, source string, confidence double"


def test_conflicting_spans(spark):
    def kept(*rows):
        frame = spark.createDataFrame([(1, i, t, c, s, s + len(t), "x", p) for i, t, c, s, p in rows], ENTITY)
        return {r.entity_id for r in entities.without_crossings(frame).collect()}

    big = ("a", "北京大学", "ORGANIZATION", 0, 0.9)
    assert kept(big, ("b", "北京", "LOCATION", 0, 0.9)) == {"a", "b"}
    assert kept(big, ("b", "北京", "LOCATION", 0, 0.6)) == {"a"}
    assert kept(big, ("b", "北", "LOCATION", 0, 0.1)) == {"a", "b"}
    assert kept(big, ("b", "北京", "ORGANIZATION", 0, 0.1)) == {"a", "b"}
    assert kept(big, ("b", "北京大学", "LOCATION", 0, 0.9)) == {"a"} and kept(big, ("b", "北京大学", "LOCATION", 0, 0.95)) == {"b"}
    assert kept(("a", "abc", "X", 0, 0.5), ("b", "bcd", "Y", 1, 0.1)) == {"a", "b"}
    assert kept(("a", "abc", "X", 0, 0.5), ("b", "bcd", "X", 1, 0.5)) == {"b"} and kept(("a", "abc", "X", 0, 0.5), ("b", "bcd", "X", 1, 0.4)) == {"a"}


def test_cross_category(spark):
    rows = [(1, "a", "北京", "LOCATION", 0, 2, "n", 0.9), (1, "b", "大学", "ORGANIZATION", 2, 4, "n", 0.7), (1, "c", "学院", "ORGANIZATION", 4, 6, "n", 0.8), (1, "d", "手机", "PRODUCT", 7, 9, "n", 0.8), (2, "a", "碳", "MATERIAL", 0, 1, "n", 0.5), (2, "b", "钢", "MATERIAL", 1, 2, "n", 0.6), (2, "c", "管", "MATERIAL", 2, 3, "n", 0.6)]
    got = sorted((r.doc_id, r.entity_id, r.text, r.category, r.start, r.end, r.confidence) for r in annotations.cross_category(spark.createDataFrame(rows, ENTITY)).collect())
    assert got == [(1, "a", "北京大学学院", "ORGANIZATION", 0, 6, 0.7), (1, "d", "手机", "PRODUCT", 7, 9, 0.8), (2, "a", "碳钢", "MATERIAL", 0, 2, 0.5), (2, "c", "管", "MATERIAL", 2, 3, 0.6)]


def test_proper_names(spark):
    words = [("清华", "NR"), ("大学", "NR"), ("的", "NR"), ("张三", "NR"), ("去", "VV"), ("王", "NR"), ("李四", "NR"), ("北京", "NR"), ("上海", "NR")]
    rows, at = [], 0
    for i, (w, pos) in enumerate(words):
        rows.append((1, i, w, pos, at, at + len(w)))
        at += len(w) + (i == 7)
    tokens = spark.createDataFrame(rows, "doc_id long, tok_idx int, text string, pos string, start int, end int")
    taken = spark.createDataFrame([(1, 13, 15), (1, 99, 100)], "doc_id long, start int, end int")
    got = sorted((r.start, r.text, r.category) for r in annotations.proper_names(tokens, taken).collect())
    assert got == [(0, "清华大学", "ORGANIZATION"), (5, "张三", "UNKNOWN"), (9, "李四北京", "UNKNOWN")]


def test_frames_and_documents(spark):
    rows = spark.createDataFrame([([[["a", "PRED", "0", "1"], ["b", "ARG0", "1", "x"]], [["c", "PRED", "0", "1"]], [["a"], ["b"]], [["d", "PRED", "2", "3"], ["e", "ARG1", "3.0", "4"]]],)], "f array<array<array<string>>>")
    got = rows.select(annotations.valid_frames(F.col("f"))).first()[0]
    assert [[tuple(i) for i in f] for f in got] == [[("a", "PRED", 0, 1)], [("d", "PRED", 2, 3), ("e", "ARG1", 3, 4)]]
    one = spark.createDataFrame([({"tok/fine": ["a"], "tok/coarse": ["b"], "pos": ["NN", "VV"]}, [["s"]])], "m map<string,array<string>>, s array<array<string>>")
    got = one.select(annotations.by_prefix(F.col("m"), "tok"), annotations.translated(F.col("m")["pos"], {"NN": "noun"}), annotations.squeezed(F.col("s")), annotations.by_prefix(F.col("m"), "x")).first()
    assert tuple(got) == (["b"], ["noun", "VV"], ["s"], None)


def test_light_verbs_are_no_events(spark):
    rows = [(1, "r1", 0, "a", "X", "是", "b", "srl"), (1, "r2", 0, "a", "X", "去", "b", "classical_pattern/z"), (1, "r3", 0, "a", "X", "去", "c", "srl"), (1, "r4", 0, "a", "X", "去", "a", "srl")]
    found = relations.events(spark.createDataFrame(rows, "doc_id long, rel_id string, sentence_index int, subject string, predicate string, predicate_verb string, object string, source string"))
    assert [(r.trigger, r.relation_ids) for r in found.collect()] == [("去", ["r3"])]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("blank", ["", " ", "\t"])
def test_sentences_of_files_with_other_line_ends(spark, tmp_path, end, blank):
    lines = ["# c", "1\ta\t_\tX", "2\tb\t_\tY", blank, blank, "1\tc\t_\tZ", blank, "1\td\t_\tZ"]
    (tmp_path / "x.conll").write_bytes(end.join(lines).encode())
    got = sorted((r.sent_id, r.id, r.form) for r in readers.read_conll(spark, str(tmp_path / "x.conll"), ["id", "form", "lemma", "upos"]).collect())
    assert got == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c"), (2, 1, "d")]


def test_sentences_across_splits(spark, tmp_path):
    (tmp_path / "y.conll").write_text("\n\n".join("\n".join(f"{k}\tw{s}_{k}" for k in range(1, 4)) for s in range(400)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
        rows = readers.read_conll(spark, str(tmp_path / "y.conll"), ["id", "form"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.sent_id, r.id, r.form) for r in rows) == [(s, k, f"w{s}_{k}") for s in range(400) for k in range(1, 4)]


def test_modifiers(spark):
    words = {"degree": ["非常", "极"], "temporal": ["将", "即将", "已"], "other": ["极", "常"]}
    texts = spark.createDataFrame([(1, "将军非常快地即将到来。极远的地方有一座已废弃的城，将来再说"), (2, "极"), (3, None)], "doc_id long, text string")
    rels = spark.createDataFrame([(1, "r1", 0, 8), (2, "r1", 0, 1), (3, "r1", 0, 1)], "doc_id long, rel_id string, start int, end int")
    tokens = spark.createDataFrame([(1, 0, 1, "P"), (1, 1, 2, "NN")], "doc_id long, start int, end int, pos string")
    got = lambda t=None: sorted((r.doc_id, r.start, r.end, r.text, r.type) for r in modifiers.relation_modifiers(rels, texts, words, t).collect())
    rest = [(1, 2, 4, "非常", "degree"), (1, 6, 8, "即将", "temporal"), (1, 11, 12, "极", "degree"), (2, 0, 1, "极", "degree")]
    assert got() == [(1, 0, 1, "将", "temporal"), *rest] and got(tokens) == rest
