"""Language identification: held-out accuracy, the filters against sets, and odd rows."""

import numpy as np
import pytest

from textloom.llm import langid, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.where("crc32(cast(doc_id as string)) % 3 <> 1"))


def test_held_out_rows_by_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op11_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held) and len(held) > 250
    assert all(0 <= r["score"] <= 1 for r in rows)


def texts(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


def test_odd_texts(spark, model):
    found, lang, score = langid.predict(texts(spark, [None, "", " 12 !\n", "日本語", "The", "a" * 3_000_000, "of the and " * 200_000]), model)
    rows = found.collect()
    assert [r[lang] for r in rows[:3]] == ["und"] * 3 and [r[score] for r in rows[:3]] == [0.0] * 3
    assert rows[3][lang] in model.languages and rows[6][lang] == "en"
    assert langid.predict(texts(spark, []), model)[0].count() == 0


def test_columns_stay_and_clash(spark, model):
    docs = spark.createDataFrame([(1, "of the", "x", 2.0)] * 2, "id long, text string, lang_pred string, score double")
    found, lang, score = langid.predict(docs, model)
    assert (lang, score) == ("lang_pred_", "score_") and found.columns[:4] == docs.columns
    assert [(r["lang_pred"], r["text"]) for r in found.collect()] == [("x", "of the")] * 2
    assert langid.predict(docs, model, keep_text=False)[0].where("text is not null").isEmpty()


def test_nothing_learnt_and_ties(spark):
    schema = "doc_id long, text string, lang string"
    none = langid.fit(spark.createDataFrame([(1, None, "en"), (2, "a", None)], schema))
    assert langid.judged(none, ["abc", None]) == (["und", "und"], [0.0, 0.0])
    two = langid.fit(spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x"), (3, "abc", "z"), (4, "abc", "z")], schema), kept=50)
    assert two.languages == ["z", "x", "y"]
    assert langid.judged(two, ["abc", "ŋŋŋŋ"])[0] == ["z", "z"]


def test_many_languages_and_slices(spark):
    rows = [(i, chr(0x400 + 3 * i) * 3 + " " + chr(0x401 + 3 * i), f"l{i:02}") for i in range(20)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), kept=64)
    assert m.slots.shape[0] == 3
    assert langid.judged(m, [r[1] for r in rows])[0] == [r[2] for r in rows]


def test_counts_are_corrected_for_chance(model):
    """Look-ups of n-grams that no language holds leave nothing after the correction."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    at = list(langid.slots_of(hashes, model.slots.shape[1]))
    mask = model.slots[0][at[0]] & model.slots[0][at[1]] & model.slots[0][at[2]]
    for i in range(len(model.languages)):
        assert abs((mask >> i & 1).mean() - model.chance[i]) < 0.003


def test_no_n_gram_crosses_texts():
    alone = [langid.grams(*langid.signs([t])[:2], (1, 2, 3, 4))[0] for t in ("ab c", "de", "")]
    hashes, owner = langid.grams(*langid.signs(["ab c", "de", ""])[:2], (1, 2, 3, 4))
    for k, want in enumerate(alone):
        assert sorted(hashes[owner == k]) == sorted(want)


def test_pieces_count_as_the_whole():
    texts = ["one two three four " * 50, None, "x" * 100]
    places = [p for ps, _ in langid.parts_of(texts, 64) for p in ps]
    joined = {k: "".join(t for ps, lot in langid.parts_of(texts, 64) for p, t in zip(ps, lot, strict=True) if p == k) for k in set(places)}
    assert joined == {0: texts[0], 2: texts[2]}
