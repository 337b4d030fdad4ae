from textloom.operators import entities

COLUMNS = "doc_id long, entity_id string, text string, category string, start int, end int, source string, confidence double"
ROWS = [
    (1, "a", "北京市", "LOCATION", 0, 3, "pku", 0.5), (1, "b", "北京", "ORGANIZATION", 0, 2, "msra", 0.9), (1, "c", "上海", "LOCATION", 5, 7, "pku", 0.5),
    (2, "a", "北京市", "LOCATION", 0, 3, "pku", 0.5), (2, "b", "北京", "LOCATION", 0, 2, "msra", 0.9),
    (3, "b", "xy", "A", 0, 2, "s", 0.7), (3, "a", "xy", "B", 0, 2, "t", 0.7), (3, "c", "xy", None, 0, 2, "u", None),
]


def test_losers_of_disputes_go_and_documents_share_a_call(spark):
    found = entities.resolve_conflicts(spark.createDataFrame(ROWS, COLUMNS))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.entity_id, r.ner_disputed, r.ner_labels) for r in found.collect())
    assert got == [
        (1, "b", True, {"pku": "LOCATION", "msra": "ORGANIZATION"}), (1, "c", False, {}),
        (2, "a", False, {}), (2, "b", False, {}),
        (3, "a", True, {"s": "A", "t": "B", "u": None}),
    ]
