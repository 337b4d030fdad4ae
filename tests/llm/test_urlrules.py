import random

import pytest

from textloom.llm import queries
from textloom.llm.urlrules import Index, Rule, allowed, judge, parts


def slow(url, rules, default="allow"):
    import re

    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (r.pattern is None or re.search(r.pattern, url or ""))]
    best = min(fits, key=Rule.order, default=None)
    return host, path, best and best.text, best.action if best else default


@pytest.mark.parametrize(
    "url,want",
    [
        (None, ("", "")),
        ("no scheme/x", ("", "")),
        ("http://A.Example.COM", ("a.example.com", "")),
        ("http://É.com/É?x#y", ("É.com", "/É")),
        ("a://b://c/d", ("b:", "//c/d")),
        ("http://h?x/y", ("h", "")),
        ("http://h#x?y/", ("h", "")),
        ("http://h/p#x?y", ("h", "/p")),
        ("://", ("", "")),
    ],
)
def test_parts(url, want):
    assert parts(url) == want


URLS = [None, "", "x", "://", "http://org/es/", "http://ORG/es/1?q", "http://a.org/es", "http://b.example.com/en/70", "http://com/en/", "http://xcom/en/", "http://example.net/de/8#x", "http://example.net/de/7", "http://net//de/", "http://x.net/de/?/y"]


def test_judge_against_all_rules(spark):
    rng = random.Random(1)
    hosts, segments = ["a.com", "b.com", "com", "x.a.com", "net"], ["", "en", "de", "7", "a.b", "en7"]
    urls = URLS + [f"http://{rng.choice(hosts)}/{'/'.join(rng.choice(segments) for _ in range(3))}" for _ in range(300)]
    rules = [Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/"]) + "/".join(rng.choice(segments) for _ in range(rng.randint(0, 2)))) for _ in range(40)]
    rules += [Rule("block", "", "/"), Rule("block", "com", "/", r"e.*7$"), *queries.URL_RULES]
    frame = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, id string")
    for block in (1000, 7):
        got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in judge(frame, rules, block_rules=block).collect()}
        assert got == {i: slow(u, rules) for i, u in enumerate(urls)}
    kept = allowed(frame, rules)
    assert kept.schema == frame.schema
    assert sorted(r.page_id for r in kept.collect()) == [i for i, u in enumerate(urls) if slow(u, rules)[3] == "allow"]


def test_rules_are_filed_under_the_rarest_token():
    index = Index([Rule("block", "shop.example.com", "/en/x")], {"com": 9, "example": 5, "shop": 1, "/en": 3})
    assert list(index.by_token) == ["shop"]


def test_no_rules_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in judge(frame, []).collect()] == [(1, "http://a/b", "a", "/b", None, "allow")]
    assert judge(frame.limit(0), queries.URL_RULES).count() == 0


def test_allowed_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "http://a.com/x", 5, "u"), (2, "http://b.org/x", 6, "v"), (3, None, 7, "w")], "page_id int, url string, __blocked int, verdict string")
    kept = allowed(frame, [Rule("block", "com", "/x")])
    assert kept.columns == frame.columns and sorted(r["page_id"] for r in kept.collect()) == [2, 3]
