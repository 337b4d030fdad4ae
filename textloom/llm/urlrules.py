"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host, which it fits with all its subdomains, and how the path starts; it may add a regular expression
for the whole url. Its literal tokens are the labels of the host and the whole segments of the path prefix. Each rule
is filed under the one of its tokens that fewest urls of the table have, counted over the whole table; the tokens of a
url fetch the rules filed under them, and only those are tried. Of the rules that fit, the longest decides.

Rules come to the workers in blocks of bounded number (``BLOCK_RULES``), each block a pass that improves on the
decision so far, so any number of rules can be used.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged by the default; hosts and
paths may hold any characters; equally long rules: the first by text, block before allow; rows with equal ids are
judged each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, free_name

BLOCK_RULES = 200_000
SPLIT = re.compile(r"[./]+")


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block; ``pattern`` must be found in the url, if given."""

    action: str
    host: str
    path: str = "/"
    pattern: str | None = None

    @property
    def text(self) -> str:
        return self.host + self.path

    def order(self) -> tuple[int, str, bool]:
        return -len(self.text), self.text, self.action != "block"

    def tokens(self) -> list[str]:
        """Literals that every url has among its own tokens when the rule fits: a path may go on right after the prefix,
        so the last segment is whole only if the prefix ends in a slash."""
        whole = self.path[: self.path.rfind("/") + 1]
        return [t for t in [*self.host.split("."), *("/" + s for s in whole.split("/"))] if t not in ("", "/")]

    def regex(self) -> re.Pattern[str]:
        """The rule as one expression over host and path joined by a line feed, and then the url."""
        own = rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}"
        return re.compile(own, re.DOTALL)


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.partition(c)[0]
    return rest[:cut].translate(LOWER), path


LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(host: str, path: str) -> set[str]:
    return {t for t in [*host.split("."), *("/" + s for s in path.split("/"))] if t not in ("", "/")}


class Index:
    """Rules by their rarest token; rules without any are tried on every url."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[tuple, Rule, re.Pattern[str], re.Pattern[str] | None]]] = {}
        for rule in rules:
            token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")
            entry = rule.order(), rule, rule.regex(), re.compile(rule.pattern) if rule.pattern else None
            self.by_token.setdefault(token, []).append(entry)
        for entries in self.by_token.values():
            entries.sort(key=lambda e: e[0])

    def candidates(self, host: str, path: str) -> list:
        get = self.by_token.get
        return [e for t in ("", *tokens(host, path)) for e in get(t, ())]

    def best(self, url: str | None, host: str, path: str) -> tuple[tuple, Rule] | None:
        """The deciding rule of this index and its order, or None."""
        joined, found = f"{host}\n{path}", None
        for order, rule, own, more in self.candidates(host, path):
            if (found is None or order < found[0]) and own.match(joined) and (more is None or more.search(url or "")):
                found = order, rule
        return found


def token_counts(urls: DataFrame, url_col: str, wanted: Sequence[str]) -> dict[str, int]:
    """How many urls of the whole table have each of the wanted tokens, which are those of one block of rules."""
    spark = urls.sparkSession
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")).otherwise("")
    bare = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(bare, "^([^/]*)", 1)
    path = F.expr("transform(split(substring(bare, length(host) + 1), '/'), s -> concat('/', s))")
    found = urls.select(bare.alias("bare"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"))
    found = found.select(F.explode(F.array_distinct(F.concat(F.split("host", r"\."), path))).alias("token"))
    wanted_table = spark.createDataFrame([(t,) for t in wanted], "token string")
    counts = found.groupBy("token").count()
    return dict(counts.join(wanted_table, "token", "left_semi").collect())  # bounded by the block


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """A row (id, url, host, path, rule, verdict) for each row of ``pages``; rule is the text of the deciding one."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = urls.schema["id"].dataType.simpleString()
    now = urls.select("id", "url", *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "rule", "verdict")])
    for k in range(0, max(1, len(rules)), block_rules):
        block = rules[k : k + block_rules]
        counts = token_counts(urls, "url", sorted({t for r in block for t in r.tokens()}))
        index = urls.sparkSession.sparkContext.broadcast(Index(block, counts))

        def batch(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            out: list[tuple] = []
            for url, was, action in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                host, path = parts(url)
                found = index.value.best(url, host, path)
                if found and (was is None or found[0] < (-len(was), was, action != "block")):
                    was, action = found[1].text, found[1].action
                out.append((host, path, was, action if was is not None else default))
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in columns)], b.schema.names)

        now = arrow_map(now, batch, f"id {kind}, url string, host string, path string, rule string, verdict string")
    return now


def allowed(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` without the rows whose url is blocked: the distinct urls are judged and joined back. Other columns may have
    any names."""
    verdicts = judge(pages.select(F.col(url_col).alias("url")).distinct().withColumn("id", F.lit(0)), rules, "id", "url", default)
    name = free_name(pages, "__blocked")
    blocked = verdicts.where("verdict = 'block'").select(F.col("url").alias(name))
    return pages.join(blocked, F.col(url_col).eqNullSafe(F.col(name)), "left_anti")
