"""Bracketed trees as tables of spans, and back, without a parser: depths are counted over brackets, tree by tree.

Tables: trees (sent_id, tree) with text such as ``(S (NP (NN rain)) (VP (VV falls)))``; nodes (sent_id, node, parent, depth,
label, start, end, tag) with spans in words, where node is the place of the bracket; words (sent_id, idx, text).
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

SIGNS = r"\(|\)|[^\s()]+"
TOLD, HYPHENED = re.compile(SIGNS, re.ASCII), re.compile("^([^\n\r\x85\u2028\u2029]+?)-[^\n\r\x85\u2028\u2029]*$")

NODE = "node int, parent int, depth int, label string, parent_label string, start int, end int, childless boolean"
CONSTITUENT, EVENT = "start int, end int, label string, nth int", "place int, kind int, rank int, said string"


def walked(tree: str) -> tuple[list[tuple], list[str]]:
    """The nodes (node, depth, label, start, end) of a tree in order, and its words: within one depth brackets open and close in turn."""
    own = TOLD.findall(tree)
    depth = 0
    last, opened, found, said = "", {}, [], []
    for place, sign in enumerate(own):
        if sign == "(":
            depth += 1
            opened[depth] = place, len(said)
        elif sign == ")":
            if depth in opened:
                begin, start = opened.pop(depth)
                label = own[begin + 1]
                found.append((begin, depth, "" if label in ("(", ")") else label, start, len(said)))
            depth -= 1
        elif last != "(":
            said.append(sign)
        last = sign
    found.sort()
    return found, said


def with_parents(found: list[tuple]) -> list[tuple]:
    """The nodes with the parent, its label and whether they have no children: as in ``NODE``."""
    above, parents, has = {}, [], set()
    for node, depth, *_ in found:
        parents.append(above.get(depth - 1))
        has.add(parents[-1])
        above[depth] = node
    labels = {x[0]: x[2] for x in found}
    return [(n, p, d, label, labels.get(p), s, e, n not in has) for (n, d, label, s, e), p in zip(found, parents, strict=True)]


def of_each(trees: pa.Array, fields: str, of: Callable[[str], list[tuple]]) -> pa.Array:
    """A list of rows for each tree; equal trees of a batch are walked once."""
    told = trees.dictionary_encode()
    rows, sizes = [], [0]
    for tree in told.dictionary.to_pylist():
        rows += of(tree)
        sizes.append(len(rows))
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    made = pa.StructArray.from_arrays([pa.array(c, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[k]) for c, k in zip(columns, kinds, strict=True)], names)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), made).take(told.indices)


def list_of(fields: str) -> str:
    return f"array<struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>>"


def closed_brackets(tree: Column | str) -> Column:
    """The nodes of each tree."""

    @F.arrow_udf(list_of(NODE))
    def run(trees: pa.Array) -> pa.Array:
        return of_each(trees, NODE, lambda t: with_parents(walked(t)[0]))

    return run(tree)


def constituents_in(tree: Column | str, subcategories: bool = True) -> Column:
    """``constituents`` of a tree as an array of (start, end, label, nth), the nth of those that are else the same."""

    def of(t: str) -> list[tuple]:
        seen, out = Counter(), []
        for *_, label, _, start, end, childless in with_parents(walked(t)[0]):
            if start < end and not (childless and end - start == 1):
                key = start, end, label if subcategories else HYPHENED.sub(r"\1", label)
                out.append((*key, seen[key]))
                seen[key] += 1
        return out

    @F.arrow_udf(list_of(CONSTITUENT))
    def run(trees: pa.Array) -> pa.Array:
        return of_each(trees, CONSTITUENT, of)

    return run(tree)


def events_in(tree: Column | str) -> Column:
    """What ``bracketed`` puts in order, of the nodes and words of a tree, as an array."""

    def of(t: str) -> list[tuple]:
        found, said = walked(t)
        return [e for _, depth, label, start, end in found for e in ((start, 1, depth, "(" + label), (end, 0, -depth, ")"))] + [(i, 2, 0, w) for i, w in enumerate(said)]

    @F.arrow_udf(list_of(EVENT))
    def run(trees: pa.Array) -> pa.Array:
        return of_each(trees, EVENT, of)

    return run(tree)


def told_in_order(events: Column | str) -> Column:
    """The text of a tree by its events."""
    return F.replace(F.array_join(F.transform(F.array_sort(events), lambda e: e["said"]), " "), F.lit(" )"), F.lit(")"))


def nodes(trees: DataFrame, subcategories: bool = True, parent_labels: bool = False) -> DataFrame:
    """One row for each bracket. Within one depth brackets open and close in turn, and a node's parent is the last bracket
    opened one level up. ``tag``: it holds nothing but a word. Without ``subcategories`` labels end before a hyphen, but for
    one at their beginning. A bracket that is never closed gives no node; one without a label has the empty label. A tree is
    walked where it is, without a shuffle. With ``parent_labels`` the parent's label is told besides."""
    rows = trees.select("sent_id", F.inline(closed_brackets("tree")))
    short = lambda c: F.col(c) if subcategories else F.regexp_replace(c, "^(.+?)-.*$", "$1").alias(c)
    tag = (F.col("childless") & (F.col("end") - F.col("start") == 1)).alias("tag")
    return rows.select("sent_id", "node", "parent", "depth", short("label"), "start", "end", tag, *([short("parent_label")] if parent_labels else []))


def words(trees: DataFrame) -> DataFrame:
    """Rows (sent_id, idx, text) of the words of the trees."""
    every = F.regexp_extract_all("tree", F.lit(SIGNS), F.lit(0))
    rows = trees.select("sent_id", every.alias("s"))
    own = F.filter("s", lambda x, i: ~x.isin("(", ")") & ((i == 0) | (F.get("s", i - 1) != "(")))
    return rows.select("sent_id", F.posexplode(own).alias("idx", "text"))


def constituents(rows: DataFrame) -> DataFrame:
    """Nodes that are compared: no tags, and no node without words."""
    return rows.where("not tag and start < end").select("sent_id", "start", "end", "label")


def bracketed(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Trees (sent_id, tree) from nodes (sent_id, depth, label, start, end), each with a word, and words; of nodes with one
    span the one of less depth is the outer."""
    event = lambda place, kind, rank, said: F.struct(place.alias("place"), F.lit(kind).alias("kind"), rank.alias("rank"), said.alias("said"))
    one = rows.select("sent_id", F.explode(F.array(event(F.col("start"), 1, F.col("depth"), F.concat(F.lit("("), "label")), event(F.col("end"), 0, -F.col("depth"), F.lit(")")))).alias("e"))
    own = texts.select("sent_id", event(F.col("idx"), 2, F.lit(0), F.col("text")).alias("e"))
    listed = one.unionByName(own).groupBy("sent_id").agg(F.collect_list("e").alias("es"))
    return listed.select("sent_id", told_in_order("es").alias("tree"))
