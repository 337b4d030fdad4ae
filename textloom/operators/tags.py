"""Tagging schemes and spans: each sentence is an array of tags, folded or indexed where it lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<label:string,start:int,end:int>>"


def kind(tag: Column) -> Column:
    return F.upper(F.substring(tag, 1, 1))


def label(tag: Column) -> Column:
    return F.substring(tag, 3, 1 << 20)


def tags_to_spans(tags: Column) -> Column:
    """Spans (label, start, end) of BIO, IOB1, IOBES, BIOUL and BMES tags alike.

    A span begins at B, S or U, and at any other tag that does not go on from the one before with its label; it ends
    before such a beginning, before O, and after E, L, S or U.
    """

    def step(acc: Column, pair: Column) -> Column:
        tag, i = pair["tag"], pair["i"]
        k, name = kind(tag), label(tag)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        goes_on = acc["open"] & ~k.isin("B", "S", "U", "O") & (last["label"] == name)
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["label"].alias("label"), last["start"].alias("start"), (i + 1).alias("end"))))
        fresh = F.concat(acc["out"], F.array(F.struct(name.alias("label"), i.alias("start"), (i + 1).alias("end"))))
        out = F.when(k == "O", acc["out"]).when(goes_on, grown).otherwise(fresh)
        return F.struct(out.alias("out"), (~k.isin("O", "E", "L", "S", "U")).alias("open"))

    start = F.struct(F.array().cast(SPANS).alias("out"), F.lit(False).alias("open"))
    return F.aggregate(F.transform(tags, lambda t, i: F.struct(t.alias("tag"), i.alias("i"))), start, step, lambda acc: acc["out"])


def spans_to_tags(spans: Column, n: Column, begin: str = "B", inside: str = "I", end: str | None = None, single: str | None = None) -> Column:
    """Tags of ``n`` tokens from spans that do not overlap; with ``end`` and ``single`` for IOBES, BMES and BIOUL."""
    end, single = end or inside, single or begin

    def tag(i: Column) -> Column:
        s = F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"])), 0)
        first, last = s["start"] == i, s["end"] == i + 1
        mark = F.when(first & last, single).when(first, begin).when(last, end).otherwise(inside)
        return F.when(s.isNull(), "O").otherwise(F.concat(mark, F.lit("-"), s["label"]))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), tag)).otherwise(F.array().cast("array<string>"))


def words_to_bmes(words: Column) -> Column:
    """A tag for each character: S for words of one, else B, M and E."""
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) == 1, F.array(F.lit("S"))).otherwise(F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("M"), F.length(w) - 2), F.array(F.lit("E"))))))


def bmes_to_words(chars: Column, tags: Column) -> Column:
    """Characters joined to words that begin at B and S."""
    pairs = F.arrays_zip(chars.alias("c"), tags.alias("t"))

    def step(acc: Column, p: Column) -> Column:
        begins = p["t"].isin("B", "S") | (F.size(acc) == 0)
        return F.when(begins, F.concat(acc, F.array(p["c"]))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.get(acc, F.size(acc) - 1), p["c"]))))

    return F.aggregate(pairs, F.array().cast("array<string>"), step)


def bio_to_iobes(tags: Column) -> Column:
    """The last tag of a span becomes E, a span of one S."""
    following = lambda i: kind(F.coalesce(F.get(tags, i + 1), F.lit("O"))) == "I"
    return F.transform(tags, lambda t, i: F.when((kind(t) == "B") & ~following(i), F.concat(F.lit("S"), F.substring(t, 2, 1 << 20))).when((kind(t) == "I") & ~following(i), F.concat(F.lit("E"), F.substring(t, 2, 1 << 20))).otherwise(t))


def enumerate_spans(n: Column, most: int) -> Column:
    """All spans (start, end) of ``n`` tokens up to ``most`` long."""
    starts = F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, F.least(i + most, n)), lambda e: F.struct(i.alias("start"), e.alias("end"))))))
