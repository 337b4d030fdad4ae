"""Evaluation as aggregations: precision and recall of spans, accuracy, attachment scores, rank correlation, vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_prf(counts: DataFrame) -> DataFrame:
    """Counts (tp, pred, gold) with precision, recall and f1."""
    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("gold"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("tp"), F.col("pred") + F.col("gold")))


def span_f1(gold: DataFrame, pred: DataFrame, keys: list[str], by: str | None = "label") -> DataFrame:
    """Micro scores over sets of spans, for each value of ``by`` and overall (null): one full join and a rollup."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), pred.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full").fillna(0, ["g", "p"])
    grouped = both.rollup(by) if by else both.groupBy()
    return with_prf(grouped.agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("pred"), F.sum("g").alias("gold")))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.agg(F.avg((F.col(gold) == F.col(pred)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def attachment(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("doc_id", "child")) -> DataFrame:
    """Unlabelled and labelled attachment scores of dependency edges."""
    p = pred.select(*keys, F.col("head").alias("p_head"), F.col("rel").alias("p_rel"))
    both = gold.join(p, list(keys), "left")
    head = F.coalesce(F.col("head") == F.col("p_head"), F.lit(False))
    return both.agg(F.avg(head.cast("int")).alias("uas"), F.avg((head & F.coalesce(F.col("rel") == F.col("p_rel"), F.lit(False))).cast("int")).alias("las"), F.count(F.lit(1)).alias("n"))


def ranks(rows: DataFrame, value: str, key: str, out: str, buckets: int = 64) -> DataFrame:
    """Ordinal ranks over the whole table, ties by key, without sorting it in one task: rows fall into ranges of the value
    between approximate quantiles, are numbered within their range, and each range starts where those before it end. Rows
    of one value share a range."""
    bounds = sorted(set(rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.002)))
    b = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(value))) if bounds else F.lit(0)
    ranged = rows.withColumn("__b", b)
    starts = ranged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    starts = starts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(value, key)))
    return local.join(F.broadcast(starts), "__b").withColumn(out, F.col("__s") + F.col("__r")).drop("__b", "__r", "__s")


def spearman(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rank correlation 1 - 6 sum(d^2) / (n (n^2 - 1)) with ordinal ranks."""
    both = ranks(rows.select(key, x), x, key, "rx").select(key, "rx").join(ranks(rows.select(key, y), y, key, "ry").select(key, "ry"), key)
    n = F.count(F.lit(1)).cast("double")
    return both.agg((1 - 6 * F.sum(((F.col("rx") - F.col("ry")) * (F.col("rx") - F.col("ry"))).cast("double")) / (n * (n * n - 1))).alias("spearman"), F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame, token: str = "text", least: int = 1) -> DataFrame:
    """Tokens with their frequency and an index by falling frequency; index ties by token."""
    counts = tokens.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    return ranks(counts.withColumn("__minus", -F.col("freq").cast("double")), "__minus", "token", "__i").select("token", "freq", (F.col("__i") - 1).alias("idx"))


#: Rows of one task, where their number is known.
SHARE = 500_000


def multiset_scores(gold: DataFrame, found: DataFrame, sentence: str, kinds: dict[str, list[str]], rows: int | None = None) -> DataFrame:
    """A row for each of ``kinds`` (its name and fields, the first those of all others and more) of matches, gold, found, precision,
    recall, f1 and complete (share of sentences without an error), repeats counting as often as both sides have them.

    Both sides are shuffled once, by sentence, for all kinds; with the number of ``rows`` of a side a task has about ``SHARE`` of them,
    however many there are."""
    fields = next(iter(kinds.values()))
    side = lambda t, g: t.select(sentence, *fields, F.lit(g).alias("__g"))
    both = side(gold, 1).unionByName(side(found, 0))
    both = both.repartition(sentence) if rows is None else both.repartition(max(1, -(-rows // SHARE)), sentence)
    sums = [F.sum("__g").alias("__g"), F.sum("__p").alias("__p")]
    # what is null equals nothing
    matched = lambda own: F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in (sentence, *own)]), F.least("__g", "__p")).otherwise(0)
    counts, done = both.withColumn("__p", 1 - F.col("__g")), []
    for kind, own in kinds.items():
        counts = counts.groupBy(sentence, *own).agg(*sums, *[F.sum(c).alias(c) for c in done]).withColumn(kind, matched(own))
        done.append(kind)
    by_sentence = counts.groupBy(sentence).agg(*sums, *[F.sum(c).alias(c) for c in done])
    right = lambda c: ((F.col(c) == F.col("__g")) & (F.col(c) == F.col("__p"))).cast("double")
    total = by_sentence.agg(F.sum("__g").alias("gold"), F.sum("__p").alias("found"), *[F.struct(F.sum(c).alias("matches"), F.avg(right(c)).alias("complete")).alias(c) for c in done])
    one = total.select("gold", "found", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("s")) for c in done])).alias("k")).select(F.col("k.s.matches").alias("matches"), "gold", "found", F.col("k.s.complete").alias("complete"), F.col("k.kind").alias("kind"))
    share = lambda c: F.when(F.col(c) > 0, F.col("matches") / F.col(c)).otherwise(0.0)
    return one.withColumn("precision", share("found")).withColumn("recall", share("gold")).withColumn("f1", F.when(F.col("matches") > 0, 2 * F.col("matches") / (F.col("gold") + F.col("found"))).otherwise(0.0))


def bracket_scores(gold: DataFrame, found: DataFrame, rows: int | None = None) -> DataFrame:
    """Labelled and unlabelled scores of constituents (sent_id, start, end, label): one row each."""
    return multiset_scores(gold, found, "sent_id", {"labelled": ["start", "end", "label"], "unlabelled": ["start", "end"]}, rows)


def bracket_scores_in(rows: DataFrame) -> DataFrame:
    """Labelled matches of arrays ``gold`` and ``found`` (as of ``trees.constituents_in``), a row for each tree, and how many either has."""
    size = lambda c: F.sum(F.size(c).cast("long"))
    return rows.agg(size(F.array_intersect("gold", "found")).alias("matches"), size("gold").alias("gold"), size("found").alias("found"))


def arc_scores(gold: DataFrame, found: DataFrame, rows: int | None = None) -> DataFrame:
    """Labelled and unlabelled scores of graphs of arcs (sent_id, child, head, rel): one row each."""
    return multiset_scores(gold, found, "sent_id", {"labelled": ["child", "head", "rel"], "unlabelled": ["child", "head"]}, rows)


def top_k_accuracy(rows: DataFrame, k: int = 1, gold: str = "gold", scores: str = "scores") -> DataFrame:
    """The share of rows whose gold class (from 0) is among the ``k`` best of the scores; of equal scores the first counts as better."""
    own = F.element_at(scores, F.col(gold) + 1)
    better = F.size(F.filter(F.transform(scores, lambda s, i: (s > own) | ((s == own) & (i < F.col(gold)))), lambda x: x))
    return rows.agg(F.avg((better < k).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
