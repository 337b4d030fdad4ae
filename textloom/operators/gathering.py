"""Tables keyed by document as one row of arrays for each document, so that what belongs together is found without joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(**tables: DataFrame) -> DataFrame:
    """A row (doc_id, an array of the rows of each table) for each document; all rows are shuffled once."""
    rows = None
    for name, t in tables.items():
        one = t.select("doc_id", F.struct(*[c for c in t.columns if c != "doc_id"]).alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.groupBy("doc_id").agg(*[F.collect_list(n).alias(n) for n in tables])


def has(rows: Column | str, rule) -> Column:
    """Whether a row fits; a rule that is null does not."""
    return F.coalesce(F.exists(rows, rule), F.lit(False))


def first_of(rows: Column | str, rule) -> Column:
    return F.get(F.filter(rows, rule), 0)


def bound(value: Column, of) -> Column:
    """``of`` of a value that is made once, however often ``of`` uses it for each element of something else."""
    return F.get(F.transform(F.array(value), of), 0)


def in_groups(rows: Column, *keys: str) -> Column:
    """Rows in order, those with equal keys next to each other, as arrays of the rows of one key."""
    other = lambda x, y: ~F.coalesce(y.isNotNull() & reduce(Column.__and__, [x[k].eqNullSafe(y[k]) for k in keys]), F.lit(False))
    begins = lambda r: F.filter(F.transform(r, lambda x, i: F.when((i == 0) | other(x, F.get(r, i - 1)), i)), lambda i: i.isNotNull())
    cut = lambda r: bound(begins(r), lambda b: F.transform(b, lambda at, k: F.slice(r, at + 1, F.coalesce(F.get(b, k + 1), F.size(r)) - at)))
    return bound(rows, cut)


def each(docs: DataFrame, rows: str, name: str, *kept: str) -> DataFrame:
    """``docs`` with ``name`` for each of ``rows``. An inner explode would bring a filter that makes all of ``rows`` a second time, with
    what they are made of made anew for each element."""
    return docs.select(*kept, F.explode_outer(rows).alias(name)).where(F.col(name).isNotNull())
