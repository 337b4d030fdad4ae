"""Decoders that need scores but no weights: tag sequences, dependency trees, constituents and lemma scripts.

Each takes the scores of one sentence, so it runs in Arrow batches where the rows are, without a shuffle; memory is that of one
sentence. A null row, or one without words, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def by_row(kind: str, f: Callable, *columns: Column) -> Column:
    """``f`` of the values of each row, null where one is null."""

    @F.arrow_udf(kind)
    def run(first: pa.Array, *rest: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (first, *rest)), strict=True)
        return pa.array([None if any(v is None for v in row) else f(*row) for row in rows], KINDS[kind])

    return run(*columns)


KINDS = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "boolean": pa.bool_(), "array<array<int>>": pa.list_(pa.list_(pa.int32())), "array<string>": pa.list_(pa.string())}


def best_tags(emissions: list[list[float]], transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> list[int] | None:
    """The sequence of tags with the largest sum of emissions and transitions; of equals the one with the lowest last tags."""
    if not emissions:
        return None
    e, t = np.asarray(emissions, float), np.asarray(transitions, float)
    score = e[0] + (0 if start is None else np.asarray(start, float))
    back = np.zeros(e.shape, np.int64)
    for i in range(1, len(e)):
        paths = score[:, None] + t
        back[i] = paths.argmax(0)
        score = paths.max(0) + e[i]
    at = int((score + (0 if end is None else np.asarray(end, float))).argmax())
    tags = [at]
    for i in range(len(e) - 1, 0, -1):
        at = int(back[i, at])
        tags.append(at)
    return tags[::-1]


def viterbi(emissions: Column, transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> Column:
    """Tag numbers by a linear-chain model, from emissions array<array<double>>."""
    return by_row("array<int>", lambda e: best_tags(e, transitions, start, end), emissions)


def projective_heads(scores: list[list[float]]) -> list[int] | None:
    """Heads of words 1 to n (0 is the root) of the projective tree with the largest sum; ``scores[d][h]`` with row 0 unused.

    Spans are built from short to long: an arc joins two half spans, a half span is an arc's and another half span.
    """
    s = np.asarray(scores, float)
    n = len(s)
    if n < 2:
        return None
    arc = np.full((n, n, 2), -np.inf)  # from i to j; 0: i depends on j, 1: j depends on i
    half = np.full((n, n, 2), -np.inf)  # head on the right (0) or on the left (1)
    half[np.arange(n), np.arange(n)] = 0
    cut, mid = np.zeros((n, n), int), np.zeros((n, n, 2), int)
    for width in range(1, n):
        for i in range(n - width):
            j = i + width
            joined = half[i, i:j, 1] + half[i + 1 : j + 1, j, 0]
            cut[i, j] = i + int(joined.argmax())
            arc[i, j, 0] = joined.max() + (s[i, j] if i else -np.inf)
            arc[i, j, 1] = joined.max() + s[j, i]
            left, right = half[i, i:j, 0] + arc[i:j, j, 0], arc[i, i + 1 : j + 1, 1] + half[i + 1 : j + 1, j, 1]
            mid[i, j] = i + int(left.argmax()), i + 1 + int(right.argmax())
            half[i, j] = left.max(), right.max()
    heads, todo = [0] * n, [(0, n - 1, 1, False)]
    while todo:
        i, j, side, is_arc = todo.pop()
        if i == j:
            continue
        if is_arc:
            heads[i if side == 0 else j] = j if side == 0 else i
            todo += [(i, cut[i, j], 1, False), (cut[i, j] + 1, j, 0, False)]
        elif side:
            todo += [(i, mid[i, j, 1], 1, True), (mid[i, j, 1], j, 1, False)]
        else:
            todo += [(i, mid[i, j, 0], 0, False), (mid[i, j, 0], j, 0, True)]
    return [int(h) for h in heads[1:]]


def spanning_heads(scores: list[list[float]]) -> list[int] | None:
    """Heads of words 1 to n of the tree with the largest sum, crossing or not: cycles of best heads are contracted, and opened
    where entering them costs least."""
    s = np.array(scores, float)
    n = len(s)
    if n < 2:
        return None
    np.fill_diagonal(s, -np.inf)

    def solve(s: np.ndarray) -> np.ndarray:
        m = len(s)
        heads = s.argmax(1)
        heads[0] = 0
        color = np.zeros(m, int)
        for first in range(1, m):
            path, at = [], first
            while at and not color[at]:
                color[at] = first
                path.append(at)
                at = int(heads[at])
            if at and color[at] == first and at in path:
                cycle = path[path.index(at) :]
                break
        else:
            return heads
        rest = [i for i in range(m) if i not in set(cycle)]
        inner = s[cycle, heads[cycle]]
        small = np.full((len(rest) + 1, len(rest) + 1), -np.inf)
        small[:-1, :-1] = s[np.ix_(rest, rest)]
        outward = s[np.ix_(rest, cycle)]
        small[:-1, -1] = outward.max(1)
        inward = s[np.ix_(cycle, rest)] - inner[:, None] + inner.sum()
        small[-1, :-1] = inward.max(0)
        found = solve(small)
        out = heads.copy()
        for k, i in enumerate(rest[1:], 1):
            out[i] = rest[found[k]] if found[k] < len(rest) else cycle[int(outward[k].argmax())]
        into = int(found[-1])
        broken = int(inward[:, into].argmax())
        out[cycle[broken]] = rest[into]
        return out

    return [int(h) for h in solve(s)[1:]]


def dependency_heads(scores: Column, projective: bool = True) -> Column:
    """Heads of words 1 to n from scores array<array<double>> by dependent and head, of which 0 is the root."""
    return by_row("array<int>", projective_heads if projective else spanning_heads, scores)


def tree(heads: list[int]) -> bool:
    """Whether the heads of words 1 to n (0: the root) form a tree under one root word."""
    if sum(h == 0 for h in heads) != 1 or any(h < 0 or h > len(heads) for h in heads):
        return False
    sure = {0}
    for i in range(1, len(heads) + 1):
        path, at = [], i
        while at not in sure:
            if at in path:
                return False
            path.append(at)
            at = heads[at - 1]
        sure.update(path)
    return True


def is_tree(heads: Column) -> Column:
    return by_row("boolean", tree, heads)


def best_brackets(scores: list[list[list[float]]]) -> list[list[int]] | None:
    """The binary bracketing with the largest sum of the best label of each span: rows (start, end, label), end exclusive.
    ``scores[i][j]`` has the scores of the labels from fence i to fence j."""
    s = np.asarray(scores, float)
    if s.ndim != 3 or len(s) < 2:
        return None
    n, label, own = len(s) - 1, s.argmax(2), s.max(2)
    best, at = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1), int)
    for width in range(1, n + 1):
        for i in range(n - width + 1):
            j = i + width
            best[i, j] = own[i, j]
            if width > 1:
                parts = best[i, i + 1 : j] + best[i + 1 : j, j]
                at[i, j] = i + 1 + int(parts.argmax())
                best[i, j] += parts.max()
    out, todo = [], [(0, n)]
    while todo:
        i, j = todo.pop()
        out.append([i, j, int(label[i, j])])
        if j - i > 1:
            todo += [(at[i, j], j), (i, at[i, j])]
    return [[int(x) for x in row] for row in out]


def brackets(scores: Column) -> Column:
    return by_row("array<array<int>>", best_brackets, scores)


def edit_script(source: str, target: str, copies: bool = False) -> str:
    """The shortest row of deletions ``-``, insertions ``+x`` and, if wanted, copies ``→``; of equally short ones it prefers
    copies, then deletions."""
    above: list[tuple[int, str]] = []
    for i in range(len(source) + 1):
        row: list[tuple[int, str]] = []
        for j in range(len(target) + 1):
            ways = []
            if copies and i and j and source[i - 1] == target[j - 1]:
                ways.append((above[j - 1][0], above[j - 1][1] + "→"))
            if i:
                ways.append((above[j][0] + 1, above[j][1] + "-"))
            if j:
                ways.append((row[j - 1][0] + 1, row[j - 1][1] + "+" + target[j - 1]))
            row.append(min(ways, key=lambda w: w[0]) if ways else (0, ""))
        above = row
    return above[-1][1]


def rule_of(form: str, lemma: str, copies: bool = False) -> str:
    """How a form becomes its lemma: runs of case with their places, then ``d`` and the edits before and after the longest
    part they share, or ``a`` and the lemma where they share nothing."""
    runs, last = [], None
    for i, c in enumerate(lemma):
        case = "↑" if c.lower() != c else "↓"
        if case != last:
            runs.append(f"{case}{i if i <= len(lemma) // 2 else i - len(lemma)}")
            last = case
    form, lemma = form.lower(), lemma.lower()
    best = max(((k, -b, -a) for b in range(len(lemma)) for a in range(len(form)) for k in [shared(form, a, lemma, b)] if k), default=None)
    if best is None:
        return "¦".join(runs) + ";a" + lemma
    size, b, a = best[0], -best[1], -best[2]
    return "¦".join(runs) + f";d{edit_script(form[:a], lemma[:b], copies)}¦{edit_script(form[a + size :], lemma[b + size :], copies)}"


def shared(x: str, i: int, y: str, j: int) -> int:
    n = 0
    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
        n += 1
    return n


def edited(part: str, script: str) -> str:
    out, at, marks = [], 0, iter(script)
    for m in marks:
        if m == "+":
            out.append(next(marks))
        else:
            if m == "→":
                out.append(part[at])
            at += 1
    return "".join(out)


def consumed(script: str) -> int:
    """Characters of the source that a script goes over."""
    marks, n = iter(script), 0
    for m in marks:
        if m == "+":
            next(marks)
        else:
            n += 1
    return n


def by_rule(form: str, rule: str) -> str:
    """The lemma of a form by a rule; a rule that does not fit leaves the form in lower case."""
    if ";" not in rule:
        return form.lower()
    cases, edits = rule.split(";", 1)
    if edits.startswith("a"):
        lemma = edits[1:]
    else:
        form = form.lower()
        before, after = edits[1:].split("¦")
        left, right = consumed(before), consumed(after)
        if left + right > len(form):
            lemma = form
        else:
            lemma = edited(form[:left], before) + form[left : len(form) - right] + edited(form[len(form) - right :], after)
    for run in cases.split("¦"):
        if run and run != "↓0":
            at = int(run[1:])
            lemma = lemma[:at] + (lemma[at:].upper() if run[0] == "↑" else lemma[at:].lower())
    return lemma


def lemma_rule(form: Column, lemma: Column, copies: bool = False) -> Column:
    return by_row("string", lambda f, x: rule_of(f, x, copies), form, lemma)


def lemma(form: Column, rule: Column) -> Column:
    return by_row("string", by_rule, form, rule)
