"""Periodic runs of words, after Kolpakov and Kucherov.

A run is a stretch of consecutive words that repeats with its smallest period q, is at least `power` periods and `least`
words long, and cannot be extended on either side. Each document is taken by itself, in four steps:

1. A run holds each of its words `power` times, so words that are rarer in the document part it, and rarer ones in a part
   part it again. Only parts of `least` words or more can hold a run, and none is cut by this. Prose ends here.
2. A part is factorised from the left (Lempel-Ziv, earlier occurrences may overlap) by its suffix automaton, whose states know where
   their words ended first.
3. Main's step at each border of two factors: longest common extensions of every possible period, by two Z arrays over a
   window that the factors' lengths bound, give the runs that cross or touch the border. Every run that has no equal further left is among them.
4. What lies strictly inside a factor is copied from the factor's earlier occurrence, whose runs are known by then.

Rows: a null text has no words; a null or repeated doc_id is a document like any other; extra columns are dropped; an empty
table gives an empty one. Texts are read whole. A document is one task's work: about 60 bytes a word, and about 150 more a
word in the longest part that step 1 leaves. Documents don't meet, so nothing is shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_tables, small_batches

POWER, LEAST = 4, 6
#: How often a part is parted again. More rounds leave less to step 2, and never change what is found.
ROUNDS = 4

Run = tuple[int, int, int]


class SuffixAutomaton:
    """The automaton of all stretches of `x`. Most states have one way on, which is kept in arrays; the others' ways are in `more`."""

    def __init__(self, x: list[int]):
        size, link, ends = array("i", [0]), array("i", [-1]), array("i", [-1])
        letter, target, more = array("i", [-1]), array("i", [0]), {}
        last = 0

        def put(state: int, c: int, to: int) -> None:
            if letter[state] < 0 or letter[state] == c:
                letter[state], target[state] = c, to
            else:
                more.setdefault(state, {})[c] = to

        def get(state: int, c: int) -> int:
            if letter[state] == c:
                return target[state]
            return more[state].get(c, -1) if state in more else -1

        self.step, self.ends = get, ends
        for i, c in enumerate(x):
            now = len(size)
            size.append(size[last] + 1)
            link.append(0)
            ends.append(i)
            letter.append(-1)
            target.append(0)
            at, to = last, -1
            while at >= 0 and (to := get(at, c)) < 0:
                put(at, c, now)
                at = link[at]
            if at >= 0:
                if size[at] + 1 == size[to]:
                    link[now] = to
                else:
                    copy = len(size)
                    size.append(size[at] + 1)
                    link.append(link[to])
                    ends.append(ends[to])
                    letter.append(letter[to])
                    target.append(target[to])
                    if to in more:
                        more[copy] = dict(more[to])
                    while at >= 0 and get(at, c) == to:
                        put(at, c, copy)
                        at = link[at]
                    link[to] = link[now] = copy
            last = now


def factorise(x: list[int]) -> list[tuple[int, int]]:
    """(start, start of an earlier occurrence or -1) of each factor: the longest stretch that began before, or else one new letter."""
    automaton, out, at, n = SuffixAutomaton(x), [], 0, len(x)
    step, ends = automaton.step, automaton.ends
    while at < n:
        state, upto = 0, at
        while upto < n and ends[to := step(state, x[upto])] < upto:
            state, upto = to, upto + 1
        out.append((at, ends[state] - (upto - at) + 1 if upto > at else -1))
        at = max(upto, at + 1)
    return out


def z_array(x: list[int]) -> list[int]:
    """For each place how far the stretch from there agrees with the beginning of x."""
    n = len(x)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if i + k < right:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        left, right, z[i] = i, i + k, k
    return z


def runs_at_border(x: list[int], a: int, b: int, c: int, power: int, least: int) -> Iterator[Run]:
    """(start, end, period) of runs that touch b and end by c, for the factors [a, b) and [b, c).

    Such a run starts after a - period, or the factor [a, b) would have been longer. With `power` periods in it, its period is
    below (c - a) / (power - 1). A period's multiples come with the same start and end, the period itself with them.
    """
    most = (c - a - 1) // (power - 1)
    if most < 1 or c - a + most <= least:
        return
    left = max(0, a - most)
    t, u = x[left:b], x[b:c]
    back, m, mt = t[::-1], min(most, len(u)), min(most, len(t))
    zx = z_array([*u, -1, *t[len(t) - mt :], *u])
    zy = z_array([*back, -1, *u[m - 1 :: -1], *back] if m else [*back, -1, *back])
    ux, ty = len(u) + 1 + mt, len(t) + 1 + m
    for p in range(1, most + 1):
        found = []
        if p <= m:  # a whole period right of the border
            found.append((b - zy[ty - p], b + p + (zx[p] if p < len(u) else 0)))
        if p <= mt:  # or left of it
            found.append((b - p - (zy[p] if p < len(t) else 0), b + zx[ux - p]))
        for start, end in found:
            if end - start >= power * p and end - start >= least:
                if not (start and x[start - 1] == x[start - 1 + p]) and not (end < len(x) and x[end] == x[end - p]):
                    yield start, end, p


def runs_of_part(x: list[int], power: int, least: int) -> list[Run]:
    """(start, end, period) of every run."""
    factors = factorise(x)
    bounds = [f[0] for f in factors] + [len(x)]
    period: dict[tuple[int, int], int] = {}
    starting: dict[int, list[int]] = {}
    starts: list[int] = []

    def add(start: int, end: int, p: int) -> None:
        if (start, end) not in period:
            if start not in starting:
                insort(starts, start)
                starting[start] = []
            starting[start].append(end)
            period[start, end] = p
        elif p < period[start, end]:
            period[start, end] = p

    # The end of x is a border too: behind it a factor of one letter that occurs nowhere else.
    x = [*x, -2]
    for i, (b, earlier) in enumerate(factors):
        if i:
            for run in runs_at_border(x, bounds[i - 1], b, bounds[i + 1], power, least):
                add(*run)
        size = bounds[i + 1] - b
        if earlier >= 0 and size >= least:
            # In order of start: where the occurrences overlap, a copied run is met and copied again.
            at = bisect_right(starts, earlier)
            while at < len(starts) and (start := starts[at]) + least < earlier + size:
                for end in starting[start]:
                    if end < earlier + size:
                        add(start - earlier + b, end - earlier + b, period[start, end])
                at += 1
    if factors:
        for run in runs_at_border(x, bounds[-2], bounds[-1], len(x), power, least):
            add(*run)
    return [(start, end, p) for (start, end), p in period.items()]


def parts(ids: np.ndarray, power: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, ids) of the parts that can hold a run."""
    todo = [(0, ids, ROUNDS)]
    while todo:
        first, x, rounds = todo.pop()
        if len(x) < least:
            continue
        letters, x_dense = np.unique(x, return_inverse=True)
        common = np.bincount(x_dense, minlength=len(letters))[x_dense] >= power
        if common.all() or not rounds:
            yield first, x_dense
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, common, False].astype(np.int8)))
        todo.extend((first + int(i), x[i:j], rounds - 1) for i, j in zip(edges[::2], edges[1::2]) if j - i >= least)


def word_runs(words: list, power: int = POWER, least: int = LEAST) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    found = [(first + start, end - start, p) for first, x in parts(ids, power, least) for start, end, p in runs_of_part(x.tolist(), power, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats: each run keeps its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, power: int = POWER, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of a text's words by start, then period, and the text with each run cut to its
    first period, its words joined by one space. Words are what white space (space, tab to carriage return) parts."""
    if power < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    small_batches(docs.sparkSession, 200)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("periods")
        for b in batches:
            counts, sizes, flat, kept = [], [0], [], []
            for text in b.column(1):
                # bytes.split() parts at exactly these six characters
                words = (text.as_py() or b"").split()
                runs = word_runs(words, power, least)
                counts.append(len(words))
                flat.extend(runs)
                sizes.append(len(flat))
                kept.append(b" ".join(collapse(words, runs)))
            columns = np.array(flat, dtype=np.int64).reshape(-1, 3)
            runs_column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), runs_column, pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    x = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest_run(F.col("runs")).alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return x.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
