"""Packing by cutting-stock column generation.

Every document is cut into full pieces of the sequence length and one rest.  The
histogram of the rests (one number for each length, whatever the corpus' size)
is the demand of a cutting-stock problem: a linear program over patterns of
lengths that share a sequence.  Its columns are priced by a knapsack dynamic
program over the dual values.  The fractional pattern counts are rounded in several
ways, what is left over is filled greedily, the way with the fewest sequences is kept,
and its patterns are dealt to the documents by their rank within their length.

Defined results: a null or empty text is one piece that holds only the closing
id; equal rows are packed as separate documents; an empty table gives no rows;
very long documents give many full pieces and one rest; other columns are not
touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

CAPACITY = 1024
#: The linear program stops at this share of padding if that is no more than filling
#: alone has, when no column is worth its price, or after so many columns.
GAP = 0.001
MAX_COLUMNS = 2500
#: Fractions from which a pattern's count is rounded up; the last one uses no pattern
#: of the linear program.
ROUNDING = (1.0, 0.9, 0.75, 0.6, 0.5, 0.3, float("inf"))
#: Rows of one length that share one ranking task; groups of a hot length are
#: dealt over as many tasks as that takes.
RANK_ROWS = 100_000

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False), T.StructField("doc_tokens", T.LongType(), False)])


def pieces(df: DataFrame, capacity: int = CAPACITY, closing: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Full pieces and rests of every document, with the digest of their ids."""
    common.ship(df.sparkSession)
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = bpe.encoder(path, bpe.QuickEncoder), np.array([closing], np.int32)
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, texts in bpe.texts_in_slices(b.column(1)):
                for k, ids in enumerate(own.encode(texts)):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    n = len(ids)
                    rows += [(i + k, at, min(capacity, n - at), zlib.crc32(ids[at : at + capacity]), n) for at in range(0, n, capacity)]
            if not rows:
                continue
            cols = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], PIECES.names)

    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].alias("text")).mapInArrow(common.task(run), PIECES)


@dataclass
class Plan:
    """Patterns and how often each is used.  ``patterns[p]`` lists lengths."""

    patterns: list[list[int]]
    counts: list[int]


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable lengths that fit; ``values[w]`` is that of length w."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        got = best[c - 1 :: -1] + values[1 : c + 1]
        w = int(got.argmax())
        if got[w] > best[c - 1] + 1e-12:
            best[c], last[c] = got[w], w + 1
        else:
            best[c] = best[c - 1]
    chosen, c = [], capacity
    while c > 0:
        if last[c]:
            chosen.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return float(best[capacity]), chosen


def first_columns(demand: np.ndarray, capacity: int) -> list[list[int]]:
    """One pattern for each length: it and what fits best beside it."""
    widths = np.flatnonzero(demand)
    out = []
    for w in widths:
        free, pattern = capacity - int(w), [int(w)]
        while free >= widths[0]:
            x = int(widths[np.searchsorted(widths, free, "right") - 1])
            if x >= w:
                x = int(w)
            pattern.append(x)
            free -= x
        out.append(pattern)
    return out


def fractional(demand: np.ndarray, capacity: int, gap: float = GAP, most: int = MAX_COLUMNS) -> list[tuple[list[int], float]]:
    """Column generation with a revised simplex; the start is triangular, as a
    pattern's own length is the largest in it."""
    widths = np.flatnonzero(demand)
    m = len(widths)
    row = {int(w): i for i, w in enumerate(widths)}

    def column(pattern: list[int]) -> np.ndarray:
        return np.bincount([row[w] for w in pattern], minlength=m).astype(float)

    start = [[int(w)] * (capacity // int(w)) for w in widths]
    inverse = np.diag([1.0 / len(p) for p in start])
    basis, x = start, demand[widths] / np.array([len(p) for p in start], float)
    bound = float((widths * demand[widths]).sum()) / capacity
    # Offered from the end: what filling would use most, before all others.
    filled = fill(demand, capacity)
    waiting = first_columns(demand, capacity) + [p for p, _ in sorted(filled, key=lambda p: p[1])]
    goal = min(bound * (1 + gap), sum(n for _, n in filled))
    for _ in range(most):
        if x.sum() <= goal:
            break
        dual = inverse.sum(axis=0)
        new = None
        while waiting and new is None:
            p = waiting.pop()
            new = p if sum(dual[row[w]] for w in p) > 1 + 1e-7 else None
        if new is None:
            values = np.zeros(capacity + 1)
            values[widths] = np.maximum(dual, 0)
            worth, new = knapsack(values, capacity)
            if worth <= 1 + 1e-7:
                break
        d = inverse @ column(new)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        basis[out] = new
    return list(zip(basis, x.tolist(), strict=True))


def fill(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used, for what rounding leaves: the longest
    first, then one or two lengths that close the sequence exactly, else the longest
    that fits.  A pattern is used as often as its lengths last, so the work grows with
    the number of lengths and not of pieces."""
    left, out = left.copy(), []
    while left.any():
        now = left.copy()
        pattern, free = [], capacity
        while free:
            there = np.flatnonzero(now[: free + 1])
            if not len(there):
                break
            if pattern and not now[free]:
                mate = free - there
                pair = np.flatnonzero((mate > 0) & (now[mate] > (mate == there)))
                take = int(there[pair[-1]]) if len(pair) else int(there[-1])
            else:
                take = int(there[-1])
            pattern.append(take)
            now[take] -= 1
            free -= take
        need = left - now
        used = need > 0
        n = int((left[used] // need[used]).min())
        left -= n * need
        out.append((pattern, n))
    return out


def rounded(demand: np.ndarray, solution: list[tuple[list[int], float]], up: float, capacity: int) -> Plan:
    """Each pattern of the fractional solution as often as it says, a fraction of
    ``up`` or more once more, if the pieces are there; the rest is filled."""
    left = demand.astype(np.int64).copy()
    out = Plan([], [])
    for pattern, x in sorted(solution, key=lambda p: -p[1]):
        need = np.bincount(pattern, minlength=len(left))
        used = need > 0
        n = min(int(np.floor(max(0.0, x + 1 - up) + 1e-9)), int((left[used] // need[used]).min()))
        if n > 0:
            out.patterns.append(pattern)
            out.counts.append(n)
            left -= n * need
    for pattern, n in fill(left, capacity):
        out.patterns.append(pattern)
        out.counts.append(n)
    return out


def plan(demand: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """``demand[w]`` pieces of each length w below the capacity.  Of the ways to round,
    ``ROUNDING``, the one with the fewest sequences, the first of equal ones.  Never more
    sequences than ``fill`` alone, whose patterns are the first columns offered: above 1
    nothing is rounded at all."""
    if not demand.any():
        return Plan([], [])
    solution = fractional(demand, capacity)
    return min((rounded(demand, solution, up, capacity) for up in ROUNDING), key=lambda p: sum(p.counts))


def slots(p: Plan, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each slot run, and the run's pattern base,
    how many of that length a sequence of it has, and where they begin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, n in zip(p.patterns, p.counts, strict=True):
        at = 0
        ordered = sorted(pattern, reverse=True)
        for w in dict.fromkeys(ordered):
            times = ordered.count(w)
            runs.setdefault(w, []).append((taken.get(w, 0), base, times, at))
            taken[w] = taken.get(w, 0) + n * times
            at += times * w
        base += n
    runs[capacity] = [(0, base, 1, 0)]
    return {w: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for w, r in runs.items()}


def ranked(df: DataFrame) -> DataFrame:
    """``rank`` from 0 within each length.  A hot length is dealt over many
    tasks, equal rows too, by their numbers in ``df``, which must be a checkpoint or
    a table; the rows before each share are counted, never moved."""
    total = df.count()
    shares = max(8, total // RANK_ROWS)
    numbered = df.withColumn("row", F.monotonically_increasing_id())
    salted = numbered.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(shares)))
    before = salted.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = before.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "start", "row")))
    return local.join(before, ["length", "share"]).withColumn("rank", F.col("before") + F.col("local") - 1).drop("before", "local", "share", "row")


def pack(df: DataFrame, capacity: int = CAPACITY, closing: int = 0, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document with its place in a sequence."""
    cut = common.persist_cut(pieces(df, capacity, closing, vocabulary))
    # At most one row for each length below the capacity, whatever the corpus.
    counted = cut.where(F.col("length") < capacity).groupBy("length").count().collect()
    demand = np.zeros(capacity, np.int64)
    for r in counted:
        demand[r["length"]] = r["count"]
    table = slots(plan(demand, capacity), capacity)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length):
                own = length == w
                first, base, times, at = table[int(w)]
                k = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[k]
                sequence[own] = base[k] + inside // times[k]
                offset[own] = at[k] + inside % times[k] * w
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in PIECES.names), pa.array(sequence), pa.array(offset)], [*PIECES.names, "sequence_id", "offset"])

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    return ranked(cut).select(*PIECES.names, "rank").mapInArrow(deal, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
