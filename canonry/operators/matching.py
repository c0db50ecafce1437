"""One-to-one matching, what it leaves over, and clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.operators import auction
from canonry.operators.components import labels, numbered
from canonry.operators.solver import SCALE, heaviest
from canonry.session import persist_cut

#: Rounds of reductions at most, and the part of the edges left that a round must take for
#: another to be worth its reading them all; what they leave the solver takes.
ROUNDS, WORTH = 4, 0.01
#: Edges of a component from which on it is solved in flat arrays.
LARGE = 20_000
PAIR = ["supplier_a", "a_id", "supplier_b", "b_id"]


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("supplier_a").alias("supplier"), F.col("a_id").alias("id")).unionByName(edges.select(F.col("supplier_b").alias("supplier"), F.col("b_id").alias("id")))


def isolated_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that share no end with another, and all others."""
    degree = _ends(edges).groupBy("supplier", "id").count().where("count > 1")
    a = degree.select(F.col("supplier").alias("supplier_a"), F.col("id").alias("a_id"), F.col("count").alias("deg_a"))
    b = degree.select(F.col("supplier").alias("supplier_b"), F.col("id").alias("b_id"), F.col("count").alias("deg_b"))
    # Cut once; both results read it.
    both = persist_cut(edges.join(a, ["supplier_a", "a_id"], "left").join(b, ["supplier_b", "b_id"], "left"))
    lone = F.col("deg_a").isNull() & F.col("deg_b").isNull()
    return both.where(lone).select(edges.columns), both.where(~lone).select(edges.columns)


def _heaviest(edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ends of those edges ([u, v, w]) of a component that are in its matching."""
    if len(edges[0]) >= LARGE and (found := auction.matching(edges)) is not None:
        return found
    best: dict[tuple, int] = {}
    for u, v, w in zip(*(x.tolist() for x in edges), strict=True):
        if w > 0:
            best[u, v] = max(w, best.get((u, v), 0))
    pairs = np.array(sorted(heaviest(best)), np.int32).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the edges (root, u, v, w: numbers, in order of roots) that are matched.  A task
    holds one component at a time."""
    at, held = None, [[], [], []]

    def done() -> Iterator[pa.RecordBatch]:
        if held[0]:
            edges = []
            for x in held:
                edges.append(np.concatenate(x))
                x.clear()
            ends = _heaviest(edges)
            for s in range(0, len(ends[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[s : s + 100_000])) for x in ends], names=["u", "v"])

    for t in batches:
        root, *edge = (t.column(c).to_numpy() for c in ("root", "u", "v", "w"))
        cut = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
        for s, e in zip(cut, cut[1:], strict=False):
            if s < e:
                if root[s] != at:
                    yield from done()
                    at = root[s]
                for x, y in zip(held, edge, strict=True):
                    x.append(y[s:e].copy())
    yield from done()


def dominant(edges: DataFrame) -> DataFrame:
    """Those of ``edges`` (u, v, weight) that weigh more than the best other edges of both
    their ends together.  Exchanging these for such an edge gains, so every best matching
    has it; edges without neighbours are among them.  No two have an end in common."""
    edge = F.struct("u", "v")
    ends = edges.select(F.col("u").alias("node"), edge.alias("e"), "weight").unionByName(edges.select(F.col("v").alias("node"), edge.alias("e"), "weight"))
    best = ends.groupBy("node").agg(F.max(F.struct("weight", "e")).alias("top")).select("node", F.col("top.e").alias("own"), F.col("top.weight").alias("weight"))
    mutual = best.groupBy("own").agg(F.count("*").alias("n"), F.first("weight").alias("weight")).where("n = 2").select("own", "weight")
    at = mutual.select(F.col("own.u").alias("node"), "own").unionByName(mutual.select(F.col("own.v").alias("node"), "own"))
    rivals = ends.join(at, "node").where(F.col("e") != F.col("own")).groupBy("own", "node").agg(F.max("weight").alias("most"))
    both = rivals.groupBy("own").agg(F.sum("most").alias("rivals"))
    return mutual.join(both, "own", "left").where(F.col("weight") > F.coalesce("rivals", F.lit(0))).select("own.u", "own.v")


@dataclass
class Reduction:
    """Edges taken in each round, and those left for the solver."""

    taken: list = field(default_factory=list)
    left: int = 0


def reduced(edges: DataFrame, rounds: int = ROUNDS, told: Reduction | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, confidence, ...) that every best matching has, and those among the ends
    that they leave: dominant edges go with all edges at their ends, which makes others
    dominant, until little changes or the rounds are over; the solver gets the rest."""
    rest = persist_cut(edges.withColumn("weight", F.round(F.col("confidence") * SCALE).cast("long")))
    left, out = rest.count(), None
    for _ in range(rounds):
        if not left:
            break
        took = persist_cut(dominant(rest))
        some = rest.join(took, ["u", "v"], "left_semi").select(edges.columns)
        out = some if out is None else out.unionByName(some)
        ends = took.select(F.col("u").alias("node")).unionByName(took.select(F.col("v").alias("node")))
        fewer = persist_cut(rest.join(ends, rest["u"] == ends["node"], "left_anti").join(ends, rest["v"] == ends["node"], "left_anti"))
        now, n = fewer.count(), took.count()
        if told is not None:
            told.taken.append(n)
        if not n:
            break
        rest, left = fewer, now
        if n < WORTH * now:
            break
    if told is not None:
        told.left = left
    rest = rest.select(edges.columns)
    return (rest.limit(0) if out is None else out), rest


def max_weight_matching(edges: DataFrame, within: list[str] | None = None, told: Reduction | None = None) -> DataFrame:
    """The rows of ``edges`` in a matching of greatest total ``confidence``.
    Edges that every best matching has need no solver; the rest are solved exactly one
    connected component at a time (inside each group of ``within``, if given)."""
    keys = within or []
    node = lambda s, i: F.concat_ws("\u0001", *keys, s, i)
    ends = {"u": node("supplier_a", "a_id"), "v": node("supplier_b", "b_id")}
    named = edges.select(*(x.alias(c) for c, x in ends.items()), "confidence")
    # Names count in the order of numbers; all between here and the end sees numbers only.
    nodes = persist_cut(numbered(named.select("u").unionByName(named.select(F.col("v").alias("u")))))
    of = lambda name, k: nodes.select(F.col("node").alias(name), F.col("k").alias(k))
    own = named.join(of("u", "i"), "u").join(of("v", "j"), "v").where("i <> j")
    lone, rest = reduced(own.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "confidence"), told=told)
    found = lone.select("u", "v")
    if not rest.isEmpty():
        root = persist_cut(labels(rest.select("u", "v"), nodes.count()))
        placed = rest.join(root, rest["u"] == root["k"]).select("root", "u", "v", F.round(F.col("confidence") * SCALE).cast("long").alias("w"))
        found = found.unionByName(placed.repartition("root").sortWithinPartitions("root").mapInArrow(_solve, "u int, v int"))
    pairs = found.toDF("i", "j").join(of("least", "i"), "i").join(of("most", "j"), "j").select("least", "most")
    pairs = persist_cut(pairs.unionByName(pairs.select(F.col("most").alias("least"), F.col("least").alias("most"))))
    return edges.join(pairs, (ends["u"] == F.col("least")) & (ends["v"] == F.col("most")), "left_semi")


def unmatched(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    return nodes.join(_ends(matched).distinct(), ["supplier", "id"], "left_anti")


def near_misses(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """All kept edges but the matched ones."""
    return edges.join(matched.select(PAIR), PAIR, "left_anti")


def method_of(is_rescue) -> F.Column:
    return F.when(is_rescue, F.lit("rescue")).otherwise(F.lit("geo_fuzzy"))


def clusters(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """``nodes`` (structs, in order), ``confidence``, ``method`` and ``note`` of
    every matched pair and every record left over."""
    node = lambda s, i: F.struct(F.col(s).alias("supplier"), F.col(i).alias("id"))
    note = F.lit(None).cast("string").alias("note")
    pairs = matched.select(F.array(node("supplier_a", "a_id"), node("supplier_b", "b_id")).alias("nodes"), "confidence", method_of(F.col("is_rescue")).alias("method"), note)
    single = unmatched(nodes, matched).select(F.array(node("supplier", "id")).alias("nodes"), F.lit(1.0).alias("confidence"), F.lit("singleton").alias("method"), note)
    return pairs.unionByName(single)
