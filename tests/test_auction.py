"""Large graphs of two sides in flat arrays, against the solver with blossoms."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canonry.operators import auction, matching
from canonry.operators.components import components
from canonry.operators.solver import heaviest


def pairs_of(edges):
    u, v, w = (np.array(x) for x in zip(*edges, strict=True))
    found = auction.matching([u.astype(np.int32), v.astype(np.int32), w])
    return None if found is None else set(zip(*(x.tolist() for x in found), strict=True))


def test_bids_are_exact(monkeypatch):
    rng = random.Random(1)
    for few, rounds in ((0, 4_000), (0, 3), (32, 4_000)):
        monkeypatch.setattr(auction, "FEW", few)
        monkeypatch.setattr(auction, "BIDS", rounds)
        for t in range(80):
            left, right = (60, 70) if t % 40 == 0 else (rng.randint(1, 14), rng.randint(1, 14))
            pairs = [(i, left + j) for i in range(left) for j in range(right)]
            unit = rng.choice([1, 10**7])
            edges = [(*p, unit * rng.choice([0, 1, 2, 3, rng.randint(1, 1000)])) for p in rng.sample(pairs, rng.randint(1, min(len(pairs), 900)))]
            weight = {(u, v): w for u, v, w in edges}
            found = pairs_of(edges)
            ends = [x for p in found for x in p]
            assert len(ends) == len(set(ends))
            assert sum(weight[p] for p in found) == sum(weight[p] for p in heaviest({p: w for p, w in weight.items() if w}))
            assert pairs_of(rng.sample(edges, len(edges))) == found


def test_sides_need_not_be_named():
    # Ways of three suppliers, and a cycle of three.
    assert pairs_of([(0, 1, 2), (1, 2, 3), (2, 3, 2)]) == {(0, 1), (2, 3)}
    assert pairs_of([(0, 1, 2), (1, 2, 3), (0, 2, 2)]) is None


def test_a_task_holds_numbers_only():
    """A component of 60,000 edges, with ties: some bytes for each edge, no objects."""
    rng = np.random.default_rng(2)
    n, m = 4_000, 60_000
    u, v = (rng.integers(0, n, m).astype(np.int32) for _ in range(2))
    key = np.unique(u.astype(np.int64) * n + v)
    u, v = (key // n).astype(np.int32), (n + key % n).astype(np.int32)
    w = rng.integers(5, 10, len(u)) * 10**9
    batches = [pa.RecordBatch.from_pydict({"root": pa.array(np.zeros(len(x), np.int32)), "u": u[x], "v": v[x], "w": w[x]}) for x in np.array_split(rng.permutation(len(u)), 30)]
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(matching._solve(iter(batches))))
        assert tracemalloc.get_traced_memory()[1] < 120 * len(u)
    finally:
        tracemalloc.stop()
    ends = np.concatenate([out.column(c).to_numpy() for c in ("u", "v")])
    # All find a partner here, nearly all at the best weight.
    assert len(np.unique(ends)) == len(ends) > 2 * 0.99 * n


def test_components_of_many_small_steps(spark, monkeypatch):
    from canonry.operators import components as c

    monkeypatch.setattr(c, "AT_ONCE", 7)
    rng = random.Random(4)
    edges = [(f"{a:04d}", f"{b:04d}") for a, b in (sorted(rng.sample(range(900), 2)) for _ in range(500))]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    made = components(spark.createDataFrame(edges, "a string, b string").repartition(5))
    assert {r["node"]: r["root"] for r in made.collect()} == root
    assert made.where(F.col("node") < F.col("root")).count() == 0
