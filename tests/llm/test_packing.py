import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonry.llm import bpe, packing


def used(plan, size):
    out = np.zeros(size, int)
    for p, n in zip(plan.patterns, plan.counts, strict=True):
        assert sum(p) <= size
        for w in p:
            out[w] += n
    return out


@pytest.mark.parametrize("pieces", [0, 1, 50, 3000])
def test_plan_places_every_piece(pieces):
    rng = np.random.default_rng(pieces)
    demand = np.bincount(rng.integers(1, 128, pieces), minlength=128)[:128]
    plan = packing.plan(demand, 128)
    assert (used(plan, 128) == demand).all()
    if pieces == 3000:
        assert sum(plan.counts) <= 1.01 * (np.arange(128) * demand).sum() / 128 + 1


def test_knapsack_agrees_with_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        values = np.zeros(31)
        some = rng.choice(np.arange(1, 31), 5, replace=False)
        values[some] = rng.random(5)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - w] + values[w] for w in some if w <= c])
        worth, chosen = packing.knapsack(values, 30)
        assert worth == pytest.approx(best[30]) and sum(chosen) <= 30
        assert sum(values[w] for w in chosen) == pytest.approx(worth)


def test_lengths_that_only_pair_up():
    demand = np.zeros(100, int)
    demand[60], demand[40], demand[35], demand[30] = 10, 10, 20, 10
    assert sum(packing.plan(demand, 100).counts) == 20


def test_pieces_cover_all_documents(spark):
    texts = ["word " * 900, None, "", "short one", "short one", "a longer text of some words " * 150, "x" * 9000, "a very long text " * 20_000, "y" * 100_000]
    df = spark.createDataFrame([(i % 6, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(df, 256).collect()
    own = bpe.Encoder(bpe.default_vocabulary())
    want = []
    for i, t in enumerate(texts):
        ids = np.append(own.encode([t])[0], 0).astype("<u4")
        want += [(i % 6, s, min(256, len(ids) - s), zlib.crc32(ids[s : s + 256]), len(ids)) for s in range(0, len(ids), 256)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(df.where(F.lit(False)), 256).count() == 0


def test_equal_rows_are_ranked_in_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    row = (None, 0, 7, 1, 7)
    spark.createDataFrame([row] * 2000 + [(1, 0, 9, 2, 9)], packing.PIECES).write.parquet(str(tmp_path / "pieces"))
    made = packing.ranked(spark.read.parquet(str(tmp_path / "pieces")))
    assert "row" not in made.columns
    assert sorted((r["length"], r["rank"]) for r in made.collect()) == [(7, k) for k in range(2000)] + [(9, 0)]


def test_as_few_sequences_as_can_be():
    """Best fit of the longest first, piece by piece, is never better, and what the
    linear program allows at least is reached."""
    import bisect

    rng = np.random.default_rng(12)
    for n, draw in ((1000, lambda n: rng.integers(1, 1024, n)), (20_000, lambda n: rng.integers(1, 1024, n)), (3000, lambda n: np.minimum(1023, 1 + rng.geometric(0.01, n))), (700, lambda n: rng.integers(340, 520, n)), (1, lambda n: np.array([5]))):
        lengths = draw(n)
        demand = np.bincount(lengths, minlength=1024)
        made = packing.plan(demand)
        assert sum(k * np.bincount(p, minlength=1024) for p, k in zip(made.patterns, made.counts, strict=True)).tolist() == demand.tolist()
        assert all(sum(p) <= 1024 for p in made.patterns)
        room: list[int] = []
        for w in sorted(lengths.tolist(), reverse=True):
            i = bisect.bisect_left(room, w)
            rest = (room.pop(i) if i < len(room) else 1024) - w
            bisect.insort(room, rest)
        least = sum(x for _, x in packing.fractional(demand, 1024, gap=0))
        assert sum(made.counts) <= len(room) and sum(made.counts) <= min(len(room), np.ceil(least - 1e-6) + 2)
        assert sum(made.counts) <= sum(k for _, k in packing.fill(demand, 1024))
    assert packing.plan(np.zeros(1024, np.int64)) == packing.Plan([], [])
