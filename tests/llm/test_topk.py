import math

import numpy as np
from pyspark.sql import functions as F

from canonry.llm import topk


def brute(rows, k, is_query):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in whole:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_search_in_blocks_agrees_with_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.0] * 8), (405, []), (406, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, queries=7, vector_block=64).collect()}
    assert got == brute(rows, 5, lambda i: i % 10 == 0)


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(0, 0.3, (2000, 4))).astype(np.int64)
    lists = topk.SortedLists(np.arange(2000), v)
    found = lists.top(np.arange(50), v[:50], 5, np.full(50, -np.inf))
    for i, (ids, scores) in enumerate(found):
        s = v @ v[i]
        s[i] = -(1 << 60)
        want = np.lexsort((np.arange(2000), -s))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
        # With the true bar carried from elsewhere, or a higher one.
        for bar, n in ((scores[-1], 5), (scores[1], 2), (scores[0] + 1, 0)):
            ((some, few),) = lists.top(np.array([i]), v[i : i + 1], 5, np.array([bar], float))
            assert some.tolist()[:n] == ids.tolist()[:n] and all(few >= bar)
    assert min(lists.read_share) < 1


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where(F.lit(False)), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_repeated_queries_count_each(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(100)] + [(0, rng.normal(0, 0.3, 8).tolist())]
    rows += [rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, queries=2, vector_block=16).collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want) and len(got) == 20
