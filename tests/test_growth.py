"""What may not grow faster than its input."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canonry.operators import candidates, names, nearby, vectors


def test_records_of_equal_names_are_left_at_a_full_heap():
    rng, n = random.Random(4), 6000
    t = pa.table({"supplier": ["a", "b"] * (n // 2), "id": [f"{i:05d}" for i in range(n)], "lat": [1 + rng.random() / 100 for _ in range(n)], "lon": [1 + rng.random() / 100 for _ in range(n)], "stars": [1.0] * n, "numbers": pa.array([[]] * n, pa.list_(pa.string())), "form": pa.array([[f"w{i % 5}", "inn"] for i in range(n)])})
    best = nearby.Best(t.slice(0, 300), names.DICE.kernel, 0.6, 5)
    best.add(t)
    assert best.compared < 300 * n * 0.2
    far = [[nearby.Places(t).km([u], nearby.Places(t), [v])[0] for v in range(n)] for u in (0, 17)]
    for u, km in zip((0, 17), far, strict=True):
        want = sorted((v for v in range(n) if km[v] <= 0.6), key=lambda v: (-2.0 * (1 + (u % 5 == v % 5)) / 4, "ab"[v % 2], v))[:5]
        rows = best.u == u
        assert best.held.take(pa.array(best.v[rows])).column("id").to_pylist() == [f"{v:05d}" for v in want]


def test_half_of_the_cells_around_hold_every_pair(spark):
    rng = random.Random(8)
    rows = [(f"{i:03d}", rng.choice((0.0, 50.0, -33.0)) + rng.uniform(-0.02, 0.02), rng.uniform(-0.02, 0.02)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    both = {(r["u_id"], r["v_id"]): r["dist_km"] for r in candidates.within(df, 0.7).collect()}
    once = candidates.within(df, 0.7, once=True).collect()
    assert len(once) * 2 == len(both) - len(rows) > 200
    assert {(min(r["u_id"], r["v_id"]), max(r["u_id"], r["v_id"])): r["dist_km"] for r in once} == {k: x for k, x in both.items() if k[0] < k[1]}


def test_names_are_cleaned_once_for_all_of_their_grams(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(x):
        calls.add(1)
        return x or ""

    df = spark.createDataFrame([("royal plaza inn",)] * 50 + [("grand",), (None,)], "name string").coalesce(1)
    made = {r["g"]: r["idf"] for r in names.fit_weights(df, clean).collect()}
    assert calls.value <= 2 * 3
    want = Counter()
    for r in df.select(F.array_distinct(names.gram_bins(F.coalesce("name", F.lit("")))).alias("g")).collect():
        want.update(r["g"])
    assert made == pytest.approx({g: math.log((1 + 52) / (1 + n)) + 1 for g, n in want.items()})
    # A plan names what is cleaned once, whatever is cut from it.
    plan = df.select(names.gram_bins(F.upper("name")).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(name") == 1


def test_only_what_may_be_among_the_best_vectors_is_sorted(spark, monkeypatch):
    rng, sorted_, sort = random.Random(6), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *rest, **how: sorted_.append(np.ndim(a)) or sort(a, *rest, **how))
    # Copies, and ones that differ behind the sixth place.
    rows = [(v, [float(rng.randrange(3)), 1.0 + v % 4 * 1e-7], v % 2) for v in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side int")
    seen = {}

    class Cogrouped:
        def cogroup(self, other):
            return self

        def applyInPandas(self, best, schema):
            seen["best"] = best
            return df.selectExpr("vec_id as query_id", "vec_id", "0.0 as similarity").limit(0)

    monkeypatch.setattr(type(df), "groupBy", lambda self, *keys: Cogrouped())
    vectors.nearest(df, df, 5, "side")
    given = pd.DataFrame(rows, columns=["vec_id", "embedding", "side"])
    got = seen["best"](given.head(40), given)
    unit = np.array([np.array(r[1]) / math.hypot(*r[1]) for r in rows])
    like = np.round(unit[:40] @ unit.T, 6)
    want = [(u, v, like[u, v]) for u in range(40) for v in sorted(range(300), key=lambda v: (-like[u, v], v))[:5]]
    assert list(got.itertuples(index=False, name=None)) == want
    # Ids alone, never the whole matrix.
    assert set(sorted_) == {1}
