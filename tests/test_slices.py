"""What a cell's task holds of the forms of names."""

import random

import numpy as np
import pyarrow as pa

from canonry.operators import candidates, nearby
from canonry.operators.names import SparseKernel


def test_forms_are_not_copied_for_pairs():
    rng = np.random.default_rng(3)
    form = pa.array([{"g": list(range(k, k + 40)), "w": [40**-0.5] * 40} for k in range(20)], pa.struct([("g", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))]))

    def records(n):
        return pa.table({"supplier": rng.choice(["a", "b"], n), "id": [f"{i:05d}" for i in range(n)], "lat": rng.random(n) / 1000, "lon": rng.random(n) / 1000, "stars": rng.random(n), "numbers": pa.array([[]] * n, pa.list_(pa.string())), "form": form.take(pa.array(rng.integers(0, 20, n)))})

    best = nearby.Best(records(300), SparseKernel(), 1.5, 50)
    best.add(records(1_000))
    held = {"form"} & set(best.held.column_names)
    made = best.rows()
    assert len(best.u) == 300 * 50 and not held
    assert 0 < len(made) < len(best.u) and made.column_names[0] == "u_supplier"


def test_slices_by_bytes_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("ab"[i % 2], f"{i:04d}", rng.choice(["sun inn", "sun hotel", "royal plaza", "royal inn 12"]), "1 road", 12.9 + rng.random() / 100, 77.5 + rng.random() / 100, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "supplier string, id string, name string, address string, lat double, lon double, stars double")
    scorer = candidates.ngram_scorer(df)
    found = lambda: sorted(map(tuple, candidates.scored_edges(df, scorer=scorer).collect()))
    whole = found()
    monkeypatch.setattr(nearby, "BYTES", 1)
    assert found() == whole and len(whole) > 400
