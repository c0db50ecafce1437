"""Candidates found inside of tasks, against comparing everything with everything."""

import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canonry.config import DEFAULT
from canonry.operators import candidates, names, nearby, rooms

SCHEMA = "supplier string, id string, name string, lat double, lon double, stars double"
WORDS = "crystal castle lake road inn palm view grand royal hotel 101 202".split()


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def dice(a, b):
    a, b = set(a.split()), set(b.split())
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def brute(rows, reach, k, score=dice):
    out = {}
    for s, i, name, lat, lon, _ in rows:
        near = sorted((-score(name, m), t, j) for t, j, m, la, lo, _ in rows if km((lat, lon), (la, lo)) <= reach)[:k]
        out |= {(s, i, n + 1): (t, j, -x) for n, (x, t, j) in enumerate(near) if t != s}
    return out


def world(seed, n, lat, lon, spread):
    rng = random.Random(seed)
    return [(rng.choice("abc"), f"{i:04d}", " ".join(rng.sample(WORDS, rng.randint(0, 4))), lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread), rng.choice([None, 3.0, 4.5])) for i in range(n)]


def found(df):
    return {(r["u_supplier"], r["u_id"], r["rank"]): (r["v_supplier"], r["v_id"], r["name_score"]) for r in df.collect()}


@pytest.mark.parametrize(("lat", "lon", "spread"), [(12.97, 77.59, 0.05), (0.0, 0.0, 0.04), (-64.0, -21.0, 0.06), (71.0, 25.0, 0.08)])
def test_best_are_those_of_brute_force(spark, lat, lon, spread):
    rows = world(1, 220, lat, lon, spread)
    prepared = candidates.prepared(spark.createDataFrame(rows, SCHEMA))
    for reach, k in ((1.5, 50), (3.0, 4)):
        got = found(nearby.best_within(prepared, reach, k, names.DICE))
        assert got == brute(rows, reach, k) and got


def test_dense_cells_are_asked_in_parts(spark):
    rows = world(2, 700, 12.97, 77.59, 0.002)
    prepared = candidates.prepared(spark.createDataFrame(rows, SCHEMA))
    assert nearby.dealt(prepared, 1.5, 100).where("role = 0").groupBy("cy", "cx", "part").count().agg(F.count("*")).first()[0] >= 7
    assert found(nearby.best_within(prepared, 1.5, 5, names.DICE, asked=100)) == brute(rows, 1.5, 5)


def test_pairs_of_hopeless_lengths_are_skipped():
    rng = random.Random(3)
    forms = [["w%d" % x for x in rng.sample(range(30), n)] for n in (2, 30) for _ in range(600)]
    t = pa.table({"supplier": ["a"] * 1200, "id": [f"{i:04d}" for i in range(1200)], "lat": [1.0] * 1200, "lon": [1.0] * 1200, "stars": [1.0] * 1200, "numbers": pa.array([[]] * 1200, pa.list_(pa.string())), "form": pa.array(forms)})
    best = nearby.Best(t.slice(0, 600), names.DICE.kernel, 1.0, 3)
    for s in range(0, 1200, 200):
        best.add(t.slice(s, 200))
    assert best.compared < 600 * 1200 * 0.6
    every = names.DICE.kernel.matrix(t.slice(0, 600).column("form"), t.column("form"))
    assert np.allclose(np.sort(every, axis=1)[:, ::-1][:, :3].ravel(), best.score)


def test_held_candidates_are_dropped(monkeypatch):
    monkeypatch.setattr(nearby, "HELD", 50)
    n = 400
    t = pa.table({"supplier": ["a", "b"] * (n // 2), "id": [f"{i:04d}" for i in range(n)], "lat": [1.0] * n, "lon": [1.0] * n, "stars": [math.nan] * n, "numbers": pa.array([["1"], ["2"]] * (n // 2)), "form": pa.array([[f"w{i % 7}"] for i in range(n)])})
    best = nearby.Best(t.slice(0, 4), names.DICE.kernel, 1.0, 5)
    for s in range(0, n, 40):
        best.add(t.slice(s, 40))
    assert len(best.held) <= 60
    rows = best.rows().to_pylist()
    # Supplier a comes first among ties, so its own records have none of b.
    assert [(r["u_id"], r["v_id"]) for r in rows] == [("0001", f"{i:04d}") for i in (8, 22, 36, 50, 64)] + [("0003", f"{i:04d}") for i in (10, 24, 38, 52, 66)] and all(r["apart"] and r["stars_score"] == 0 for r in rows)


def test_no_window_over_pairs(spark, capsys):
    candidates.scored_edges(spark.createDataFrame(world(1, 20, 1.0, 1.0, 0.01), SCHEMA)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_records_without_place_and_tables_without_records(spark):
    rows = [("a", "1", "x", None, 1.0, 1.0), ("b", "2", "x", 1.0, None, 1.0)]
    assert candidates.scored_edges(spark.createDataFrame(rows, SCHEMA)).collect() == []
    assert candidates.scored_edges(spark.createDataFrame([], SCHEMA)).collect() == []


NAMES = ["Hilton Garden", "Hilten Gardan", "Grand Palace", "Grand Palas", "Sea View", "Lake View", "", "x"]


def test_ngrams_against_brute_force(spark):
    rows = [("ab"[i % 2], str(i), n, 1.0, 1.0, 3.0) for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, SCHEMA)
    scorer = names.ngram_scorer(df)
    grams = {n: [("^" + n.lower() + "$")[i : i + 3] for i in range(max(len(n), 1))] for n in NAMES}
    idf = {g: math.log((1 + len(NAMES)) / (1 + sum(g in x for x in grams.values()))) + 1 for x in grams.values() for g in x}

    def cosine(a, b):
        a, b = ({g: grams[x].count(g) * idf[g] for g in grams[x]} for x in (a, b))
        return sum(a[g] * b.get(g, 0) for g in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    got = found(nearby.best_within(candidates.prepared(df, scorer), 1.5, 50, scorer))
    want = brute(rows, 1.5, 50, cosine)
    assert got.keys() == want.keys() and {k: v[2] for k, v in got.items()} == pytest.approx({k: v[2] for k, v in want.items()})
    # The same in a plan.
    form = scorer.attach(df).select("id", "form")
    both = form.alias("u").join(form.alias("v"), F.col("u.id") < F.col("v.id")).select("u.id", F.col("v.id").alias("other"), scorer.score(F.col("u.form"), F.col("v.form")).alias("s"))
    assert {(r["id"], r["other"]): r["s"] for r in both.collect()} == pytest.approx({(a[1], b[1]): cosine(a[2], b[2]) for a in rows for b in rows if a[1] < b[1]})


def test_typos_that_tokens_miss(spark):
    rows = [("a", "1", "Hilton Garden", 12.97, 77.59, 4.0), ("b", "2", "Hilten Gardan", 12.9702, 77.59, 4.0), ("a", "3", "Sunrise Residency", 12.98, 77.60, 3.0), ("b", "4", "Moonlight Villas", 12.9802, 77.60, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = candidates.ngram_scorer(df)
    pairs = lambda edges: {(r["a_id"], r["b_id"]) for r in candidates.valid_edges(edges).collect()}
    assert pairs(candidates.scored_edges(df)) == set()
    assert pairs(candidates.scored_edges(df, replace(DEFAULT, least_name=0.3), own)) == {("1", "2")}


def test_rooms_by_ngrams(spark):
    placed = spark.createDataFrame([("a", "H", "1", "Deluxe Gardn Cottages", []), ("b", "G", "2", "Deluxe Garden Cottage", []), ("b", "G", "3", "Standard Room", [])], "supplier string, hotel_id string, room_id string, name string, amenities array<string>")
    clusters = spark.createDataFrame([("C", [("a", "H"), ("b", "G")])], "canonical_id string, nodes array<struct<supplier string, id string>>")
    from canonry.functions import text

    scorer = candidates.ngram_scorer(placed, text.room_name)
    got = rooms.scored_pairs(rooms.of_clusters(placed, clusters, scorer), scorer=scorer).collect()
    assert [(r["a_id"], r["b_id"]) for r in got] == [("1", "2")]
    assert rooms.scored_pairs(rooms.of_clusters(placed, clusters)).collect() == []
