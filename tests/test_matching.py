import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from canonry.operators import adjudicate, candidates, matching, merge
from canonry.operators.components import components
from canonry.operators.solver import SCALE
from canonry.operators.solver import matching as solve

SCHEMA = "supplier string, id string, name string, address string, lat double, lon double, stars double"


def record(supplier, id_, name, lat=12.97, lon=77.59, stars=4.0):
    return (supplier, id_, name, "1 road", lat, lon, stars)


def edges_of(spark, *records):
    return candidates.scored_edges(spark.createDataFrame(list(records), SCHEMA))


def best(edges):
    """By trying every subset."""
    top = 0
    for k in range(len(edges) + 1):
        for some in combinations(edges, k):
            ends = [x for u, v, _ in some for x in (u, v)]
            if len(ends) == len(set(ends)):
                top = max(top, sum(round(w * SCALE) for *_, w in some))
    return top


@pytest.mark.parametrize("two_sided", [True, False])
def test_solver_is_exact(two_sided):
    rng = random.Random(7)
    for _ in range(150):
        nodes = list("abcdefgh")
        pairs = [(u, v) for u, v in combinations(nodes, 2) if not two_sided or (u < "e") != (v < "e")]
        edges = [(u, v, rng.choice([0.5, 0.6, 0.75, rng.random()])) for u, v in rng.sample(pairs, min(len(pairs), rng.randint(0, 11)))]
        found = solve(edges)
        ends = [x for p in found for x in p]
        weight = {(min(u, v), max(u, v)): w for u, v, w in edges}
        assert len(ends) == len(set(ends)) and sum(round(weight[p] * SCALE) for p in found) == best(edges)
        assert solve(edges[::-1]) == found


def test_solver_on_dense_odd_graphs():
    """Against subsets by dynamic programming, with blossoms inside blossoms."""
    rng = random.Random(11)
    for _ in range(250):
        n = rng.randint(3, 10)
        edges = [(i, j, rng.choice([rng.randint(1, 6), rng.randint(40, 60)]) / 60) for i, j in combinations(range(n), 2) if rng.random() < rng.choice([0.4, 0.7, 1])]
        weight = {(u, v): round(w * SCALE) for u, v, w in edges}
        top = [0] * (1 << n)
        for live in range(1, 1 << n):
            u = live.bit_length() - 1
            rest = live & ~(1 << u)
            top[live] = max([top[rest]] + [top[rest & ~(1 << v)] + weight[v, u] for v in range(u) if rest >> v & 1 and (v, u) in weight])
        found = solve(edges)
        assert len({x for p in found for x in p}) == 2 * len(found) and sum(weight[p] for p in found) == top[-1]


def test_solver_on_large_graphs():
    import time

    rng = random.Random(3)
    began = time.perf_counter()
    dense = [(u, v, rng.randint(550, 1000) / 1000) for u, v in combinations(range(500), 2) if u % 3 != v % 3 and rng.random() < 0.5]
    assert len(solve(dense)) == 250
    for weight in (lambda i: rng.random(), lambda i: 1.0, lambda i: 1 + i / 5000):
        chain = [(i, i + 1, weight(i)) for i in range(5000)] + [(0, 2, 0.9)]
        assert len(solve(chain)) > 2000
    assert time.perf_counter() - began < 60  # seconds; exponential search would take years


def test_greedy_would_be_wrong():
    assert solve([("a", "b", 2), ("b", "c", 3), ("c", "d", 2)]) == {("a", "b"), ("c", "d")}


def test_exact_pair(spark):
    (e,) = edges_of(spark, record("a", "A1", "Crystal Castle"), record("b", "B1", "Crystal Castle")).collect()
    assert e["confidence"] >= 0.99 and e["eligible"] and not e["is_rescue"]


def test_near_but_unrelated_is_a_near_miss(spark):
    (e,) = edges_of(spark, record("a", "A1", "Ashwa Stay"), record("b", "B1", "Zenith Home")).collect()
    assert e["confidence"] == pytest.approx(0.55) and not e["eligible"]


def test_other_numbers_are_a_veto(spark):
    edges = edges_of(spark, record("a", "A1", "OYO 123 Sun"), record("b", "B1", "OYO 456 Moon"))
    assert candidates.valid_edges(edges).count() == 0


def test_far_twin_is_rescued(spark):
    (e,) = edges_of(spark, record("a", "A1", "Crystal Castle"), record("b", "B1", "Crystal Castle", lat=12.9755)).collect()
    assert e["is_rescue"] and e["confidence"] >= 0.55
    assert edges_of(spark, record("a", "A1", "Crystal Castle"), record("b", "B1", "Crystal Fort", lat=12.9755)).count() == 0
    assert edges_of(spark, record("a", "A1", "Crystal Castle"), record("b", "B1", "Crystal Castle", lat=12.99)).count() == 0


def test_one_to_one_and_clusters(spark):
    rows = [record("a", "A1", "Crystal Castle"), record("a", "A2", "Crystal Castle Annex"), record("b", "B1", "Crystal Castle")]
    edges = candidates.scored_edges(spark.createDataFrame(rows, SCHEMA))
    matched = matching.max_weight_matching(candidates.valid_edges(edges))
    assert [(r["a_id"], r["b_id"]) for r in matched.collect()] == [("A1", "B1")]
    nodes = spark.createDataFrame(rows, SCHEMA).select("supplier", "id")
    made = {tuple(n["id"] for n in r["nodes"]): r["method"] for r in matching.clusters(nodes, matched).collect()}
    assert made == {("A1", "B1"): "geo_fuzzy", ("A2",): "singleton"}
    assert {(r["a_id"], r["b_id"]) for r in matching.near_misses(edges, matched).collect()} == {("A2", "B1")}


def test_three_suppliers_by_promotion(spark):
    rows = [record("a", "A1", "Crystal Castle"), record("b", "B1", "Crystal Castle"), record("c", "C1", "Kristall", lat=12.9701)]
    nodes = spark.createDataFrame(rows, SCHEMA).select("supplier", "id")
    pair = [("a", "A1", "b", "B1", 0.9, False)]
    matched = spark.createDataFrame(pair, "supplier_a string, a_id string, supplier_b string, b_id string, confidence double, is_rescue boolean")
    accepted = spark.createDataFrame([("a", "A1", "c", "C1", 0.8, "same", 1), ("b", "B1", "c", "C1", 0.7, "later", 2), ("a", "A1", "b", "B1", 0.6, "known", 3)], "supplier_a string, a_id string, supplier_b string, b_id string, verdict_confidence double, reason string, place int")
    (r,) = adjudicate.promote(matching.clusters(nodes, matched), accepted).collect()
    assert [n["id"] for n in r["nodes"]] == ["A1", "B1", "C1"] and r["method"] == "llm" and (r["confidence"], r["note"]) == (0.7, "later")


NEAR = "supplier_a string, a_id string, supplier_b string, b_id string, geo_score double, name_score double"


def test_hard_cases_band_and_cap(spark):
    rows = [("a", "A1", "b", "B1", 0.9, 0.5), ("a", "A2", "b", "B2", 0.9, 0.1), ("a", "A3", "b", "B3", 0.9, 0.95), ("a", "A4", "b", "B4", 0.1, 0.5), ("a", "A5", "b", "B5", 0.9, 0.5)]
    claimed = spark.createDataFrame([("b", "B5")], "supplier string, id string")
    assert [r["a_id"] for r in adjudicate.hard_cases(spark.createDataFrame(rows, NEAR), claimed).collect()] == ["A1"]
    many = spark.createDataFrame([("a", f"A{i}", "b", f"B{i}", 0.9, 0.5) for i in range(250)], NEAR)
    cases = adjudicate.hard_cases(many, claimed)
    assert cases.count() == 200
    assert {(r["batch"], r["n"]) for r in adjudicate.batches(cases).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {(i, 20) for i in range(10)}


def test_greedy_verdicts(spark):
    rows = [("a", "A1", "b", "B1", 0.9, 0.5, True, 0.6), ("a", "A2", "b", "B1", 0.9, 0.5, True, 0.9), ("a", "A3", "b", "B3", 0.9, 0.5, False, 0.99), ("b", "B1", "c", "C1", 0.9, 0.5, True, 0.5)]
    judged = spark.createDataFrame(rows, NEAR + ", same_hotel boolean, verdict_confidence double")
    got = [(r["a_id"], r["b_id"]) for r in adjudicate.greedy_one_to_one(judged).orderBy("place").collect()]
    assert got == [("A2", "B1"), ("B1", "C1")]
    assert adjudicate.greedy_one_to_one(judged.where("not same_hotel")).count() == 0


def test_answers(spark):
    records = spark.createDataFrame([record("a", "A1", "One", stars=None), record("b", "B1", 'Two "x"')], SCHEMA)
    cases = spark.createDataFrame([("a", "A1", "b", "B1", 0.9, 0.5, 0.1234)], NEAR + ", dist_km double")
    numbered = adjudicate.batches(cases)
    lines = adjudicate.prompt_lines(numbered, records)
    assert lines.first()["line"] == '0. A="One" (1 road, unknown stars) vs B="Two "x"" (1 road, 4.0 stars); 123m apart.'
    asked = adjudicate.prompts(lines)
    good = adjudicate.ask(asked, lambda p: '{"adjudications": [{"index": 0, "same_hotel": true, "confidence": 0.8, "reason": "%s"}, {"index": 7, "same_hotel": true}]}' % ("r" * 300))
    (v,) = adjudicate.read_answers(good, numbered).collect()
    assert v["key"] == "a::A1::b::B1" and v["same_hotel"] and v["confidence"] == 0.8 and len(v["reason"]) == 200
    for broken in (None, lambda p: "no json", lambda p: 1 / 0):
        assert adjudicate.read_answers(adjudicate.ask(asked, broken), numbered).count() == 0


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("z", "y")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(41)} | {"x": "x", "y": "x", "z": "x"}


def test_candidates_count_own_supplier(spark):
    rows = [record("a", f"A{i}", "Crystal Castle") for i in range(6)] + [record("b", "B1", "Crystal")]
    from dataclasses import replace

    few = candidates.best_candidates(candidates.prepared(spark.createDataFrame(rows, SCHEMA)), replace(candidates.DEFAULT, candidates=3))
    # The records of a fill each other's lists; only b's own list has pairs.
    assert {(r["u_id"], r["v_id"]) for r in few.collect()} == {("B1", "A0"), ("B1", "A1")}


def test_survivors(spark):
    df = spark.createDataFrame([(1, 0, " Sun Inn ", ["Wifi", "Pool"], 4.0), (1, 1, "Sun Hotel", ["wifi ", "Bar"], None), (1, 2, None, None, 3.0), (2, 0, "  ", [], None)], "k int, place int, name string, items array<string>, stars double")
    place = F.col("place")
    got = {r["k"]: r for r in df.groupBy("k").agg(merge.longest(F.col("name"), place).alias("n"), merge.united(F.col("items"), place).alias("u"), merge.mean(F.col("stars")).alias("m"), merge.source_map(F.when(place < 2, "a").otherwise("b"), place.cast("string"), place).alias("s")).collect()}
    assert (got[1]["n"], got[1]["u"], got[1]["m"], got[1]["s"]) == ("Sun Hotel", ["Wifi", "Pool", "Bar"], 3.5, {"a": "1", "b": "2"})
    assert (got[2]["n"], got[2]["u"], got[2]["m"]) == ("", [], None)


def test_vectors_for_names(spark):
    rows = [(*record("a", "A1", "Hilten"), [1.0, 0.0]), (*record("b", "B1", "Hilton"), [0.99, 0.14]), (*record("b", "B2", "Hilten"), [0.0, 1.0]), (*record("b", "B3", "Hilten"), None)]
    df = spark.createDataFrame(rows, SCHEMA + ", v array<double>")
    edges = {r["b_id"]: r["name_score"] for r in candidates.scored_edges(df, scorer=candidates.cosine_scorer("v")).collect()}
    assert edges["B1"] > 0.9 and edges["B2"] == edges["B3"] == 0
    assert {r["b_id"] for r in candidates.scored_edges(df.drop("v")).where("name_score = 1").collect()} == {"B2", "B3"}


def test_radius_at_all_latitudes(spark):
    from canonry.functions import scores

    rng = random.Random(4)
    rows = []
    for i in range(300):
        lat, lon = rng.choice([(0.0, 10.0), (45.0, -3.0), (-69.99, 150.0), (80.0, 77.0)])
        rows.append(("ab"[i % 2], str(i), lat + rng.uniform(-0.03, 0.03), lon + rng.uniform(-0.03, 0.03) / max(0.17, 1 - abs(lat) / 90)))
    df = spark.createDataFrame(rows, "supplier string, id string, lat double, lon double")
    got = {(r["u_id"], r["v_id"]) for r in candidates.within(df, 1.5).collect()}
    far = scores.haversine_km(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    want = {(r[0], r[1]) for r in df.alias("x").join(df.alias("y"), far <= 1.5).select("x.id", "y.id").collect()}
    assert got == want and len(got) > 600


def test_fetched_fingerprints(spark):
    urls = spark.createDataFrame([("x",), ("y",), ("y",), ("bad",), (None,)], "url string")
    known = spark.createDataFrame([("x", "known")], "url string, fingerprint string")

    def fetch(url):
        if url == "bad":
            raise OSError(url)
        return f"of {url}"

    got = {r["url"]: r["fingerprint"] for r in merge.fetched_fingerprints(urls, fetch, known).collect()}
    assert got == {"x": "known", "y": "of y", "bad": None}


def test_image_content(spark):
    df = spark.createDataFrame([(1, ["x", "y", "z", "w"]), (2, ["x"]), (3, []), (4, ["q", "q2"])], "id int, urls array<string>")
    prints = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2"), ("w", None)], "url string, fingerprint string")
    got = {r["id"]: r["urls"] for r in merge.dedupe_by_content(df, "id", "urls", prints).collect()}
    assert got == {1: ["x", "z", "w"], 2: ["x"], 3: [], 4: ["q", "q2"]}
