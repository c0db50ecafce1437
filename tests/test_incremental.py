"""Builds that go on from the last one, and ids that last."""

import random
import re

import pytest

from canonry.operators import candidates, lasting, matching
from canonry.plans import build, incremental
from canonry.sources import artifact, feeds

SCHEMA = "supplier string, id string, name string, address string, lat double, lon double, stars double"
WORDS = "crystal castle lake palm view grand royal".split()


def world(rng, n):
    return {(s, f"{s}{i}"): (" ".join(rng.sample(WORDS, 2)), 12.95 + i % 40 * 0.002 + rng.uniform(0, 0.002), 77.5 + i // 40 * 0.07, 4.0) for i in range(n) for s in "ab" if rng.random() < 0.9}


def frame(spark, rows):
    return spark.createDataFrame([(*k, name, "", lat, lon, stars) for k, (name, lat, lon, stars) in rows.items()], SCHEMA)


def pairs(df):
    return {(r["a_id"], r["b_id"]): round(r["confidence"], 9) for r in df.collect()}


def changed(rng, rows, far):
    """Some come, some go, some get another name, some move, all in one place."""
    out = {k: v for k, v in rows.items() if not (v[2] < far and rng.random() < 0.1)}
    for k, (name, lat, lon, stars) in list(out.items()):
        if lon < far and rng.random() < 0.3:
            out[k] = rng.choice([(" ".join(rng.sample(WORDS, 2)), lat, lon, stars), (name, lat + 0.003, lon, stars), (name, lat, lon, 1.0)])
    return out | {("c", f"c{i}"): ("crystal castle", 12.95 + i * 0.001, 77.5, 4.0) for i in range(4)}


def test_updates_equal_full_builds(spark, tmp_path):
    rng = random.Random(4)
    rows = world(rng, 120)
    path, again = str(tmp_path / "state"), str(tmp_path / "again")
    incremental.full(spark, frame(spark, rows), path, degrees=0.02)
    for far in (77.51, 77.6):
        rows = changed(rng, rows, far)
        state, report = incremental.update(spark, frame(spark, rows), path, degrees=0.02)
        every = matching.max_weight_matching(candidates.valid_edges(candidates.scored_edges(frame(spark, rows))))
        assert pairs(state.read("matched")) == pairs(every) and len(pairs(every)) > 20
        assert {(r["supplier"], r["id"]) for r in state.read("records").collect()} == rows.keys()
        if far < 77.55:
            whole = incremental.full(spark, frame(spark, rows), again, degrees=0.02)
            directed = lambda s: sorted((r["u_id"], r["v_id"], r["rank"], round(r["name_score"], 9)) for r in s.read("directed").collect())
            assert directed(state) == directed(whole)
        # Places that no change reaches are neither scored nor read.
        assert 0 < report.changed and report.scored < len(rows) * (0.6 if far < 77.55 else 1)
        plan = state.read("directed", set(report.tiles))._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[.*tile#\w+ IN", plan)
        if far < 77.55:
            assert len(report.tiles) < state.map.count()
    before = state.map.collect()
    state, report = incremental.update(spark, frame(spark, rows), path, degrees=0.02)
    assert report == incremental.UpdateReport() and state.map.collect() == before


def test_a_component_that_leads_through_many_tiles(spark, tmp_path):
    """A change at one end turns the matching of a whole chain."""
    chain = {("ab"[i % 2], f"n{i:02d}"): ("crystal castle", 12.95 + i * 0.0018, 77.5, 4.0) for i in range(31)}
    path = str(tmp_path / "state")
    incremental.full(spark, frame(spark, chain), path, degrees=0.01)
    del chain["a", "n00"]
    state, report = incremental.update(spark, frame(spark, chain), path, degrees=0.01)
    want = matching.max_weight_matching(candidates.valid_edges(candidates.scored_edges(frame(spark, chain))))
    assert pairs(state.read("matched")) == pairs(want) and len(report.tiles) > 3 and report.scored < 20 < report.solved


def test_everything_goes_and_comes(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = {("a", "1"): ("x", 1.0, 1.0, 1.0), ("b", "2"): ("x", 1.0, 1.0, 1.0)}
    incremental.full(spark, frame(spark, rows), path)
    state, _ = incremental.update(spark, spark.createDataFrame([], SCHEMA), path)
    assert state.read("records").count() == state.read("matched").count() == 0
    state, _ = incremental.update(spark, frame(spark, rows), path)
    assert set(pairs(state.read("matched"))) == {("1", "2")}


CLUSTERS = "nodes array<struct<supplier string, id string>>, confidence double, method string, note string"


def ids_of(spark, new, old, highest=0):
    clusters = spark.createDataFrame([([(x[0], x) for x in nodes], 1.0, "geo_fuzzy" if len(nodes) > 1 else "singleton", None) for nodes in new], CLUSTERS)
    known = spark.createDataFrame([(x[0], x, f"CAN-{i:05d}") for i, nodes in old.items() for x in nodes], "supplier string, id string, canonical_id string")
    made, history = lasting.lasting_ids(clusters, known, highest)
    return {tuple(n["id"] for n in r["nodes"]): int(r["canonical_id"][4:]) for r in made.collect()}, {(int(r["canonical_id"][4:]), r["event"], r["other_id"] and int(r["other_id"][4:]), r["n"]) for r in history.collect()}


def test_ids_stay_split_and_merge(spark):
    old = {1: ["a1", "b1"], 2: ["a2"], 3: ["b3"], 4: ["a4", "b4", "c4"], 5: ["a5"], 7: ["a7", "b7"]}
    new = [["a1", "b1"], ["a2", "b3"], ["a4"], ["b4", "c4"], ["a6", "b6"], ["a8"], ["a7", "b9"], ["b7", "a9"]]
    ids, history = ids_of(spark, new, old)
    assert ids == {("a1", "b1"): 1, ("a2", "b3"): 2, ("b4", "c4"): 4, ("a4",): 10, ("a7", "b9"): 7, ("b7", "a9"): 9, ("a6", "b6"): 8, ("a8",): 11}
    assert history == {(3, "merged", 2, 1), (4, "split", 10, 1), (7, "split", 9, 1), (5, "retired", None, 1), (8, "new", None, 2), (11, "new", None, 1)}
    assert ids_of(spark, [["a9"]], old, highest=40)[0] == {("a9",): 41}
    assert ids_of(spark, [["a9"]], {})[0] == {("a9",): 1}


def test_ids_by_overlap_against_brute_force(spark):
    rng = random.Random(6)
    nodes = [f"{s}{i}" for i in range(30) for s in "abc"]

    def parts():
        rest, out = rng.sample(nodes, len(nodes)), []
        while rest:
            k = rng.randint(1, 4)
            out.append(sorted(rest[:k]))
            rest = rest[k:]
        return out

    old, new = dict(enumerate(parts(), 1)), parts()
    took = {}
    for n, o, i in sorted((-len(set(x) & set(y)), o, min(x)) for x in new for o, y in old.items() if set(x) & set(y)):
        if i not in took and o not in took.values():
            took[i] = o
    got, _ = ids_of(spark, new, old)
    assert {min(k): v for k, v in got.items() if min(k) in took} == took and len(set(got.values())) == len(new)
    assert all(v > len(old) for k, v in got.items() if min(k) not in took)


HOTELS = "id,name,address,lat,lon,stars,amenities,image_urls\n"


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "feeds"
    f.mkdir()
    for x in "ab":
        (f / f"{x}_rooms.csv").write_text("hotel_id,room_id,name,amenities\n")
    return f


def test_builds_that_go_on(spark, folder, tmp_path):
    a, b = folder / "a_hotels.csv", folder / "b_hotels.csv"
    a.write_text(HOTELS + "A1,Crystal Castle,,12.97,77.59,4,,\nA2,Lake View,,13.97,77.59,4,,\n")
    b.write_text(HOTELS + "B1,Crystal Castle,,12.97,77.59,4,,\n")
    out = str(tmp_path / "layer")
    build.build(spark, str(folder), out, goes_on=True)
    ids = lambda: {tuple(sorted(r["source_ids"].values())): r["id"] for r in artifact.Catalog(spark, out).table("canonical_hotels").collect()}
    assert ids() == {("A1", "B1"): "CAN-00001", ("A2",): "CAN-00002"}
    # A record in front of all others moves lines and numbers, but no id.
    a.write_text(HOTELS + "A0,Aardvark,,11.97,77.59,4,,\nA1,Crystal Castle,,12.97,77.59,4,,\n")
    report = build.build(spark, str(folder), out, force=True, goes_on=True)
    assert ids() == {("A1", "B1"): "CAN-00001", ("A0",): "CAN-00003"}
    assert (report.update.changed, report.ids) == (2, {"new": 1, "retired": 1})
    # Ids that went don't come again.
    a.write_text(HOTELS + "A1,Crystal Castle,,12.97,77.59,4,,\nA5,Palm,,14.97,77.59,4,,\n")
    build.build(spark, str(folder), out, force=True, goes_on=True)
    assert ids() == {("A1", "B1"): "CAN-00001", ("A5",): "CAN-00004"}
    past = feeds.side_table(spark, f"{out}/ids", build.ID_HISTORY)
    assert sorted((r["canonical_id"], r["event"]) for r in past.collect()) == [("CAN-00002", "retired"), ("CAN-00003", "new"), ("CAN-00003", "retired"), ("CAN-00004", "new")]
