import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonry.llm import common, graph, jaccard


def sets_of(text, width):
    w = (text or "").encode().lower().split() if (text or "").isascii() else (text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def brute(rows, width, percent):
    s = [sets_of(t, width) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    r = roots(len(rows), links)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if r[j] == r[i] and rows[j][0] is not None]
        out.append((k, len(s[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, groups=12, size=14):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows = []
    passage = [word() for _ in range(30)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w = w[: rng.randint(1, len(w))]
            if rng.random() < 0.3:
                w = passage + w
            rows.append((" ".join(w)).upper() if rng.random() < 0.1 else " ".join(w))
    rng.shuffle(rows)
    rows += [rows[0], rows[1], "", None, "one", "one", "one two", " \n\t", "x " * 400, "x " * 500]
    return [(i * 37 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,width,percent,limit", [(1, 4, 85, 4000), (2, 5, 80, 4000), (3, 4, 85, 4), (4, 5, 80, 6)])
def test_components_agree_with_brute_force(spark, seed, width, percent, limit):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, id int, c int")
    got = sorted((tuple(r) for r in jaccard.join(df, width, percent, limit).collect()), key=str)
    assert got == brute(rows, width, percent)


def test_one_large_group_in_small_blocks(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"z{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(df, limit=10).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_region_recursion_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(40):
            s = set(base.tolist())
            for _ in range(rng.integers(0, 9)):
                s.discard(int(rng.choice(base)))
                s.add(int(rng.integers(0, 400)))
            sets.append(np.array(sorted(s)))
        region = jaccard.Region(sets, 85)
        region.join()
        links = [(i, j) for i, j in combinations(range(40), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        r = roots(40, links)
        mine = [region.root(i) for i in range(40)]
        assert all((r[i] == r[j]) == (mine[i] == mine[j]) for i, j in combinations(range(40), 2))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (5, "other words here now"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (5, 1, 5), (None, 0, None)], key=str)
    assert jaccard.join(df.where(F.lit(False))).count() == 0


def test_many_texts_under_one_id(spark):
    """A third of all rows has no id, a third has one; ids at both ends of long."""
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(40))
    rows = [((None, 5, i)[i % 3], text()) for i in range(150)]
    rows += [(None, rows[0][1]), (5, rows[1][1]), ((1 << 63) - 1, rows[3][1]), (-(1 << 63), rows[4][1] + " end"), (900, "long " * 3 + text() * 300), (901, "long " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=str) == brute(rows, 4, 85)


def test_few_frequent_shingles_and_what_stays_behind(spark, monkeypatch):
    """The order of shingles changes no link; of the tables on the way only those that
    the result reads stay."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    plain = common.written
    monkeypatch.setattr(common, "written", lambda df, name: made.append(plain(df, name)) or made[-1])
    monkeypatch.setattr(jaccard, "FREQUENT_SHINGLES", 1)
    got = jaccard.join(df, limit=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 85)
    assert len(made) > 8 and sum(os.path.exists(x._written.removeprefix("file:")) for x in made) == 2
    common.remove_work(spark)
    assert not any(os.path.exists(x._written.removeprefix("file:")) for x in made)
    assert jaccard.join(df.limit(3)).count() == 3


def test_division_covers_every_link():
    """Whatever links has a region in common."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.choice(2000, 60, replace=False)
        for _ in range(10):
            s = set(base.tolist())
            for x in rng.choice(base, rng.integers(0, 12), replace=False):
                s.discard(int(x))
                s.add(int(rng.integers(2000, 9000)))
            sets.append(np.array(sorted(s)))
    pivots = [sets[i] for i in range(0, 120, 15)]
    links, home, window = jaccard.nearest(sets, pivots, 85)
    assert (home.sum(axis=1) == 1).all() and (window >= home).all() and window.sum() < window.size
    for i, j in combinations(range(len(sets)), 2):
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
            a, b = home[i].argmax(), home[j].argmax()
            assert window[j, a] and window[i, b]
    for i in range(len(sets)):
        for k, p in enumerate(pivots):
            assert links[i, k] == (100 * len(np.intersect1d(sets[i], p)) >= 85 * len(np.union1d(sets[i], p)))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 203), (203, 201), (300, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {205: 201, 203: 201, 201: 201}
    assert got == want
