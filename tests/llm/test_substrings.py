import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonry.llm import fmindex, substrings


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 900)}"
    passages = [[word() for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for _ in range(80):
        w = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(w))
            cut = rng.randint(0, 10)
            w[at:at] = p[cut : len(p) - rng.randint(0, 10)]
        rows.append(" ".join(w))
    rows += [rows[3], "be " * 100, "be " * 34, "a b " * 40, None, "", " \n ", " ".join(["x"] * 60), "é " * 35]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,limit,shard,width", [(1, 1000, 400_000, 35), (2, 3, 400_000, 35), (3, 1000, 200, 35), (4, 1, 100, 35), (5, 1000, 400_000, 90), (6, 2, 400_000, 8)])
def test_agrees_with_brute_force(spark, monkeypatch, seed, limit, shard, width):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, digest string, id int")
    assert sorted((tuple(r) for r in substrings.remove_repeats(df, width, limit=limit).collect()), key=str) == brute(rows, width)


def test_long_passage_of_a_third_of_all_documents(spark):
    """A passage of 1,000 words in 40 of 120 documents, and one of 300 in two."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 99999)}"
    p, q = [word() for _ in range(1000)], [word() for _ in range(300)]
    rows = []
    for i in range(120):
        own = [[word() for _ in range(rng.randint(5, 60))] for _ in range(2)]
        rows.append((i % 7, " ".join(own[0] + (p if i < 40 else q if i < 42 else []) + own[1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, limit in ((35, 5), (90, 1000)):
        assert sorted((tuple(r) for r in substrings.remove_repeats(df, width, limit=limit).collect()), key=str) == brute(rows, width)


def test_halves_keep_every_window():
    for window in (8, 9, 35, 50):
        for windows in range(1, window - 6):
            for place in range(windows - 1, window - 7):
                cuts = substrings.halves(place, 8, windows, window) if window > 8 else []
                assert [w for a, z, _, _ in cuts for w in range(a, z + 1)] == (list(range(windows)) if cuts else [])
                for a, z, at, size in cuts:
                    assert size > 8 and at - (z - a) >= 0 and at + size <= window


def test_narrow_window_is_refused(spark):
    with pytest.raises(ValueError):
        substrings.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 7)


def test_texts_are_cut_in_place(spark):
    rng = random.Random(4)
    p = " ".join(f"p{rng.randint(0, 9999)}" for _ in range(50))
    rows = [(1, f"one\n\ttwo  three\n{p} four\nfive", "k"), (2, f"six {p}", "k"), (2, f"six {p}", "k"), (3, "left  alone\n", "k"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((tuple(r) for r in substrings.without_repeats(df).collect()), key=str)
    assert got == sorted([(1, "one\n\ttwo  three four\nfive", "k"), (2, "", "k"), (2, "", "k"), (3, "left  alone\n", "k"), (None, None, "k")], key=str)


def test_repeated_rows_null_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(7, t), (7, t), (None, "w1 w2"), (8, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(0, 2, 0), (7, 40, 40), (7, 40, 40), (8, 0, 0)]
    assert substrings.remove_repeats(df.where(F.lit(False))).count() == 0


def test_index_counts_and_windows():
    rng = np.random.default_rng(1)
    for _ in range(10):
        seqs = [rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint32) for _ in range(12)]
        index = fmindex.FMIndex(seqs, np.ones(12, np.int64))
        bwt_rank = lambda s, i: int(index.rank(np.array([s]), np.array([i]))[0])
        pattern = seqs[0][: rng.integers(1, 4)]
        lo, hi = 0, index.n
        for w in pattern[::-1]:
            s = int(np.searchsorted(index.alphabet, w)) + 1
            lo, hi = int(index.smaller[s]) + bwt_rank(s, lo), int(index.smaller[s]) + bwt_rank(s, hi)
        k = len(pattern)
        assert hi - lo == sum((x[i : i + k] == pattern).all() for x in seqs for i in range(len(x) - k + 1))
        for weights in (np.ones(12, np.int64), rng.integers(1, 3, 12)):
            which, first, last = fmindex.FMIndex(seqs, weights, 5).repeated_windows(5)
            seen = Counter()
            for x, w in zip(seqs, weights.tolist(), strict=True):
                for i in range(len(x) - 4):
                    seen[tuple(x[i : i + 5])] += w
            for n, x in enumerate(seqs):
                got = {i for k, a, z in zip(which, first, last, strict=True) if k == n for i in range(a, z + 1)}
                assert got == {i for i in range(len(x) - 4) if seen[tuple(x[i : i + 5])] > 1}
