import hashlib
import random
import zlib

import pytest

from canonry.llm import runs


def brute(w, least=4, words=6):
    """All maximal stretches of every period, without those of a smaller one."""
    out = []
    for q in range(1, len(w) // least + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(words, least * q) and not any(all(w[s + t] == w[s + t + p] for t in range(n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.randint(1, 4), rng.randint(0, 40)
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            again = [rng.randrange(k + 1) for _ in range(rng.randint(1, 5))] * 10
            w[n // 2 : n // 2] = again[: rng.randint(1, 40)]
        yield w


def test_runs_are_those_of_brute_force():
    for w in sequences():
        for least, words in ((4, 6), (2, 1), (3, 1)):
            assert runs.find_runs(w, least, words) == brute(w, least, words), w
        words = [b"%d" % x for x in w]
        assert runs.runs_of([words, [], words]) == [brute(w), [], brute(w)]


def test_next_smaller_suffixes():
    for w in sequences():
        following, extent = runs.next_smaller(w)
        for i, (j, m) in enumerate(zip(following, extent, strict=True)):
            assert j == next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            if j < len(w):
                assert w[i : i + m] == w[j : j + m] and (j + m == len(w) or w[i + m] != w[j + m])


class Counted(int):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.seen += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "make",
    [lambda n: [0] * n, lambda n: [i & 1 for i in range(n)], _fibonacci, lambda n: [i.bit_count() & 1 for i in range(n)], lambda n: [(i & -i).bit_length() for i in range(1, n)], lambda n: ((([0] * 3 + [1]) * 3 + [2]) * 3 + [3]) * (n // 120), lambda n: [min(i, n - i) for i in range(n)], lambda n: sum(([0] * k + [1] for k in range(1, int((2 * n) ** 0.5))), [])],
)
def test_comparisons_are_linear(make):
    for n in (1000, 10_000, 40_000):
        for sign in (1, -1):
            w = [Counted(sign * x) for x in make(n)]
            Counted.seen = 0
            runs.next_smaller(w)
            assert Counted.seen <= 5 * len(w)


SCHEMA = "doc_id long, text string, runs int, collapsed string, lang string"


def test_edges(spark):
    long = "a b c " * 20_000
    texts = [None, "", " \t\n", "x", "a a a a a", "a a a a a a", "a b a b a b a b", "A a A a A a a a", long, "x y " * 7]
    rows = [(i, t, 1, "z", "en") for i, t in enumerate(texts)] + [(3, "y y y y y y y", 1, "z", None), (None, "a a a a a a", None, None, None), (3, "x", 1, "z", "en")]
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(0, [], ""), (1, [], ""), (2, [], ""), (3, [], "x"), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"), (6, [(0, 8, 2)], "a b"), (7, [], "A a A a A a a a"), (8, [(0, 60_000, 3)], "a b c"), (9, [(0, 7, 1)], "x y"), (3, [(0, 7, 1)], "y"), (None, [(0, 6, 1)], "a"), (3, [], "x")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60))), "en") for i in range(400)] + [(7, None, None), (None, "b b b b b b b", None), (8, "c c c c c c c c a a a a a a", "de"), (8, "c c c c c c c c a a a a a a", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for doc_id, text, _ in rows:
        w = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(found), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in runs.op13_runs(spark, str(tmp_path)).collect()]
    assert planted > 20 and sorted(got, key=repr) == sorted(want, key=repr)
