import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from canonry.llm import phrases


def brute(rows, least, top=2000, inside=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        mine = {p for p, v in c.items() if len(p) > 1 and v >= least}
        longer = Counter()
        for p in mine:
            for q in (p[:-1], p[1:]) if len(p) == 3 else ():
                longer[q] = max(longer[q], c[p])
        found = []
        for p in mine:
            if longer[p] and 100 * longer[p] >= inside * c[p]:
                continue
            a = c[p]
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "a", "new", "york", "City", "é", "naïve", "über", "x|y", "b c", "\x00"]
    marks = [" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", " ? "]
    for _ in range(n):
        yield rng.choice(["en", "en", "fr", None, "und"]), "".join(rng.choice(words[: rng.choice([3, 6, 12])]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))


SCHEMA = "lang string, text string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("block", [50, 2000, 8 << 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "SLICES", 5)
    rows = [*texts(block, 200), (None, None), ("en", ""), ("en", " \n.;"), ("fr", "the of " * 30), ("fr", "the of " * 30)]
    for least, top in ((10, 2000), (2, 7)):
        got = [tuple(r[c] for c in COLUMNS) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, top).collect()]
        assert sorted(got) == brute(rows, least, top)


def test_query(spark, tmp_path):
    rows = [(i % 3, *r, "en") for i, r in enumerate(texts(9, 120))]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in phrases.op11_phrases(spark, str(tmp_path)).collect()]
    assert got and sorted(got) == brute([r[1:3] for r in rows], 10)


def test_empty_and_rare(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "one two three")], SCHEMA)).collect() == []


def test_long_text_and_large_counts(spark):
    (r,) = phrases.collocations(spark.createDataFrame([("en", "a " * 300_000)], SCHEMA)).collect()
    # Overlaps count: the pair inside of the triple is dropped.
    assert tuple(r) == ("en", 1, "a a a", 299_998, 300_000, 299_999, 300_000, 10**6 * 299_998**2 // (300_000 * 299_999))


def test_lists_are_cut_and_joined():
    rng = random.Random(5)
    for _ in range(100):
        some = ["".join(rng.choice("ab .\t") for _ in range(rng.randint(0, 30))).encode() for _ in range(4)]
        kind, words, sizes, at = phrases._lists(some, np.array([0, 1, 0, 1]))
        assert (phrases._positions(sizes, phrases._gaps(sizes, at)) == at).all() and len(set(at.tolist())) == len(at)
        want = Counter((i % 2, w) for i, t in enumerate(some) for w in t.replace(b".", b" ").split())
        assert dict(zip(zip(kind.tolist(), (w.encode() for w in words.to_pylist()), strict=True), sizes.tolist(), strict=True)) == want
