import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from canonry.llm import rules, shingles

WORDS = {"en": "the of and to in is that it was for".split(), "fr": "le la et les des un une que est pour".split()}


def prose(rng, lang, n):
    made = [rng.choice(WORDS[lang]) if rng.random() < 0.6 else "".join(rng.choices("aeioulnrst", k=rng.randint(4, 9))) for _ in range(n)]
    return " ".join(made) + "."


def fixture():
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, rng.randint(20, 200)), lang) for i, lang in enumerate(["en", "en", "fr"] * 80)]
    # A group of copies as large as a third of all, of words that the language hasn't.
    other = " ".join("".join(rng.choices("xyzq", k=6)) for _ in range(120))
    rows += [(1000 + i, other, "en") for i in range(120)]
    junk = ["A%d! " % i * 3 + " ".join(w.upper() + "!!" for w in prose(rng, "en", 90).split()) for i in range(5)] + [" ".join(w + "$$$" for w in prose(rng, "fr", 90).split()) for _ in range(5)]
    rows += [(2000 + i, t, "en" if i < 5 else "fr") for i, t in enumerate(junk)]
    rows += [(3000, None, "en"), (3001, "", None), (3002, prose(rng, "en", 300), "xx"), (3003, prose(rng, "fr", 60), None), (3004, "the of\nand to\nthe of\n\n \nthe of " * 12, "en"), (3005, "# $ a|b <c> *", "en"), (3006, "one two three four five six seven eight nine " * 8, "en"), (None, rows[0][1], "en"), (0, rows[0][1], "en")]
    return rows


SCHEMA = "doc_id long, text string, lang string"


def brute(rows):
    """The whole query, one document and one word at a time."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    kind = lambda c: next(i for i, p in enumerate(("[a-z]", "[A-Z]", "[0-9]", "[ \t]", "[\n-\r]", r"[.,;:!?'\"()-]", "[!-~]", r"[\x80-\U0010FFFF]", ".")) if re.match(p, c, re.S))
    counts, chars, texts = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, t, lang in rows:
        if lang is None:
            continue
        h, _ = shingles.shingle_hashes([t], 5, shingles.lower_words)
        bucket = int(shingles.mix(np.array([h.min() if len(h) else 0], np.uint64))[0] % np.uint64(rules.BUCKETS))
        counts[lang, bucket].update(map(low, split(t)))
        chars[lang].update(map(kind, t or ""))
        texts[lang] += 1
    refs = {}
    for lang, n in texts.items():
        own = [c for (x, _), c in counts.items() if x == lang and c]
        if n < rules.LEAST_TEXTS or 2 * len(own) <= rules.BUCKETS:
            continue
        median = lambda w: sorted(c[w] / c.total() for c in own)[(len(own) + 1) // 2 - 1]  # noqa: B023, E731
        top = sorted(((-m, w) for w in set().union(*own) if (m := median(w)) > 0))[: rules.COMMON]
        refs[lang] = ({w: -m for m, w in top}, chars[lang])

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)) / 2))

    out = []
    for doc_id, t, lang in rows:
        w, t = split(t), t or ""
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if split(x)]
        base = len(w) < 20 or 100 * len(again) > 30 * len(w)
        kept = not base
        if lang in refs and kept:
            words, of_class = refs[lang]
            seen = Counter(map(low, w))
            p = [seen[x] for x in words]
            if distance([sum(kind(c) == i for c in t) for i in range(9)], [of_class[i] for i in range(9)]) > rules.CLASS_FLOOR + rules.CLASS_SPREAD / math.sqrt(len(w)):
                kept = False
            if len(w) >= rules.WORD_WORDS and distance([*p, len(w) - sum(p)], [*words.values(), 1 - sum(words.values())]) > rules.WORD_FLOOR + rules.WORD_SPREAD / math.sqrt(len(w)):
                kept = False
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), base, kept))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in rules.op12_rules(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    kept = {r[0]: r[-1] for r in got}
    assert all(kept[i] for i in range(240)) and not any(kept[2000 + i] for i in range(10))
    # Copies, however many, are not what the language is like.
    assert not any(kept[1000 + i] for i in range(120))
    assert kept[3002] and kept[3003] and not kept[3006]


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(200):
        texts = [[b"%d" % rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(4)]
        codes, _, sizes = rules._encoded(texts)
        for width in (2, 4, 8):
            want = []
            for t in texts:
                seen = Counter(tuple(t[i : i + width]) for i in range(len(t) - width + 1))
                want.append(len({j for i in range(len(t) - width + 1) if seen[tuple(t[i : i + width])] > 1 for j in range(i, i + width)}))
            assert rules.repeated_words(codes, sizes, width).tolist() == want


def test_distance():
    assert rules.js_distance(np.array([[1, 0], [2, 2], [0, 0]]), np.array([0, 5])) == pytest.approx([1, rules.js_distance(np.array([1, 1]), np.array([0, 1])), math.sqrt(0.5)])
    assert rules.js_distance(np.array([3, 1]), np.array([0.75, 0.25])) == pytest.approx(0)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA + ", kept int, n_words string")
    assert rules.judged(empty).collect() == []
    one = spark.createDataFrame([(1, "a " * 30, "en", 5, "z")], SCHEMA + ", kept int, n_words string")
    (r,) = rules.judged(one).collect()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"], r["class_distance"]) == (30, 30, True, False, None)


def test_long_text(spark):
    text = prose(random.Random(1), "en", 150_000)
    (r,) = rules.judged(spark.createDataFrame([(1, text, "en")], SCHEMA)).collect()
    assert (r["n_words"], r["n_repeat_words"], r["kept"]) == (150_000, 0, True)
