import hashlib
import random

from pyspark.sql import functions as F

from canonry.llm import fingerprints as fp


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(n))


def jaccard(a, b):
    s = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set() for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


def test_likeness_estimates_jaccard():
    rng, own = random.Random(1), fp.Sketcher()
    error = []
    for n in (6, 40, 300, 3000):
        for share in (0, 0.2, 0.5, 0.9, 1):
            a = words(rng, n)
            k = int(n * share)
            b = " ".join(a.split()[:k] + words(rng, n - k).split())
            x, y = own.fingerprints([a, b])
            error.append(own.likeness(x, y) - jaccard(a, b))
    assert max(map(abs, error)) < 0.15 and abs(sum(error) / len(error)) < 0.03


def test_empty_and_short_texts():
    own = fp.Sketcher()
    none, blank, one, same, other = own.fingerprints([None, " \n", "one two", "one  two", "one three"])
    assert none == blank == b"" and one == same != other
    assert own.likeness(none, blank) == 1 and own.likeness(none, one) == 0 and own.likeness(one, same) == 1 and own.likeness(one, other) < 0.2


def test_neighbours_and_edits(spark, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH_ROWS", 3)
    rng = random.Random(2)
    rows = [(i * 7 % 101, words(rng, rng.randint(0, 30)) if i % 9 else None, "x") for i in range(40)] + [(1000, "é" * 100, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stretch string")
    got = {r["doc_id"]: r for r in fp.compare_with_edits(df).collect()}
    ordered = sorted(((k, t or "") for k, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    own = fp.Sketcher()
    for i, (k, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = own.fingerprints([t, edited, following])
        assert got[k]["near_edited"] == own.likeness(a, b) and got[k]["near_next"] == own.likeness(a, c)


def test_rows_of_one_id_and_without_any_are_cut(spark, monkeypatch):
    """A third of all rows has one id, a third has none; every row meets its next."""
    monkeypatch.setattr(fp, "STRETCH_ROWS", 4)
    monkeypatch.setattr(fp, "ROWS_A_CUT", 2)
    rng = random.Random(6)
    rows = [((7, None, i)[i % 3], words(rng, rng.randint(1, 9))) for i in range(150)] + [(9223372036854775807, "top"), (-9223372036854775808, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    ordered = df.orderBy(*fp._order()).collect()
    counts = [r["count"] for r in fp.stretches(df).where("not guest").groupBy("stretch").count().collect()]
    assert sum(counts) == len(rows) and len(counts) > 12 and max(counts) < 40
    want = sorted((r["doc_id"] or 0, hashlib.sha256(fp.edited(r["text"], ordered[(i + 1) % len(ordered)]["text"]).encode()).hexdigest()) for i, r in enumerate(ordered))
    assert sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in fp.compare_with_edits(df).collect()) == want


def test_empty_table_one_row_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x")], "doc_id long, text string")
    assert fp.compare_with_edits(df.where(F.lit(False))).count() == 0
    assert [r["near_next"] for r in fp.compare_with_edits(df.where("doc_id = 1").limit(1)).collect()] == [1.0]
    rows = fp.compare_with_edits(df).collect()
    assert len(rows) == 3 and len({r["fingerprint"] for r in rows}) == 2
    assert {bytes(r["fingerprint"]) for r in fp.fingerprint(df).collect()} == set(fp.Sketcher().fingerprints(["a b c d e f", "x"]))
