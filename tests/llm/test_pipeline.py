import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def make(spark, path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(60, 150))) + "." for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    rows = [(i, t, "en", "s", len(t), i) for i, t in enumerate(clean)]
    rows += [(200 + i, " ".join(word() + "###" for _ in range(80)), "en", "s", 1, i) for i in range(60)]  # junk
    rows += [(300, clean[0], "en", "s", 1, 0), (301, clean[1] + " end", "en", "s", 1, 0)]  # copies
    rows += [(310 + i, " ".join(word() for _ in range(70)) + " " + passage + " " + " ".join(word() for _ in range(70)), "en", "s", 1, 0) for i in range(3)]
    rows += [(0, clean[0], "en", "s", 1, 0), (None, " ".join(word() for _ in range(50)), None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest int"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(120), *range(200, 260)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return clean, passage


def test_stages_one_after_another(spark, tmp_path):
    clean, passage = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert made.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    ids = {n: {r["doc_id"] for r in d.collect()} for n, d in seen.items()}
    assert not ids["quality"] & set(range(200, 260)) and set(range(120)) <= ids["quality"]
    assert {300, 301} & ids["near_duplicates"] == set() and set(range(120)) <= ids["near_duplicates"] and None in ids["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in seen["substrings"].collect()}
    assert all(texts[i] == clean[i] for i in range(120))
    assert all(passage not in texts[310 + i] and len(texts[310 + i].split()) == 140 for i in range(3))
    assert {r["n_chars"] == len(r["text"]) for r in seen["substrings"].collect()} == {True}
    assert ids["packing"] == ids["substrings"] and pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_another_text_of_a_dropped_id_stays(spark, tmp_path):
    rng = random.Random(5)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 9999)}" for _ in range(60)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (7, c), (7, c), (None, c + " x"), (None, b), (9, None), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (7, c), (9, None), (9, None), (None, None)], key=str)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", None, None, None)], schema)
    for name, stage in pipeline.STAGES:
        odd = stage(spark, odd, str(tmp_path))
        assert odd.count() >= 2, name


def test_quality_stage_rejects_what_the_operator_does(spark, tmp_path, monkeypatch):
    import math

    from canonry.llm import quality

    spark.createDataFrame([(1, "Some words.", "en", "web", 11)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.quality_stage(spark, docs, str(tmp_path)).count() == 1  # nothing to learn from
    for p, kept in ((0.45, 0), (0.6, 0), (0.75, 1)):
        monkeypatch.setattr(quality, "learn", lambda *a, p=p: quality.Ensemble(math.log(p / (1 - p)), []))
        assert quality.op6_quality(spark, str(tmp_path)).first()["predicted"] == kept
        assert pipeline.quality_stage(spark, docs, str(tmp_path)).count() == kept
