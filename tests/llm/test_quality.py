import random

import numpy as np
from pyspark.sql import functions as F

from canonry.llm import quality


def text(rng, good):
    w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
    return " ".join(w).capitalize() + "." if good else " ".join(x + "***" for x in w)


def tables(spark, n=400):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(n, None, "s"), (n + 1, "", "s"), (None, "x " * 50000, None)], "doc_id long, text string, __own string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    return docs, labels, {i: q for i, _, q in rows}


def test_held_out_accuracy_and_whole_tables(spark):
    docs, labels, truth = tables(spark)
    model = quality.learn(docs, labels)
    assert 0 < len(model.rules) < 200
    rows = quality.score(docs, model).withColumn("out", quality.held_out()).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["out"] and r["doc_id"] in truth]
    assert sum((r["score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in out) >= 0.97 * len(out) > 0


def test_whole_query_against_plain_scoring(spark, tmp_path):
    """Every row scored by rules that are read off the model one by one."""
    import math
    import zlib

    docs, labels, _ = tables(spark, 240)
    more = docs.unionByName(docs.where("doc_id = 7")).unionByName(spark.createDataFrame([(7, "other text of that id", "s")] * 3, docs.schema))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(labels.where("doc_id = 7")).write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.learn(read.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model.rules
    want = []
    for r in read.collect():
        x = quality.statistics(r["text"])
        z = model.intercept + sum(w for rule, w in model.rules if all((x[f] > v) == above for f, above, v in rule))
        score = 1 / (1 + math.exp(-z))
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        want.append((r["doc_id"], out, round(score, 9), int(score >= 0.7)))
    got = [(r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in quality.op6_quality(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_column_and_array_scores_agree(spark):
    docs, labels, _ = tables(spark, 150)
    model = quality.learn(docs, labels)
    x = np.array([quality.statistics(r["text"]) for r in docs.collect()])
    got = sorted(r["score"] for r in quality.score(docs, model).collect())
    assert np.allclose(got, sorted(model.scores(x)))


def test_no_labels_and_empty_tables(spark):
    docs, labels, _ = tables(spark, 20)
    none = quality.learn(docs, labels.where(F.lit(False)))
    assert {round(r["score"], 6) for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where(F.lit(False)), none).count() == 0
    assert quality.learn(docs.where(F.lit(False)), labels).rules == []


def test_lasso_drops_idle_rules():
    rng = np.random.default_rng(0)
    h = (rng.random((2000, 20)) < 0.5).astype(float)
    y = (rng.random(2000) < np.where(h[:, 3] > 0, 0.9, 0.1)).astype(float)
    _, w = quality.lasso(h, y, 0.03)
    assert np.argmax(np.abs(w)) == 3 and (np.abs(w) > 1e-6).sum() <= 3


def test_words_are_bare_as_a_whole():
    share = lambda t: quality.statistics(t)[quality.STATISTICS.index("bare_marks")]
    assert abs(share("========Heading --------1 ========é ======== --- a") - 2 / 6) < 1e-9
