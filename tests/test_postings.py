"""Block postings against the plain ranking, trigrams against patterns."""

import random

import pytest
from pyspark.sql import functions as F

from canonry.functions.text import fold
from canonry.operators import postings, search

WORDS = "the theme often crystal castle lake of it's road rOad ñandú".split()
SCHEMA = "id string, name string, address string"


def documents(seed, n):
    rng = random.Random(seed)
    return [(f"D{i:04d}", " ".join(rng.choices(WORDS, weights=[1 + j for j in range(len(WORDS))], k=rng.randint(0, 12))), rng.choice(["", "1 Lake Rd", "50% off_road"])) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame(documents(1, 300), SCHEMA).cache()
    numbered = postings.numbers(docs, "id").cache()
    return docs, numbered, postings.term_blocks(docs, numbered, "id", size=16).cache(), postings.gram_blocks(docs, numbered, "id", size=16).cache()


@pytest.mark.parametrize(("query", "k"), [("the", 1), ("the", 20), ("th road", 7), ("castle lake of", 50), ("crystal", 1000), ("d0 the", 3), ("zzz", 5), ("the zzz", 5)])
def test_top_is_that_of_the_ranking(spark, indexed, query, k):
    docs, numbered, blocks, _ = indexed
    phrases = search.query_phrases(query, spark)
    every = sorted(((-r["score"], r["key"]) for r in search.ranked(search.index_terms(docs, "id", search.COLUMNS), docs, "id", phrases).collect()))
    got = [(-r["score"], r["key"]) for r in postings.top(blocks, numbered, phrases, k, 16, 2).collect()]
    near = lambda rows: sorted((round(s, 9), i) for s, i in rows)
    assert near(got) == near(sorted((round(s, 9), i) for s, i in every)[:k])
    assert postings.total(blocks, phrases) == len(every)


def test_most_blocks_are_not_scored(spark):
    docs = spark.createDataFrame([(f"D{i:04d}", "rare rare rare" if i == 1234 else "rare " + "word " * 30, "") for i in range(2000)], SCHEMA)
    numbered = postings.numbers(docs, "id")
    told = postings.Read()
    got = postings.top(postings.term_blocks(docs, numbered, "id", size=32), numbered, [["rare"]], 1, 32, 2, told).collect()
    assert [r["key"] for r in got] == ["D1234"] and told.ranges == 63 and told.scored == 2


def test_phrases_and_empty_tables(spark, indexed):
    _, numbered, blocks, _ = indexed
    with pytest.raises(ValueError, match="positions"):
        postings.top(blocks, numbered, search.query_phrases("it's", spark), 5)
    assert postings.top(blocks, numbered, [], 5).collect() == []
    none = spark.createDataFrame([], SCHEMA)
    nothing = postings.numbers(none, "id")
    assert postings.top(postings.term_blocks(none, nothing, "id"), nothing, [["a"]], 5).collect() == []


@pytest.mark.parametrize("query", ["road", "ROAD", "castle", "the c", "le%ro", "50%", "f_ro", "ñan", "rd", "", "xyz", "Lake Rd", "a\\b"])
def test_substrings_by_trigrams(indexed, query):
    docs, numbered, _, grams = indexed
    among = postings.may_match(grams, numbered, query, 16)
    assert (among is None) == (max(map(len, query.replace("_", "%").split("%"))) < 3)
    total, page = search.like_total(docs, query, 200)
    total_too, page_too = search.like_total(docs, query, 200, among=among)
    assert (total, [r["id"] for r in page.collect()]) == (total_too, [r["id"] for r in page_too.collect()])


def test_postings_never_leave_the_task_of_their_range(spark):
    docs = spark.createDataFrame(documents(2, 50), SCHEMA)
    blocks = postings.term_blocks(docs, postings.numbers(docs, "id"), "id", size=16)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "Exchange" not in above and "Exchange" in below
    # Nor is a text of plain letters looked up letter by letter.
    assert spark.sql("select 'ABC', 'Äb'").select(*(fold(F.col(c)) for c in ("ABC", "Äb"))).first()[:] == ("abc", "ab")
