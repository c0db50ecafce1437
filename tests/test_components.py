"""Components of long ways."""

import random

from pyspark.sql import functions as F

from canonry.operators.components import components


def test_long_ways_settle_in_few_rounds(spark):
    rng, n = random.Random(5), 1500
    ids = rng.sample(range(10 * n), n)
    edges = [(f"{a:06d}", f"{b:06d}") for a, b in zip(ids, ids[1:])] + [("x", "y"), ("y", "z"), ("x", "x")]
    made = components(spark.createDataFrame(edges, "a string, b string"), rounds=14)
    assert {r["root"] for r in made.where("node < 'a'").collect()} == {f"{min(ids):06d}"}
    assert made.where("node >= 'a'").agg(F.count("*"), F.min("root"), F.max("root")).first()[:] == (3, "x", "x") and made.count() == n + 3
    # The plan's estimate is a number of a few digits, however many rounds there were.
    assert int(str(made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**64
