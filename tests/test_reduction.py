"""Edges taken before the solver, against the solver alone."""

import random

from pyspark.sql import functions as F

from canonry.operators import matching
from canonry.operators.components import components
from canonry.operators.solver import SCALE
from canonry.operators.solver import matching as solve

SCHEMA = "supplier_a string, a_id string, supplier_b string, b_id string, confidence double"


def graph(rng, nodes, edges):
    out = {}
    while len(out) < edges:
        u, v = sorted(rng.sample(range(nodes), 2))
        out[f"{u:03d}", f"{v:03d}"] = rng.choice([0.5, 0.75, rng.random()])
    return out


def frame(spark, g):
    return spark.createDataFrame([("a", u, "b", v, w) for (u, v), w in g.items()], SCHEMA).withColumns({"u": F.concat(F.lit("a"), "a_id"), "v": F.concat(F.lit("b"), "b_id")})


def alone(g):
    return solve([("a" + u, "b" + v, w) for (u, v), w in g.items()])


def weight(g, pairs):
    return sum(round(g[u[1:], v[1:]] * SCALE) for u, v in pairs)


def test_every_best_matching_has_what_is_taken(spark):
    rng = random.Random(8)
    for n, m in ((40, 30), (60, 120), (200, 260)):
        g = graph(rng, n, m)
        told = matching.Reduction()
        taken, rest = matching.reduced(frame(spark, g), told=told)
        took = {(r["u"], r["v"]) for r in taken.collect()}
        left = {(r["a_id"], r["b_id"]): r["confidence"] for r in rest.collect()}
        assert sum(told.taken) == len(took) > 0 and told.left == len(left) < len(g)
        assert weight(g, took) + weight(left, alone(left)) == weight(g, alone(g))
        ends = [x for p in took for x in p] + [x for p in alone(left) for x in p]
        assert len(ends) == len(set(ends))
        made = matching.max_weight_matching(frame(spark, g).drop("u", "v"))
        assert weight(g, {("a" + r["a_id"], "b" + r["b_id"]) for r in made.collect()}) == weight(g, alone(g))


def test_a_hub_and_a_chain_need_no_solver(spark):
    star = {("000", f"{i:03d}"): 0.3 + i / 1000 for i in range(1, 60)}
    chain = {(f"{100 + i:03d}", f"{100 + i:03d}"): 0.9 for i in range(30)} | {(f"{101 + i:03d}", f"{100 + i:03d}"): 0.4 for i in range(29)}
    told = matching.Reduction()
    taken, rest = matching.reduced(frame(spark, chain), told=told)
    assert told.left == 0 and rest.count() == 0 and taken.count() == 30 and told.taken[0] == 30
    size = lambda df: components(df.select(F.col("u").alias("a"), F.col("v").alias("b"))).groupBy("root").count().agg(F.max("count")).first()[0]
    before = frame(spark, star | {("200", "001"): 0.95, ("200", "300"): 0.2})
    _, rest = matching.reduced(before)
    # The heavy edge goes first, with it two leaves; then the hub's best is dominant.
    assert size(before) == 62 and (size(rest) or 0) < 62


def test_ties_are_left_to_the_solver(spark):
    square = {("1", "1"): 0.5, ("1", "2"): 0.5, ("2", "1"): 0.5, ("2", "2"): 0.5}
    told = matching.Reduction()
    taken, rest = matching.reduced(frame(spark, square), told=told)
    assert taken.count() == 0 and rest.count() == 4 and told.left == 4
    assert matching.max_weight_matching(frame(spark, square).drop("u", "v")).count() == 2
    assert matching.max_weight_matching(spark.createDataFrame([], SCHEMA)).count() == 0
