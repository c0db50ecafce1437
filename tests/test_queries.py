"""Registered queries against brute force, on tables small enough for it."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import pytest

from canonry.plans.queries import queries

#: Customers a multiple of 10,007 apart have one place and, here, one name: all
#: but the last contest each other.
CUSTOMERS = (1, 10008, 20015, 500)


@pytest.fixture(scope="module")
def contested(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("contested"))
    spark.createDataFrame([(k, "MACHINERY") for k in CUSTOMERS], "c_custkey long, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k % 64, "misty rose") for k in CUSTOMERS], "p_partkey long, p_name string").distinct().write.parquet(f"{d}/part.parquet")
    return d


@pytest.fixture(scope="module")
def rows(spark, contested):
    return lambda name: queries()[name](spark, contested).collect()


@pytest.fixture(scope="module")
def pairs(rows):
    """The best set of valid edges without a common end, found by trying all."""
    edges = {(r["a_id"], r["b_id"]): r["confidence"] for r in rows("valid_edges")}
    free = [s for k in range(len(edges) + 1) for s in combinations(edges, k) if len({x for p in s for x in p}) == 2 * k]
    weight = lambda s: round(sum(edges[p] for p in s), 6)
    best = max(free, key=weight)
    assert sum(weight(s) == weight(best) for s in free) == 1
    degree = Counter(x for p in edges for x in p)
    assert any(degree[x] > 1 for p in best for x in p)
    return set(best)


@pytest.fixture(scope="module")
def single(rows, pairs):
    return {r["id"] for r in rows("feed_union")} - {x for p in pairs for x in p}


def test_singletons_and_near_misses(rows, pairs, single):
    assert {r["id"] for r in rows("singletons")} == single
    assert {(r["a_id"], r["b_id"]) for r in rows("near_misses")} == {(r["a_id"], r["b_id"]) for r in rows("scored_edges")} - pairs


def test_merged_records(rows, pairs, single):
    want = {f"a={a},b={b}" for a, b in pairs} | {f"{x[0].lower()}={x}" for x in single}
    got = rows("source_map")
    assert {r["source_ids"] for r in got} == want and len(got) == len(want)
    assert {r["id"] for r in rows("merge_avg")} == {a for a, _ in pairs} | single
    assert {r["first_id"] for r in rows("canonical_ids")} == {a for a, _ in pairs} | single
    near = {(r["a_id"], r["b_id"]) for r in rows("near_misses")}
    assert len(rows("near_miss_attach")) == 2 * len(near)


def test_statistics(rows, pairs, single):
    (r,) = rows("match_rate")
    assert (r["total"], r["matched"]) == (len(pairs) + len(single), len(pairs))
    assert {r["match_status"]: r["n"] for r in rows("stats_by_status")} == {"matched": len(pairs), "singleton": len(single)}
    assert sum(r["n"] for r in rows("confidence_bands")) == len(pairs)


def test_rooms_of_all_records(spark, contested, rows, pairs):
    from canonry.plans import synthetic

    every = synthetic.rooms(spark, contested).count()
    made = rows("canonical_rooms")
    assert sum(2 if r["match_status"] == "matched" else 1 for r in made) == every
    # Of the contested pairs at least the first has rooms of like names.
    assert "A-000001" in {r["canonical_id"] for r in rows("room_matching")} <= {a for a, _ in pairs}


WORDS = "the often Often café of the tree house ofthe offthe".split()


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Documents of every language, and of none."""
    rng = random.Random(3)
    d = str(tmp_path_factory.mktemp("documents"))
    made = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9))), lang, "web") for i, lang in enumerate(["en", "fr", "de", "es", None] * 8)]
    made += [(90, None, "en", None), (91, "the ofthé", "fr", "web")]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d, made


def test_search_ranks_over_all_documents(spark, documents):
    d, made = documents
    fold = lambda s: re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFKD", s or "").lower() if not unicodedata.combining(c)))
    terms = {f"DOC-{i:09d}": [*fold(f"DOC-{i:09d}"), *fold(t), *fold(s)] for i, t, _, s in made}
    mean = sum(map(len, terms.values())) / len(terms)
    want: dict[str, float] = {}
    hits = [{k: n for k, ts in terms.items() if (n := sum(t.startswith(w) for t in ts))} for w in ("the", "ofth")]
    for k in hits[0].keys() & hits[1].keys():
        idf = [max(1e-6, math.log((len(terms) - len(h) + 0.5) / (len(h) + 0.5))) for h in hits]
        want[k] = sum(i * h[k] * 2.2 / (h[k] + 1.2 * (0.25 + 0.75 * len(terms[k]) / mean)) for i, h in zip(idf, hits, strict=True))
    assert "DOC-000000091" in want and len({made[int(k[4:])][2] for k in want if k < "DOC-000000090"}) == 5
    got = {r["key"]: r["score"] for r in queries()["fts_rank"](spark, d).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert {r["key"] for r in queries()["fts_search"](spark, d).collect()} == want.keys()


def test_every_vector_is_asked(spark, tmp_path):
    rng = random.Random(5)
    v = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(31)}
    spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    cosine = lambda x, y: dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))
    want = {}
    for i, x in stored.items():
        best = sorted((-round(cosine(x, y), 6), j) for j, y in stored.items() if (i - j) % 2)[:5]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(best)}
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in queries()["vector_topk"](spark, str(tmp_path)).collect()}
    assert got == want and {i for i, _ in got} == set(v)


def test_vectors_of_zeros_and_with_nulls(spark):
    from canonry.operators import vectors

    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [1.0, None], 0), (5, [2.0, 0.0], 0), (6, [1.0, 1.0], 1), (7, [float("nan"), 0.0], 0), (8, [float("inf"), 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in vectors.nearest(df.where("vec_id = 1"), df, 2, "side", block=2).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (5, 1.0)}
    assert vectors.nearest(df.where("false"), df, 2, "side").count() == 0


def test_contents_that_differ_late_are_two(spark, tmp_path):
    same = "x" * 5000
    rows = [(1, same + "a", "s"), (2, same + "b", "s"), (3, same + "a", "s"), (4, "y", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: (r["n"], r["urls_md5"]) for r in queries()["image_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {"s": (2, hashlib.md5(b"doc/000000001|doc/000000002").hexdigest()), "t": (1, hashlib.md5(b"doc/000000004").hexdigest())}
