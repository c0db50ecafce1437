"""Postings in blocks: the best matches without scoring every hit, and substring search
by trigrams.

Rows are numbered in order of their key and cut into ranges of ``RANGE``.  A block holds a
term's rows of one range: their places in it, how often the term stands in them, their
lengths, and the greatest share of a score that any of them can have.  A query adds up
these bounds range by range, scores the ranges with the greatest bounds, and after them
only those whose bound reaches the last score of the page (block-max pruning)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import once, search_terms
from canonry.operators import merge, search
from canonry.session import persist_cut

#: Rows of a range, ranges that are scored at first, and room for rounding in bounds.
RANGE, FIRST, SLACK = 4096, 8, 1e-9
GRAM = 3


def numbers(docs: DataFrame, key: str, columns: tuple[str, ...] = search.COLUMNS) -> DataFrame:
    """``key``, its number ``doc`` in order of keys, and ``len``, its terms."""
    # Cut, for sorting looks at its rows twice.
    own = persist_cut(search.index_lengths(docs, key, columns))
    return merge.numbered(own, [F.col("key")], "n").select("key", (F.col("n") - 1).alias("doc"), "len")


def _range(doc: Column, size: int) -> list[Column]:
    return [F.floor(doc / size).cast("long").alias("range"), F.pmod(doc, F.lit(size)).cast("short").alias("place")]


def term_blocks(docs: DataFrame, numbered: DataFrame, key: str, columns: tuple[str, ...] = search.COLUMNS, size: int = RANGE) -> DataFrame:
    """``term``, ``range``, ``places``, ``counts``, ``lens`` and ``most``, the greatest share
    f / (f + k) in the block; each task's in order of terms.  Texts are sent to the task of
    their range, which counts and gathers; no single posting leaves it."""
    mean = numbered.agg(F.avg("len")).first()[0] or 1.0
    own = docs.select(F.col(key).alias("key"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).join(numbered, "key")
    placed = own.select(*_range(F.col("doc"), size), F.col("len").cast("int").alias("len"), *(f"c{i}" for i in range(len(columns)))).repartition("range")
    terms = F.concat(*(search_terms(F.col(f"c{i}")) for i in range(len(columns))))
    each = placed.select("range", "place", "len", F.explode(terms).alias("term")).groupBy("range", "term", "place", "len").agg(F.count("*").cast("int").alias("f"))
    part = F.col("f") / (F.col("f") + search.K1 * (1 - search.B + search.B * F.col("len") / mean))
    rows = F.array_sort(F.collect_list(F.struct("place", "f", "len")))
    made = each.groupBy("range", "term").agg(rows.alias("rows"), F.max(part).alias("most"))
    pick = lambda c: F.transform("rows", lambda x: x[c])
    return made.select("term", "range", pick("place").alias("places"), pick("f").alias("counts"), pick("len").alias("lens"), "most").sortWithinPartitions("term", "range")


@dataclass
class Read:
    """What a search has looked at."""

    ranges: int = 0
    scored: int = 0


def top(blocks: DataFrame, numbered: DataFrame, phrases: list[list[str]], k: int, size: int = RANGE, first: int = FIRST, told: Read | None = None) -> DataFrame:
    """``key`` and ``score`` of the ``k`` best rows that hold all ``phrases``, as
    ``search.ranked`` scores them; ties to the lesser key.  Phrases are single terms with a
    free end; those of several terms need positions, which blocks don't have."""
    if any(len(p) != 1 for p in phrases):
        raise ValueError("blocks hold no positions; search.ranked finds phrases of several terms")
    whole = numbered.agg(F.count("*").alias("docs"), F.avg("len").alias("mean")).first()
    if not phrases or not whole["docs"]:
        return numbered.select("key", F.lit(0.0).alias("score")).where(F.lit(False))
    docs, mean = whole["docs"], whole["mean"] or 1.0
    bounds, idfs = None, []
    for i, (prefix,) in enumerate(phrases):
        own = blocks.where(F.col("term").startswith(prefix))
        # Shares of several terms with one prefix: their sum is no less than the share of all.
        of = persist_cut(own.groupBy("range").agg(F.least(F.sum("most"), F.lit(1.0)).alias(f"b{i}"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n")))
        n = of.agg(F.sum("n")).first()[0] or 0
        idfs.append(F.greatest(F.lit(search.LEAST_IDF), F.log((docs - n + F.lit(0.5)) / (n + 0.5))))
        bounds = of.drop("n") if bounds is None else bounds.join(of.drop("n"), "range")
    bound = reduce(lambda a, b: a + b, (idf * (search.K1 + 1) * F.col(f"b{i}") for i, idf in enumerate(idfs)))
    ranges = persist_cut(bounds.select("range", bound.alias("bound")))

    def scored(some: DataFrame) -> DataFrame:
        out = None
        for (prefix,), idf in zip(phrases, idfs, strict=True):
            own = blocks.where(F.col("term").startswith(prefix)).join(some.select("range"), "range", "left_semi")
            each = own.select("range", F.explode(F.arrays_zip("places", "counts", "lens")).alias("x")).select((F.col("range") * size + F.col("x.places")).alias("doc"), F.col("x.counts").alias("f"), F.col("x.lens").alias("len"))
            hits = each.groupBy("doc").agg(F.sum("f").alias("f"), F.first("len").alias("len"))
            score = idf * F.col("f") * (search.K1 + 1) / (F.col("f") + search.K1 * (1 - search.B + search.B * F.col("len") / mean))
            one = hits.select("doc", score.alias("s"))
            out = one.select("doc", F.col("s").alias("score")) if out is None else out.join(one, "doc").select("doc", (F.col("score") + F.col("s")).alias("score"))
        return out.orderBy(F.desc("score"), "doc").limit(k)

    start = persist_cut(ranges.orderBy(F.desc("bound"), "range").limit(first))
    best = persist_cut(scored(start))
    bar = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    more = ranges.join(start.select("range"), "range", "left_anti")
    if bar["n"] >= k:
        more = more.where(F.col("bound") >= bar["least"] - SLACK)
    more = persist_cut(more)
    rest = more.count()
    if told is not None:
        told.ranges, told.scored = ranges.count(), start.count() + rest
    if rest:
        best = best.unionByName(scored(more))
    return best.orderBy(F.desc("score"), "doc").limit(k).join(numbered, "doc").select("key", "score")


def total(blocks: DataFrame, phrases: list[list[str]]) -> int:
    """Rows that hold all phrases of one term each; nothing is scored."""
    both = None
    for i, (prefix,) in enumerate(phrases):
        own = blocks.where(F.col("term").startswith(prefix)).groupBy("range").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias(f"p{i}"))
        both = own.withColumnRenamed("p0", "places") if both is None else both.join(own, "range").withColumn("places", F.array_intersect("places", f"p{i}")).drop(f"p{i}")
    return 0 if both is None else both.agg(F.sum(F.size("places"))).first()[0] or 0


def _grams(text: Column) -> Column:
    def cut(low: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM)))

    return F.array_distinct(once(F.lower(text), cut))


def gram_blocks(docs: DataFrame, numbered: DataFrame, key: str, columns: tuple[str, ...] = ("name", "address"), size: int = RANGE) -> DataFrame:
    """``col``, ``gram``, ``range`` and the ``places`` of rows whose column has the gram."""
    each = F.array(*(F.struct(F.lit(i).alias("col"), _grams(F.col(c)).alias("grams")) for i, c in enumerate(columns)))
    rows = docs.select(F.col(key).alias("key"), F.explode(each).alias("c")).select("key", "c.col", F.explode("c.grams").alias("gram")).where(F.length("gram") == GRAM)
    placed = rows.join(numbered.select("key", "doc"), "key").select("col", "gram", *_range(F.col("doc"), size))
    return placed.groupBy("col", "gram", "range").agg(F.sort_array(F.collect_list("place")).alias("places")).sort("col", "gram", "range")


def query_grams(query: str) -> list[str]:
    """Grams that whatever matches ``%query%`` holds; ``%`` and ``_`` stand for anything."""
    parts = re.split("[%_]", query.lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def may_match(grams: DataFrame, numbered: DataFrame, query: str, size: int = RANGE) -> DataFrame | None:
    """``key`` of rows with all grams of the query in one column, which a pattern must still
    be held against; None if the query is too short to have any."""
    wanted = query_grams(query)
    if not wanted:
        return None
    some = grams.where(F.col("gram").isin(wanted)).groupBy("col", "range").agg(F.count("*").alias("n"), F.collect_list("places").alias("lists")).where(F.col("n") == len(wanted))
    # Lists are at most a range long.
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    found = some.select("range", F.explode(both).alias("place")).select((F.col("range") * size + F.col("place")).alias("doc")).distinct()
    return found.join(numbered, "doc").select("key")
