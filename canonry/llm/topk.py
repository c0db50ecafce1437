"""Exact top-k by inner product with no-random-access aggregation.

Vectors lie in blocks.  A block keeps, for every dimension, its vectors sorted by
that component.  For a query the lists are read in step and in chunks, from the end
where the query's component makes the largest products.  What has been read of a
vector gives its lower bound (unread components count as their list's worst value);
where the lists have come to gives the upper bound, of a vector that no list has
shown yet and of each that some have.  Reading stops when neither an unseen vector
nor more than a few of the seen ones can reach the bar, the k-th best lower bound;
the final scores of those few are resolved.  A query first meets its own block, and
carries the k-th best score from there to all other blocks as their least bar.

A block's lists are built once and the queries stream past them: a vector is copied
once for every ``QUERIES`` of them, a query once a block.  The work is queries times
vectors in the worst case, as in any exact search.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without an id take no part; vectors of unequal length are padded with
zeros; a query is never its own candidate, nor is another row of its id; ties go
to the smaller id; repeated rows count each; with fewer candidates than k all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
VECTOR_BLOCK = 4096
#: Queries that one task sends past a block.
QUERIES = 65_536
#: Chunks that a list is read in, how many of them are read before the bounds are
#: looked at, and the queries that read on at once.
CHUNKS, FIRST_CHUNKS, AT_ONCE = 16, 8, 64
#: Seen vectors for each of the k best whose scores are resolved at last.
FEW = 8


class SortedLists:
    """The sorted lists of one block of vectors.  For each depth that the lists are
    read to, the entries above it (and, for negative weights, as many from the end)
    are kept as matrices, so that many queries read on at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        n, dims = self.vectors.shape
        #: Row d: component d of each vector, in the vectors' order and falling, and
        #: the place of each vector in the falling order.
        self.component = np.ascontiguousarray(self.vectors.T).astype(np.float64)
        order = np.argsort(-self.component, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.component, order, axis=1)
        self.place = np.empty((dims, n), np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype=np.int32), (dims, n)), axis=1)
        self.ends = [-(-n * c // CHUNKS) for c in range(FIRST_CHUNKS, CHUNKS + 1)]
        self._read: dict[int, tuple[np.ndarray, ...]] = {}
        self.read_share: list[float] = []

    def read(self, b: int) -> tuple[np.ndarray, ...]:
        """What the first b entries of each list add to the worst case, and take from
        the best one; then the values that lists have come to from either end."""
        if b not in self._read:
            n = len(self.ids)
            top, bottom = self.sorted[:, b - 1], self.sorted[:, n - b]
            ends = ((self.place < b, self.sorted[:, -1], top), (self.place >= n - b, self.sorted[:, 0], bottom))
            gain = np.concatenate([np.where(seen, self.component - worst[:, None], 0.0) for seen, worst, _ in ends])
            loss = np.concatenate([np.where(seen, self.component - come_to[:, None], 0.0) for seen, _, come_to in ends])
            self._read[b] = gain, loss, np.concatenate([top, bottom])
        return self._read[b]

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best vectors whose id isn't its
        own among those that score ``least`` or more."""
        n = len(self.ids)
        queries = np.pad(queries, ((0, 0), (0, self.vectors.shape[1] - queries.shape[1])))
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        # Positive weights read lists from the top, negative ones from the bottom.
        weight = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(np.float64)
        ends = np.concatenate([self.sorted[:, -1], self.sorted[:, 0]])
        base = weight @ ends
        slack = 1e-9 * (np.abs(weight) @ np.abs(ends) + np.abs(base) + 1)
        alive: list[np.ndarray] = [np.concatenate([np.arange(a), np.arange(z, n)]) for a, z in zip(first, last, strict=True)]
        live = np.array([i for i in range(len(queries)) if len(alive[i]) > k], np.int64)
        for b in self.ends if len(live) else ():
            gain, loss, come_to = self.read(b)
            w = weight[live]
            lower, outside = base[live, None] + w @ gain, w @ come_to
            upper = outside[:, None] + w @ loss
            for j, i in enumerate(live):
                lower[j, first[i] : last[i]] = -np.inf
                upper[j, first[i] : last[i]] = -np.inf
            bar = np.maximum(least[live], np.partition(lower, -k, axis=1)[:, -k]) - slack[live]
            may = upper >= bar[:, None]
            # Reading ends when no unseen vector, and few of the seen ones, may win.
            done = ((outside < bar) & (may.sum(axis=1) <= FEW * k)) | (b == n)
            for j in np.flatnonzero(done):
                alive[live[j]] = np.flatnonzero(may[j])
                self.read_share.append(b / n)
            live = live[~done]
            if not len(live):
                break
        out = []
        for q, some, bar in zip(queries, alive, least, strict=True):
            scores = self.vectors[some] @ q
            some, scores = some[scores >= bar], scores[scores >= bar]
            best = np.lexsort((self.ids[some], -scores))[:k]
            out.append((self.ids[some][best], scores[best]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _joined(parts: list[np.ndarray], width: int) -> np.ndarray:
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def whole_numbers(embedding, scale: int = SCALE):
    """floor(scale * x) of each component; null unless all are finite."""
    x = F.transform(embedding, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return F.when(fine, x)


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``vectors`` (vb, qb, vec_id, v) and ``queries`` (also row and least): the best
    of each block for each query.  A block comes first, then what is asked of it."""
    columns = ["vb", "qb", "asks", "row", "vec_id", "v", "least"]
    both = vectors.select("vb", "qb", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("row"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
    both = both.unionByName(queries.select("vb", "qb", F.lit(True).alias("asks"), "row", "vec_id", "v", "least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, lists = None, [], [], None
        for b in batches:
            vb, qb, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = [0, *(np.flatnonzero((np.diff(vb) != 0) | (np.diff(qb) != 0) | (asks[1:] != asks[:-1])) + 1), len(vb)]
            for i, j in zip(edges, edges[1:], strict=False):
                some, m = b.slice(i, j - i), _matrix(b.column(5).slice(i, j - i))
                if (vb[i], qb[i]) != at:
                    at, ids, parts, lists = (vb[i], qb[i]), [], [], None
                if not asks[i]:
                    ids.append(some.column(4).to_numpy())
                    parts.append(m)
                    continue
                if not parts:
                    continue
                width = max(m.shape[1], *(p.shape[1] for p in parts))
                if lists is None or lists.vectors.shape[1] < width:
                    lists = SortedLists(np.concatenate(ids), _joined(parts, width))
                rows, own = some.column(3).to_numpy(), some.column(4).to_numpy()
                least = np.array([-np.inf if x is None else x for x in some.column(6).to_pylist()], np.float64)
                out: list[list] = [[], [], [], []]
                for c in range(0, len(m), AT_ONCE):
                    part = slice(c, c + AT_ONCE)
                    for row, name, (got, scores) in zip(rows[part], own[part], lists.top(own[part], m[part], k, least[part]), strict=True):
                        for column, values in zip(out, ([row] * len(got), [name] * len(got), got, scores), strict=True):
                            column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "query_id", "vec_id", "score"])

    together = both.select(*columns).repartition("vb", "qb").sortWithinPartitions("vb", "qb", "asks")
    return together.mapInArrow(common.task(run), "row long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query, k: int = K, scale: int = SCALE, queries: int = QUERIES, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for each row of ``df``
    (vec_id, embedding) that ``is_query`` holds for."""
    common.ship(df.sparkSession)
    whole = df.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    rows = common.written(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, -(-rows.count() // vector_block))
    placed = rows.withColumn("vb", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    asked = placed.where(is_query)
    none = F.lit(None).cast("long")
    # Each query in its own block, then with the bar from there in all others.
    first = common.written(_search(placed.withColumn("qb", F.lit(0)), asked.withColumn("qb", F.lit(0)).withColumn("least", none), k), "own")
    found = first
    if blocks > 1:
        groups = max(1, -(-asked.count() // queries))
        bars = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        away = asked.join(bars, "row", "left").withColumnRenamed("vb", "home").withColumn("qb", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(groups)).cast("int"))
        away = away.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("vb <> home")
        copies = placed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else placed.withColumn("qb", F.lit(0))
        found = found.unionByName(_search(copies, away, k))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES = {
    "op8_topk": f"""
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= {K}"""
}
QUERIES = {"op8_topk": op8_topk}
