"""Connected components of an edge list."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.session import checkpoint_dir, delete, persist_cut

#: Edges that are united together.
AT_ONCE = 1_000_000


def numbered(nodes: DataFrame) -> DataFrame:
    """``node`` once for every value of the only column of ``nodes``, and ``k``, its place
    from 0 on in their order."""
    ordered = persist_cut(nodes.toDF("node").distinct().orderBy("node").select("node", F.spark_partition_id().alias("part")))
    counts = dict(ordered.groupBy("part").count().collect())
    starts, at = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(F.lit(at))
        at += counts.get(part, 0)
    # Rows of a part that has been cut come in their order, each time.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.select("node", (within + F.array(*starts or [F.lit(0)])[F.col("part")]).cast("int").alias("k"))


class Labels:
    """The least node that each of ``n`` numbered nodes is known to reach, by edges that go past."""

    def __init__(self, n: int, rounds: int):
        self.label, self.seen, self.rounds = np.arange(n, dtype=np.int32), np.zeros(n, bool), rounds

    def _root(self, x: np.ndarray) -> np.ndarray:
        at, out = np.unique(x, return_inverse=True)
        top = self.label[at]
        while (up := self.label[top]).tobytes() != top.tobytes():
            top = up
        self.label[at] = top
        return top[out]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.seen[i], self.seen[j] = True, True
        for _ in range(self.rounds):
            i, j = self._root(i), self._root(j)
            apart = i != j
            if not apart.any():
                return
            i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
            # Roots are hooked to lesser ones only, so nothing goes in circles.
            np.minimum.at(self.label, j, i)
        raise RuntimeError("components did not settle")

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.flatnonzero(self.seen).astype(np.int32)
        return k, self._root(k)


def labels(pairs: DataFrame, n: int, rounds: int = 60) -> DataFrame:
    """``k`` and ``root`` for each of ``n`` numbered nodes that a pair (its two columns) has.
    One task reads the pairs and holds a number for each node, no pairs; ways of any
    length take no more rounds than halvings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Labels(n, rounds), [], 0
        for b in batches:
            held.append(tuple(c.to_numpy() for c in b.columns))
            size += len(b)
            if size >= AT_ONCE:
                known.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            known.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
        k, root = known.roots()
        for s in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in (k, root)], names=["k", "root"])

    return pairs.toDF("i", "j").coalesce(1).mapInArrow(run, "k int, root int")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for every node of an edge (``a``, ``b``): the least
    node that it reaches.

    Steps are tables, not checkpoints: a checkpoint keeps its plan's estimated size, which
    joins multiply."""
    spark = edges.sparkSession
    path = f"{checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    try:
        own = kept(edges.select("a", "b").where("a <> b"), "edges")
        node = kept(numbered(own.select("a").unionByName(own.select(F.col("b").alias("a")))), "nodes")
        a, b = (node.select(F.col("node").alias(x), F.col("k").alias(y)) for x, y in (("a", "i"), ("b", "j")))
        pairs = kept(own.join(a, "a").join(b, "b").select("i", "j"), "pairs")
        root = kept(labels(pairs, node.count(), rounds), "labels")
        named = root.join(node, "k").select("node", F.col("root").alias("k")).join(node.select(F.col("node").alias("root"), "k"), "k")
        return persist_cut(kept(named.select("node", "root"), "named"))
    finally:
        delete(spark, path)
