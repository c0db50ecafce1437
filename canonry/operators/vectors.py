"""Nearest vectors by cosine, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of either side.
BLOCK = 4096


def nearest(queries: DataFrame, candidates: DataFrame, k: int, within: str, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``vec_id``, ``similarity`` (six places) and ``rank`` of each query's
    k most similar candidates of equal ``within``; ties to the smaller id.  Both have
    vec_id, embedding and that column.  Vectors that are null or hold a null, NaN or infinite
    component take no part; one of zeros is like nothing (0).  A pair of blocks is one matrix product, of
    which k rows a query are kept; the work is queries times candidates."""

    def dealt(df: DataFrame, own: str, other: str, mine: int, others: int) -> DataFrame:
        placed = df.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id", "embedding", within, F.pmod(F.xxhash64("vec_id"), F.lit(mine)).cast("int").alias(own))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    n, m = (max(1, -(-df.count() // block)) for df in (queries, candidates))

    def units(rows: pd.DataFrame) -> np.ndarray:
        v = np.array(rows["embedding"].tolist(), np.float64)
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), np.finfo(float).tiny)

    def best(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(given):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        ids = given["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        scores, n = units(asked) @ units(given)[order].T, min(k, len(ids))
        # Whatever rounds to one of the k best is no further below the k-th than that.
        i, j = np.nonzero(scores >= np.partition(scores, len(ids) - n, axis=1)[:, [len(ids) - n]] - 2e-6)
        like = np.round(scores[i, j], 6)
        by = np.lexsort((j, -like, i))
        i, j, like = i[by], j[by], like[by]
        top = np.arange(len(i)) - np.searchsorted(i, i) < n
        return pd.DataFrame({"query_id": asked["vec_id"].to_numpy(np.int64)[i[top]], "vec_id": ids[j[top]], "similarity": like[top]})

    keys = [within, "q", "c"]
    pairs = dealt(queries, "q", "c", n, m).groupBy(*keys).cogroup(dealt(candidates, "c", "q", m, n).groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
