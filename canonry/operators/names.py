"""How names are compared: token sets, vectors of the feeds, n-grams with weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.config import DEFAULT, MatchConfig
from canonry.functions import scores, text

#: Letters of a gram, and bins that grams are hashed to: a table of weights has no more rows.
GRAM, BINS = 3, 1 << 16


def _overlap(u: tuple, v: tuple, shape: tuple[int, int], weights: bool = False) -> np.ndarray:
    """Sums over common codes of two lists of (row, code, weight), row by row."""
    order = np.argsort(v[1], kind="stable")
    codes = v[1][order]
    low, high = np.searchsorted(codes, u[1], "left"), np.searchsorted(codes, u[1], "right")
    n = high - low
    at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]
    cell = np.repeat(u[0], n) * shape[1] + v[0][at]
    values = np.repeat(u[2], n) * v[2][at] if weights else None
    return np.bincount(cell, values, shape[0] * shape[1]).reshape(shape)


def _listed(forms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of every item of an array of lists, and the items."""
    forms = forms.combine_chunks() if isinstance(forms, pa.ChunkedArray) else forms
    size = pc.fill_null(pc.list_value_length(forms), 0).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(forms)), size), forms.flatten()


def _bytes(forms: pa.Array) -> pa.Array:
    """The bytes of each list of numbers; of none, an empty list and one with nulls its own."""
    lists, lengths = forms.flatten(), pc.fill_null(pc.list_value_length(forms), 0).to_numpy().astype(np.int64)
    if lists.null_count:
        return pa.array([repr(x).encode() for x in forms.to_pylist()], pa.binary())
    values, ends = np.ascontiguousarray(lists.to_numpy(zero_copy_only=False)), np.cumsum(lengths)
    return pa.array([values[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())


class DiceKernel:
    """Token sets."""

    def keys(self, forms: pa.Array) -> pa.Array:
        """Equal for equal forms only."""
        return pc.fill_null(pc.binary_join(forms.cast(pa.list_(pa.string())), "\0"), "")

    def sizes(self, forms: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(forms), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def bound(self, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
        """The best score with any set of ``low`` to ``high`` tokens."""
        near = np.clip(sizes, low, high)
        return 2.0 * np.minimum(sizes, near) / np.maximum(sizes + near, 1)

    def matrix(self, u: pa.Array, v: pa.Array) -> np.ndarray:
        (ru, tu), (rv, tv) = _listed(u), _listed(v)
        known = tu.dictionary_encode()
        codes = pc.fill_null(pc.index_in(tv, value_set=known.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        both = _overlap((ru, known.indices.to_numpy().astype(np.int64), None), (rv[codes >= 0], codes[codes >= 0], None), (len(u), len(v)))
        total = self.sizes(u)[:, None] + self.sizes(v)[None, :]
        return np.where(total > 0, 2.0 * both / np.maximum(total, 1), 0.0)


@dataclass(frozen=True)
class VectorKernel:
    """Dense vectors by cosine, stretched; null and zero vectors score nothing."""

    floor: float
    span: float

    def keys(self, forms: pa.Array) -> pa.Array:
        return _bytes(forms)

    def sizes(self, forms: pa.Array) -> np.ndarray:
        return np.zeros(len(forms), np.int64)

    def bound(self, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
        return np.full(len(sizes), np.inf)

    def matrix(self, u: pa.Array, v: pa.Array) -> np.ndarray:
        rows = [x.to_pylist() for x in (u, v)]
        width = max((len(x) for side in rows for x in side if x), default=1)
        a, b = (np.array([x if x and None not in x and len(x) == width else [0.0] * width for x in side], np.float64) for side in rows)
        a, b = (x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, 1) for x in (a, b))
        like = a @ b.T
        known = (np.abs(a).sum(1) > 0)[:, None] & (np.abs(b).sum(1) > 0)[None, :]
        return np.where(known, np.maximum(0.0, (like - self.floor) / self.span), 0.0)


class SparseKernel:
    """Sparse vectors of length one (struct of ``g`` and ``w``), by cosine."""

    def keys(self, forms: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(_bytes(pc.struct_field(forms, "g")), _bytes(pc.struct_field(forms, "w")), b"")

    def sizes(self, forms: pa.Array) -> np.ndarray:
        return np.zeros(len(forms), np.int64)

    def bound(self, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
        return np.full(len(sizes), np.inf)

    def matrix(self, u: pa.Array, v: pa.Array) -> np.ndarray:
        def parts(x):
            x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            row, g = _listed(pc.struct_field(x, "g"))
            return row, g.to_numpy().astype(np.int64), _listed(pc.struct_field(x, "w"))[1].to_numpy()

        return np.minimum(_overlap(parts(u), parts(v), (len(u), len(v)), weights=True), 1.0)


@dataclass(frozen=True)
class NameScorer:
    """How names are compared: ``attach`` adds to records the column ``form`` that a name
    becomes, ``score`` compares two forms in a plan, ``kernel`` many with many in a task."""

    attach: Callable[[DataFrame], DataFrame]
    score: Callable[[Column, Column], Column]
    kernel: DiceKernel | VectorKernel | SparseKernel


#: Token sets of cleaned names, by Dice similarity.
DICE = NameScorer(lambda df: df.withColumn("form", F.array_sort(text.name_tokens(text.property_name(F.col("name"))))), scores.dice, DiceKernel())
#: The same of room names.
ROOM_DICE = NameScorer(lambda df: df.withColumn("form", text.name_tokens(text.room_name(F.col("name")))), scores.dice, DiceKernel())


def cosine_scorer(vector: str, cfg: MatchConfig = DEFAULT) -> NameScorer:
    """Vectors that the feeds bring in a column, by cosine, stretched; records
    without one score nothing."""
    return NameScorer(lambda df: df.withColumn("form", F.col(vector)), lambda a, b: F.coalesce(scores.stretch(scores.cosine(a, b), cfg), F.lit(0.0)), VectorKernel(cfg.similarity_floor, cfg.similarity_span))


def gram_bins(name: Column, n: int = GRAM, bins: int = BINS) -> Column:
    """The bin of each gram of a cleaned name, one mark before and after it; names
    shorter than a gram are one gram."""

    def binned(marked: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.conv(F.substring(F.md5(F.substr(marked, i, F.lit(n))), 1, 8), 16, 10).cast("long"), F.lit(bins)))

    return text.once(F.concat(F.lit("^"), name, F.lit("$")), binned)


@lru_cache(BINS)
def _bin(gram: str, bins: int) -> int:
    """As ``gram_bins`` has it."""
    return int(md5(gram.encode()).hexdigest()[:8], 16) % bins


def fit_weights(records: DataFrame, normal: Callable[[Column], Column] = text.property_name, n: int = GRAM, bins: int = BINS) -> DataFrame:
    """``g`` and ``idf`` of every bin that the records' names have: ln((1 + names) /
    (1 + names with it)) + 1.  At most ``bins`` rows.  Equal names are cut into grams once."""
    names = records.groupBy("name").agg(F.count("*").alias("times"))
    whole = names.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("names"))
    grams = names.select(F.explode(F.array_distinct(gram_bins(normal(F.col("name")), n, bins))).alias("g"), "times")
    seen = grams.groupBy("g").agg(F.sum("times").alias("with"))
    # One row describes the whole.
    return seen.crossJoin(F.broadcast(whole)).select("g", (F.log((1 + F.col("names")) / (1 + F.col("with"))) + 1).alias("idf"))


def ngram_scorer(records: DataFrame, normal: Callable[[Column], Column] = text.property_name, n: int = GRAM, bins: int = BINS) -> NameScorer:
    """Names as sparse vectors of hashed n-grams, weighted by rarity among ``records``,
    by cosine: a letter changed costs three grams, not the whole word.  Grams that the
    records don't have weigh as much as the rarest."""
    rows = fit_weights(records, normal, n, bins).collect()  # at most ``bins``
    idf = np.full(bins, max((r["idf"] for r in rows), default=1.0))
    idf[[r["g"] for r in rows]] = [r["idf"] for r in rows]
    sent = records.sparkSession.sparkContext.broadcast(idf)

    # Grams are cut in the task: Spark doesn't run a function on nested lambdas.
    @F.pandas_udf("g array<long>, w array<double>")
    def weighed(cleaned: pd.Series) -> pd.DataFrame:
        out = []
        for x in cleaned:
            marked = f"^{x or ''}$"
            g, count = np.unique([_bin(marked[i : i + n], bins) for i in range(max(len(marked) - (n - 1), 1))], return_counts=True)
            w = count * sent.value[g]
            out.append((g, w / np.sqrt((w * w).sum())))
        return pd.DataFrame(out, columns=["g", "w"])

    def attach(df: DataFrame) -> DataFrame:
        return df.withColumn("form", weighed(normal(F.col("name"))))

    return NameScorer(attach, sparse_cosine, SparseKernel())


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of two vectors of length one."""
    own = F.arrays_zip(a["g"].alias("g"), a["w"].alias("w"))
    like = lambda other: F.aggregate(own, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(other, x["g"]), F.lit(0.0)))
    return F.least(text.once(F.map_from_arrays(b["g"], b["w"]), like), F.lit(1.0))
