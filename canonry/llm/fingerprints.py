"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once.  The high bits of the hash choose a
bin and each bin keeps its least hash.  Bins that stay empty are filled by
optimal densification: every bin has its own fixed random order of all bins and
borrows from the first one in that order that is not empty, so two fingerprints
borrow alike.  Of each bin only the low-order bits are stored, packed; the
likeness of two fingerprints is the share of equal bins, corrected for the bins
that are equal by chance.

Defined results: a null text counts as empty; a text without words has the
fingerprint "" and likeness 1 to another such text, 0 to all others; a text of
fewer than five words has one shingle, its whole word sequence; equal texts have
equal fingerprints; repeated rows get a row each; rows of one id, and rows without
any (which come last), follow each other in the order of their texts' hashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, shingles

WIDTH = 5
BINS = 512
BITS = 4
#: Texts whose shingles are held at once.
BATCH = 64
#: Rows of one stretch of neighbouring documents, about; sampled rows for each cut
#: between two; and the most cuts, which are broadcast (16 bytes each).  A stretch is
#: streamed, so that longer ones, from 67 million documents on, need no more memory.
STRETCH_ROWS = 1024
ROWS_A_CUT = 20
MOST_CUTS = 1 << 16

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sketcher:
    """Fingerprints of lists of texts."""

    def __init__(self, width: int = WIDTH, bins: int = BINS, bits: int = BITS, seed: int = 7):
        if bins & (bins - 1) or 8 % bits:
            raise ValueError("bins must be a power of two and bits divide 8")
        self.width, self.bins, self.bits = width, bins, bits
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        rng = np.random.default_rng(seed)
        #: Row i: the order in which bin i looks for a bin that is not empty.
        self.order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
        self.place = np.argsort(self.order, axis=1).astype(np.int32)
        self.bin = rng.integers(0, 1 << 63, bins, dtype=np.uint64)

    def least(self, texts: list[str | None]) -> np.ndarray:
        """Least hash of each bin, or the largest number where a bin is empty."""
        h, count = shingles.shingle_hashes(texts, self.width)
        flat = np.full(len(texts) * self.bins, _EMPTY, np.uint64)
        at = np.repeat(np.arange(len(texts), dtype=np.int64) * self.bins, count) + (h >> self.shift).astype(np.int64)
        np.minimum.at(flat, at, h)
        return flat.reshape(len(texts), self.bins)

    def densify(self, least: np.ndarray) -> np.ndarray:
        """Fill the empty bins of each row that has any other."""
        for row in least:
            empty = np.flatnonzero(row == _EMPTY)
            if not len(empty) or len(empty) == self.bins:
                continue
            full = np.flatnonzero(row != _EMPTY)
            if len(full) <= 32:
                row[empty] = row[full[self.place[np.ix_(empty, full)].argmin(axis=1)]]
                continue
            source = row.copy()
            for k in range(self.bins):
                got = source[self.order[empty, k]]
                found = got != _EMPTY
                row[empty[found]] = got[found]
                empty = empty[~found]
                if not len(empty):
                    break
        return least

    def pack(self, dense: np.ndarray) -> np.ndarray:
        """Low-order bits, packed into bytes.  Each bin mixes in a number of its own,
        so that two hashes that fill many bins are equal by chance in each anew."""
        low = (shingles.mix(dense ^ self.bin) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        out = np.zeros((len(low), self.bins // per), np.uint8)
        for k in range(per):
            out |= low[:, k::per] << np.uint8(k * self.bits)
        return out

    def fingerprints(self, texts: list[str | None]) -> list[bytes]:
        least = self.least(texts)
        none = (least == _EMPTY).all(axis=1)
        packed = self.pack(self.densify(least))
        return [b"" if e else p.tobytes() for e, p in zip(none, packed, strict=True)]

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity: chance equality is taken out."""
        if not a or not b:
            return float(a == b)
        differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        mask, equal = np.uint8((1 << self.bits) - 1), 0
        for k in range(8 // self.bits):
            equal += int(np.count_nonzero((differ >> np.uint8(k * self.bits)) & mask == 0))
        chance = 1 / (1 << self.bits)
        return min(1.0, max(0.0, (equal / self.bins - chance) / (1 - chance)))


_sketchers: dict[tuple, Sketcher] = {}


def sketcher(*args) -> Sketcher:
    if args not in _sketchers:
        _sketchers[args] = Sketcher(*args)
    return _sketchers[args]


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``key`` and the packed ``fingerprint`` (binary) of every row."""
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sketcher(width, bins, bits)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.fingerprints(part.column(1).to_pylist()), pa.binary())], ["key", "fingerprint"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("fingerprint", T.BinaryType())])
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(common.task(run), schema).withColumnRenamed("key", key)


def _order() -> tuple:
    """Descending doc_id, nulls last, ties by a hash of the text, then by the text."""
    return F.desc_nulls_last("doc_id"), F.asc("h"), F.asc("text")


def _cuts(keys: DataFrame, want: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About ``want`` keys (ids rising, their hashes; hashes of rows without an id)
    that cut the order of ``doc_id`` and ``h`` into even stretches, so that rows of
    one id and rows without any are cut too.  They come from a bounded sample."""
    if want < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = min(1.0, ROWS_A_CUT * want / n)
    sample = keys.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(5)), F.lit(1 << 40)) < int(share * (1 << 40))).distinct()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("doc_id"), "h"))  # ROWS_A_CUT * MOST_CUTS rows at most
    rows = sample.withColumn("place", place).where(F.col("place") % ROWS_A_CUT == 0).select("doc_id", "h").collect()
    some = sorted((r["doc_id"], r["h"]) for r in rows if r["doc_id"] is not None)
    none = sorted(r["h"] for r in rows if r["doc_id"] is None)
    return np.array([i for i, _ in some], np.int64), np.array([h for _, h in some], np.int64), np.array(none, np.int64)


def stretch_of(ids: np.ndarray, is_null: np.ndarray, h: np.ndarray, cuts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of the stretch of each row, in order: each cut begins one."""
    cut_ids, cut_h, cut_null = cuts
    first, last = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    # Cuts with greater ids come before, of those with this id the ones up to the hash.
    out = len(cut_ids) - last
    for i in np.unique(ids[(last > first) & ~is_null]):
        a, z = np.searchsorted(cut_ids, [i, i + 1]) if i < np.iinfo(np.int64).max else (np.searchsorted(cut_ids, i), len(cut_ids))
        own = (ids == i) & ~is_null
        out[own] += np.searchsorted(cut_h[a:z], h[own], "right")
    out[is_null] = len(cut_ids) + np.searchsorted(cut_null, h[is_null], "right")
    return out.astype(np.int32)


def stretches(df: DataFrame) -> DataFrame:
    """``stretch``, ``guest``, ``doc_id`` and ``text``: the rows in stretches of
    descending doc_id (nulls last, ties by a hash of the text).  Each stretch also
    holds, as a guest, the first row of the next one; the last stretch that of the
    first.  The cuts are placed by ids and hashes alone and one shuffle brings the
    texts together."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    keys = docs.select("doc_id", "h")
    n = df.count()
    cuts = _cuts(keys, min(MOST_CUTS, n // STRETCH_ROWS), n)

    @F.pandas_udf("int")
    def numbered(ids: pd.Series, is_null: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(stretch_of(ids.to_numpy(np.int64), is_null.to_numpy(bool), h.to_numpy(np.int64), cuts))

    # Without nulls, which pandas knows only as floats.
    stretch = numbered(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), F.col("h"))

    # One row for each cut at most: a number and a key.
    own = keys.withColumn("stretch", stretch)
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), (-1 - F.col("doc_id")).alias("id"), "h")).alias("k")
    heads = own.groupBy("stretch").agg(least).orderBy("stretch").collect()
    before = [(None if r["k"]["none"] else -1 - r["k"]["id"], r["k"]["h"], heads[i - 1]["stretch"]) for i, r in enumerate(heads)]
    named = spark.createDataFrame(before, "head long, head_h long, before int")
    guests = docs.join(F.broadcast(named), docs["doc_id"].eqNullSafe(named["head"]) & (docs["h"] == named["head_h"])).groupBy("before", "doc_id", "h").agg(F.min("text").alias("text"))
    placed = docs.select(stretch.alias("stretch"), F.lit(False).alias("guest"), "doc_id", "h", "text")
    both = placed.unionByName(guests.select(F.col("before").alias("stretch"), F.lit(True).alias("guest"), "doc_id", "h", "text"))
    return both.repartition("stretch").sortWithinPartitions("stretch", "guest", *_order()).select("stretch", "guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


COMPARED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def compare_with_edits(df: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likenesses."""
    common.ship(df.sparkSession)

    def compared(rows: list[tuple[int, bool, int | None, str]]) -> pa.RecordBatch:
        own = sketcher(width, bins, bits)
        prints = own.fingerprints([r[3] for r in rows])
        pairs = [(i, edited(r[3], rows[i + 1][3])) for i, r in enumerate(rows[:-1]) if not r[1] and rows[i + 1][0] == r[0]]
        changed = own.fingerprints([t for _, t in pairs])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i, _ in pairs], pa.int64()),
                pa.array([len(rows[i][3]) for i, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in pairs], pa.string()),
                pa.array([base64.b64encode(prints[i]).decode() for i, _ in pairs], pa.string()),
                pa.array([base64.b64encode(c).decode() for c in changed], pa.string()),
                pa.array([own.likeness(prints[i], c) for (i, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([own.likeness(prints[i], prints[i + 1]) for i, _ in pairs], pa.float64()),
            ],
            COMPARED.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bool, int | None, str]] = []
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                rows += zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)
                if len(rows) > 1:
                    yield compared(rows)
                    del rows[:-1]

    return stretches(df).mapInArrow(common.task(run), COMPARED)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLES: dict[str, str] = {}
