"""Quality rules: how far a document's histograms are from those of its language.

Two histograms, one of character classes and one of the language's most common words
(with one bin for all others), are held against references of the language by
Jensen-Shannon distance (square root of the divergence to base 2: 0 equal, 1 disjoint).
A document fails a rule whose distance is above ``floor + spread / sqrt(words)``: short
texts are far from any reference by chance alone.  Below a least length a rule says nothing.

References are counted over all documents.  Groups of copies must not make the language:
documents are dealt to ``BUCKETS`` buckets by their least shingle of five words, which
copies and most near copies share, and a reference holds the median of the buckets'
shares, so a group moves its own bucket only.  The language's ``COMMON`` words are those
of greatest median.

Rules of lengths and repeats (``base_failed``) come before.

Defined results: null and empty texts have counts of zero, distances of null, and fail by
their length; a language that is null, or has fewer than ``LEAST_TEXTS`` texts, words in
fewer than five of nine buckets or no reference otherwise, is not judged by distance;
equal texts of one language have equal results; repeated rows get a row each; null ids
stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles

COMMON, BUCKETS = 100, 9
#: Texts that a language has at least to have a reference.
LEAST_TEXTS = 40
#: Languages whose references are sent to the tasks: a text of labels can't pass for one.
MOST_LANGUAGES = 5000
#: Greatest distances of long texts, what shorter ones have besides, and words below which a rule says nothing.
CLASS_FLOOR, CLASS_SPREAD, CLASS_WORDS = 0.15, 1.5, 20
WORD_FLOOR, WORD_SPREAD, WORD_WORDS = 0.25, 2.2, 50
#: The base rules.
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_PLAIN_MARKS = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "line", "plain mark", "other mark", "beyond ASCII", "control")


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0xC0:
        return 7
    if b >= 0x80:  # the rest of a character that began before
        return 9
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in " \t":
        return 3
    if b in _SPACE:
        return 4
    if b in _PLAIN_MARKS:
        return 5
    return 6 if 33 <= b < 127 else 8


_CLASS = np.eye(10, dtype=np.int64)[[_class_of(b) for b in range(256)]][:, :9]


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row of two arrays of counts or shares."""
    p, q = (x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300) for x in (p.astype(float), q.astype(float)))
    m = (p + q) / 2

    def against(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.clip((against(p) + against(q)) / 2, 0, 1))


def _encoded(words: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Every word's number, the different words, and the number of words of each text."""
    flat = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist(), np.fromiter(map(len, words), np.int64, len(words))


def repeated_words(codes: np.ndarray, sizes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Of each text the words in windows of ``width`` (a power of two) that it holds
    twice or more.  Windows are numbered by doubling, so equal numbers are equal words."""
    out = np.zeros(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    ids, step = codes, 1
    while step < width:
        if len(ids) <= step:
            return out
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1].astype(np.int64)
        step *= 2
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(ids)]
    inside = np.arange(len(ids)) + width <= ends[owner]
    _, inverse, count = np.unique(ids[inside] * len(sizes) + owner[inside], return_inverse=True, return_counts=True)
    start = np.flatnonzero(inside)[count[inverse] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + width, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[covered], minlength=len(sizes))


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _raw(texts: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]


def _counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``bucket``, ``word`` and ``n`` from each batch; rows without a word
    hold the texts and words of a bucket, and the characters of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _raw(b.column(1))
            words = [shingles.lower_words(t) for t in b.column(1).to_pylist()]
            hashed, each = shingles.shingle_hashes(b.column(1).to_pylist(), 5, shingles.lower_words)
            some = each > 0
            least = np.zeros(len(raw), np.uint64)
            if some.any():
                least[some] = np.minimum.reduceat(hashed, (np.cumsum(each) - each)[some])
            bucket = (shingles.mix(least) % np.uint64(BUCKETS)).astype(np.int64)
            langs = b.column(0).dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * BUCKETS + bucket
            codes, values, sizes = _encoded(words)
            key, n = np.unique(np.repeat(group, sizes) * max(len(values), 1) + codes, return_counts=True)
            at, word = np.divmod(key, max(len(values), 1))
            known = pa.array(values, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(at // BUCKETS)), pa.array(at % BUCKETS, pa.int32()), known.take(pa.array(word)).cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.list_(pa.int64()))],
                ["lang", "bucket", "word", "n", "texts", "classes"],
            )
            kinds = np.zeros((len(langs.dictionary) * BUCKETS, len(CLASSES)), np.int64)
            for g, r in zip(group, raw, strict=True):
                kinds[g] += class_counts(r)
            whole = np.unique(group)
            total, texts = np.bincount(group, sizes, len(kinds))[whole], np.bincount(group, minlength=len(kinds))[whole]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(whole // BUCKETS)), pa.array(whole % BUCKETS, pa.int32()), pa.nulls(len(whole), pa.string()), pa.array(total.astype(np.int64)), pa.array(texts), pa.array(kinds[whole].tolist(), pa.list_(pa.int64()))],
                ["lang", "bucket", "word", "n", "texts", "classes"],
            )

    return docs.where("lang is not null").select("lang", "text").mapInArrow(common.task(run), "lang string, bucket int, word string, n long, texts long, classes array<long>")


def _median(shares):
    """Of a list, the middle one; of two the lesser."""
    return F.element_at(F.array_sort(shares), F.floor((F.size(shares) + 1) / 2).cast("int"))


def references(docs: DataFrame) -> DataFrame:
    """``lang``, ``words`` and ``word_shares`` (one more, for all others) and
    ``class_shares`` of each language with enough texts, from ``docs`` (lang, text)."""
    n = [F.sum(F.when(F.col("bucket") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(BUCKETS)]
    kinds = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    # Totals are rows without a word; one shuffle serves both.
    counted = common.written(_counts(docs).groupBy("lang", "word").agg(*n, F.sum("texts").alias("texts"), *kinds), "rule_counts")
    words = [f"n{i}" for i in range(BUCKETS)]
    filled = reduce(lambda a, c: a + F.when(F.col(c) > 0, 1).otherwise(0), words, F.lit(0))
    totals = counted.where("word is null").where((F.col("texts") >= LEAST_TEXTS) & (filled * 2 > BUCKETS))
    every = reduce(lambda a, i: a + F.col(f"c{i}"), range(len(CLASSES)), F.lit(0))
    told = totals.select("lang", F.array(*(F.col(c).alias(c) for c in words)).alias("totals"), F.array(*(F.col(f"c{i}") / every for i in range(len(CLASSES)))).alias("class_shares"))
    # A reference is one row a language.
    each = counted.where("word is not null").join(F.broadcast(told) if told.count() <= MOST_LANGUAGES else told, "lang")
    share = F.filter(F.transform(F.arrays_zip(F.array(*words).alias("own"), F.col("totals")), lambda x: F.when(x["totals"] > 0, x["own"] / x["totals"])), lambda x: x.isNotNull())
    shares = each.withColumn("share", _median(share)).where("share > 0")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "word"))
    top = shares.withColumn("rank", rank).where(F.col("rank") <= COMMON)
    listed = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "share"))).alias("t"))
    rest = F.greatest(1 - F.aggregate("t", F.lit(0.0), lambda s, x: s + x["share"]), F.lit(0.0))
    made = listed.select("lang", F.transform("t", lambda x: x["word"]).alias("words"), F.concat(F.transform("t", lambda x: x["share"]), F.array(rest)).alias("word_shares"))
    out = common.written(made.join(told.select("lang", "class_shares"), "lang"), "rule_references")
    common.discard(counted)
    return out


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"


def distances(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Counts, and distances where they are judged, of each row of ``docs`` (doc_id,
    lang, text)."""
    spark = docs.sparkSession
    rows = known.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; lang doesn't hold languages")
    sent = spark.sparkContext.broadcast({r["lang"]: ({w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(r["words"])}, np.array(r["word_shares"]), np.array(r["class_shares"])) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = sent.value
        for b in batches:
            texts, langs = b.column(2).to_pylist(), b.column(1).to_pylist()
            raw = _raw(b.column(2))
            codes, values, sizes = _encoded([r.split() for r in raw])
            length = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            spaces = size - np.fromiter((len(r.translate(None, _SPACE)) for r in raw), np.int64, len(raw))
            symbols = size - np.fromiter((len(r.translate(None, _SYMBOLS)) for r in raw), np.int64, len(raw))
            lines = np.fromiter(map(duplicate_lines, raw), np.int64, len(raw))
            lowered = [w.translate(shingles._TO_LOWER) for w in values]
            far_class, far_word = np.full(len(raw), np.nan), np.full(len(raw), np.nan)
            ends = np.cumsum(sizes)
            for lang in {x for x in langs if x in refs}:
                index, word_shares, class_shares = refs[lang]
                where = np.array([x == lang for x in langs])
                of_class = np.flatnonzero(where & (sizes >= CLASS_WORDS))
                if len(of_class):
                    far_class[of_class] = js_distance(np.array([class_counts(raw[i]) for i in of_class]), class_shares)
                of_word = np.flatnonzero(where & (sizes >= WORD_WORDS))
                if len(of_word):
                    bins = len(word_shares)
                    bin_of = np.fromiter((index.get(w, bins - 1) for w in lowered), np.int64, len(lowered))
                    counts = np.array([np.bincount(bin_of[codes[ends[i] - sizes[i] : ends[i]]], minlength=bins) for i in of_word])
                    far_word[of_word] = js_distance(counts, word_shares)
            columns = [sizes, length - spaces, symbols, lines, repeated_words(codes, sizes)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c.astype(np.int64)) for c in columns), *(pa.array(f, pa.float64(), mask=np.isnan(f)) for f in (far_class, far_word))], _NAMES)

    return docs.select("doc_id", "lang", "text").mapInArrow(common.task(run), _RESULT)


_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def judged(docs: DataFrame) -> DataFrame:
    """Counts, distances, ``base_failed`` and ``kept`` of each row of ``docs`` (doc_id,
    lang, text)."""
    common.ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    told = distances(own, references(own))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))

    def far(distance: str, floor: float, spread: float):
        return F.coalesce(F.col(distance) > floor + spread / F.sqrt(F.greatest("n_words", F.lit(1))), F.lit(False))

    fails = far("class_distance", CLASS_FLOOR, CLASS_SPREAD) | far("word_distance", WORD_FLOOR, WORD_SPREAD)
    return told.withColumn("base_failed", base).withColumn("kept", ~base & ~fails)


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {}
QUERIES = {"op12_rules": op12_rules}
