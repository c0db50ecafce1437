"""Substring dedup with a compressed FM-index per shard.

A window of ``WINDOW`` words that also starts elsewhere is removed wherever it
stands.  Each window is led by an anchor: of its ``GRAM``-word grams the one of
least hash, the leftmost of equal ones.  Equal windows have equal anchors, so
only windows whose anchor's hash occurs twice can repeat, and they meet where
their anchor does.  Consecutive windows with one anchor form a context.

Equal texts are one class, read once, and equal contexts are one sequence whose
weight says how often it stands in the corpus, in one text or in many.  Contexts
are dealt to shards by anchor, so that a document is streamed against the shards
that may know it and no others.  A shard indexes its contexts and sends each
through backward search, which gives for every end how far to the left the words
still weigh two; the intervals of windows found so are all that leaves a shard.

An anchor with many contexts, as at the ends of a passage that a third of all
documents share, is divided: each of its windows has at least half of its other
words on one side of the anchor, and the anchor lengthened to that side leads it
from then on.  Anchors that are still too frequent are divided again, until the
anchor is the window; so no shard grows with a passage.

Words and anchors are compared by 64-bit hashes, contexts by their anchor's and
their own, texts by 128 bits.  Windows may have any width from ``GRAM`` words on;
a narrower one raises ValueError.  Defined results: a null or empty text has no
words; a text of fewer words than a window loses none; repeated rows are copies of
each other, so every word in any of their windows goes, whatever their ids; an
empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fmindex, shingles

WINDOW = 35
GRAM = 8
#: Words of one shard's index, and the contexts of an anchor that stay together.
SHARD_WORDS = 400_000
LEAD_CONTEXTS = 1000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, n.bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers = made[0], made[1]
    return _powers


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words: differences of a running sum of the words'
    hashes times powers of a base, moved to a common power."""
    up, down = _power_tables(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return shingles.mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` numbers the place of the least, leftmost first."""
    at, size = np.arange(len(g)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(g[right] < g[left], right, left)

    while size * 2 <= width:
        at = better(at[:-size], at[size:])
        size *= 2
    rest = width - size
    return better(at[:-rest], at[rest:]) if rest else at


def anchored(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram, and for each window the place of its anchor."""
    g = grams(h, gram)
    return g, least_places(g, window - gram + 1)


def contexts(h: np.ndarray, known: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's hash, its place, first window, last window) of each context led by
    one of the anchors ``known`` (hashes in order)."""
    g, led = anchored(h, window, gram)
    cuts = np.flatnonzero(led[1:] != led[:-1]) + 1
    begins = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(led)]])
    lead = g[led[begins]].view(np.int64)
    some = known[np.minimum(np.searchsorted(known, lead), len(known) - 1)] == lead
    return zip(lead[some].tolist(), led[begins[some]].tolist(), begins[some].tolist(), (ends[some] - 1).tolist(), strict=True)


def _hash(words: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(words.tobytes()) - (1 << 63)


def _arrow(schema: str, columns: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"l": pa.int64(), "i": pa.int32(), "b": pa.binary(), "s": pa.string(), "L": pa.list_(pa.int64()), "I": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for k, c in zip(schema, columns, strict=True)], names)


def _words_and_anchors(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Of every row: number of words, digest of all words, hashes of its anchors.
    An anchor that stands at several places of the text is named twice."""
    names = ["id", "d1", "d2", "n_words", "all_sha256", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                n, sha, hashes = [], [], []
                for text in part.column(3).to_pylist():
                    words = shingles.split_words(text)
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if len(words) < window:
                        hashes.append(None)
                        continue
                    g, led = anchored(shingles.word_hashes(words), window, gram)
                    # Places rise along the windows, as the leftmost least gram does.
                    own, times = np.unique(g[led[np.concatenate([[True], led[1:] != led[:-1]])]], return_counts=True)
                    hashes.append(np.repeat(own, np.minimum(times, 2)).view(np.int64))
                yield _arrow("llllsL", [*part.columns[:3], n, sha, hashes], names)

    return df.select("id", "d1", "d2", "text").mapInArrow(common.task(run), "id long, d1 long, d2 long, n_words long, all_sha256 string, hashes array<long>")


#: A context: what leads it, its own hash, the place and size of the leading gram.
_CONTEXT = "lead long, own long, words binary, place int, span int"


def _contexts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The distinct contexts of each text with known anchors, and where they begin."""
    names = ["d1", "d2", "copies", "at", "lead", "own", "words", "place", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                rows: tuple[list, ...] = tuple([] for _ in names)
                for d1, d2, copies, known, text in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    h = shingles.word_hashes(shingles.split_words(text))
                    met: dict[tuple[int, int], list[int]] = {}
                    for lead, place, a, z in contexts(h, np.sort(np.array(known, np.int64)), window, gram):
                        words = h[a : z + window]
                        own = lead, _hash(words)
                        if own in met:
                            met[own].append(a)
                            continue
                        met[own] = at = [a]
                        for column, value in zip(rows, (d1, d2, copies, at, *own, words.tobytes(), place - a, gram), strict=True):
                            column.append(value)
                yield _arrow("lllIllbii", list(rows), names)

    return texts.select("d1", "d2", "copies", "known", "text").mapInArrow(common.task(run), f"d1 long, d2 long, copies long, at array<int>, {_CONTEXT}")


def _distinct(rows: DataFrame, lead: str, own: str) -> DataFrame:
    """Equal contexts as one, with the sum of their weights, two at most."""
    made = rows.groupBy(F.col(lead).alias("lead"), F.col(own).alias("own")).agg(F.least(F.sum("n"), F.lit(2)).alias("n"), *(F.first(c).alias(c) for c in ("words", "place", "span")))
    return common.written(made, "contexts")


def _search(level: DataFrame, window: int) -> DataFrame:
    """Intervals of windows of each context that weigh two, first and last by turns."""

    def shard(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        index = fmindex.FMIndex([np.frombuffer(r[3], np.uint64) for r in rows], np.fromiter((r[2] for r in rows), np.int64, len(rows)), window)
        which, first, last = index.repeated_windows(window)
        own, begin = np.unique(which, return_index=True)
        runs = pa.ListArray.from_arrays(pa.array(2 * np.append(begin, len(which)), pa.int32()), pa.array(np.stack([first, last], axis=1).ravel(), pa.int32()))
        return _arrow("llI", [[rows[k][0] for k in own], [rows[k][1] for k in own], runs], ["lead", "own", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if size > SHARD_WORDS and r[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3]) // 8
        if rows:
            yield shard(rows)

    together = level.select("lead", "own", "n", "words").repartition("lead").sortWithinPartitions("lead", "own")
    return together.mapInArrow(common.task(run), "lead long, own long, runs array<int>")


def halves(place: int, span: int, windows: int, window: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, place and size of the longer gram in the context
    that begins there) of both sides of a gram that all windows hold."""
    free = window - span
    left = (free + 1) // 2
    right = free - left + 1
    # A window has at least ``left`` words before the gram, or ``right`` after it.
    cut = min(max(place - left + 1, 0), windows)
    out = []
    if cut > 0:
        out.append((0, cut - 1, place - left, span + left))
    if cut < windows:
        out.append((cut, windows - 1, place - cut, span + right))
    return out


def _divided(hot: DataFrame, window: int) -> DataFrame:
    """Contexts cut in two, each led by a longer gram; ``shift`` is the part's first
    window in the whole."""
    names = ["lead0", "own0", "n", "shift", "lead", "own", "words", "place", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, ...] = tuple([] for _ in names)
            for lead, own, n, words, place, span in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                h = np.frombuffer(words, np.uint64)
                for a, z, at, size in halves(place, span, len(h) - window + 1, window):
                    part = h[a : z + window]
                    for column, value in zip(rows, (lead, own, n, a, _hash(part[at : at + size]), _hash(part), part.tobytes(), at, size), strict=True):
                        column.append(value)
            yield _arrow("lllillbii", list(rows), names)

    return hot.select("lead", "own", "n", "words", "place", "span").mapInArrow(common.task(run), f"lead0 long, own0 long, n long, shift int, {_CONTEXT}")


def _runs(level: DataFrame, window: int, limit: int) -> DataFrame:
    """``lead``, ``own`` and ``runs`` of every context with windows that repeat.  A
    gram as long as the window has one context, so the division comes to an end."""
    many = common.written(level.groupBy("lead").count().where(F.col("count") > limit).select("lead"), "leads")
    if many.isEmpty():
        return _search(level, window)
    parts = common.written(_divided(level.join(many, "lead"), window), "parts")
    longer = _distinct(parts, "lead", "own")
    inner = common.written(_runs(longer, window, limit), "inner")
    common.discard(longer)
    back = parts.select("lead0", "own0", "shift", "lead", "own").join(inner, ["lead", "own"])
    moved = back.select(F.col("lead0").alias("lead"), F.col("own0").alias("own"), F.transform("runs", lambda x: x + F.col("shift")).alias("runs"))
    whole = moved.groupBy("lead", "own").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # one list a half
    return _search(level.join(many, "lead", "left_anti"), window).unionByName(whole)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text: str, keep: np.ndarray) -> str:
    """What is left of a text, with its white space inside each run that stays;
    runs are joined by one blank."""
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    return " ".join(text[spans[a][0] : spans[z - 1][1]] for a, z in edges.reshape(-1, 2).tolist())


_REMOVED = "d1 long, d2 long, n_removed long, kept_sha256 string, kept string"


def _removed(df: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Texts without the words that their repeated windows cover."""
    names = ["d1", "d2", "n_removed", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                rows: tuple[list, ...] = tuple([] for _ in names)
                for d1, d2, text, found in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    words = shingles.split_words(text)
                    change = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        at, runs = np.array(r["at"], np.int64), np.array(r["runs"], np.int64).reshape(-1, 2)
                        np.add.at(change, (at[:, None] + runs[:, 0]).ravel(), 1)
                        np.add.at(change, (at[:, None] + runs[:, 1]).ravel() + window, -1)
                    keep = np.cumsum(change)[:-1] == 0
                    left = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                    values = (d1, d2, len(words) - int(keep.sum()), hashlib.sha256(left).hexdigest(), _cut(text, keep) if with_text else None)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                yield _arrow("lllss", list(rows), names)

    return df.select("d1", "d2", "text", "found").mapInArrow(common.task(run), _REMOVED)


def _find(docs: DataFrame, window: int, gram: int, limit: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """What is known of every row, and what is left of the texts that lose words."""
    if window < gram:
        raise ValueError(f"a window has {gram} words at least")
    common.ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), *_key(), common.text_or_empty().alias("text"))
    first = common.written(_words_and_anchors(own, window, gram), "anchors")
    classes = first.where("hashes is not null").groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("hashes").alias("hashes"))
    classes = common.written(classes, "classes")
    each = classes.select("d1", "d2", "copies", F.explode("hashes").alias("h"))
    # Kept by itself, so that the join's sides are plain shuffles, which Spark can split where one hash has many rows.
    counted = common.written(each.groupBy("h").agg(F.sum(F.least("copies", F.lit(2))).alias("n")).where("n > 1").select("h"), "counted")
    known = each.join(counted, "h").groupBy("d1", "d2", "copies").agg(F.collect_set("h").alias("known"))
    one = own.groupBy("d1", "d2").agg(F.first("text").alias("text"))
    texts = common.written(one.join(known, ["d1", "d2"]), "candidates")
    placed = common.written(_contexts(texts, window, gram), "placed")
    distinct = _distinct(placed.withColumn("n", F.least("copies", F.lit(2)) * F.size("at")), "lead", "own")
    common.discard(counted)
    runs = common.written(_runs(distinct, window, limit), "runs")
    common.discard(distinct)
    # All windows of a text with copies repeat.
    found = placed.where("copies = 1").select("d1", "d2", "lead", "own", "at").join(runs, ["lead", "own"]).groupBy("d1", "d2").agg(F.collect_list(F.struct("at", "runs")).alias("found"))
    gone = _removed(texts.where("copies = 1").select("d1", "d2", "text").join(found, ["d1", "d2"]), window, with_text)
    copied = classes.where("copies > 1").select("d1", "d2", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), F.lit("").alias("kept"))
    return first, gone.unionByName(copied)


def _key() -> tuple:
    """128 bits of a text."""
    return F.xxhash64(common.text_or_empty()).alias("d1"), F.xxhash64(F.lit(1), common.text_or_empty()).alias("d2")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LEAD_CONTEXTS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed
    and kept_sha256."""
    first, gone = _find(docs, window, gram, limit, False)
    joined = first.select("id", "d1", "d2", "n_words", "all_sha256").join(gone, ["d1", "d2"], "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LEAD_CONTEXTS) -> DataFrame:
    """``docs`` with their texts cut; texts that lose nothing stay as they are."""
    _, gone = _find(docs, window, gram, limit, True)
    own = [f"__{c}" for c in ("d1", "d2", "kept")]  # names that no input has
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(_key(), own, strict=False)))
    cut = keyed.join(gone.select("d1", "d2", "kept").toDF(*own), own[:2], "left")
    return cut.withColumn("text", F.coalesce(own[2], "text")).select(*docs.columns)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_substrings": op7_substrings}
ORACLES = {
    "op7_substrings": rf"""
with own as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
starts as (select r, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from own where len(words) >= {WINDOW}),
windows as (select r, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) as w from starts),
again as (select w from windows group by w having count(*) > 1),
gone as (select r, list(distinct p) as places from (select r, unnest(range(i, i + {WINDOW})) as p from windows join again using (w)) group by r),
left_ as (select doc_id, len(words) as n, coalesce(len(places), 0) as removed, case when places is null then words else list_filter(words, lambda w, k: not list_contains(places, k)) end as kept from own left join gone using (r))
select doc_id, n::bigint as n_words, removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from left_"""
}
