"""Periodic runs in word sequences: maximal repetitions by Lyndon arrays, in linear time.

A run is a maximal stretch of words with smallest period q.  By the theorem of runs
every one holds, in one of the two orders of the alphabet, a Lyndon root: a place whose
next smaller suffix begins q words on.  So next smaller suffixes are computed for an
order and its reverse, with the extension (longest common prefix) of every pair that is
compared.  No pair is matched twice: a comparison starts where the extensions of the
two pairs before it agree, is settled there if they differ, and stops at the first
inner pair whose extension is known from before.  There are no suffix arrays or trees
and no fingerprints; words are only ever compared (their ranks come from sorting).

A run of ``MIN_EXPONENT`` periods holds each of its words that often.  So words that are
rarer within a stretch lie in no run and part it, until nothing changes; what remains
is all that the arrays are built for.

Defined results: null and empty texts have no runs and collapse to the empty text; equal
texts have equal runs; repeated rows get a row each; a null id stays null (and, in the
query, its words stay as they are); an empty table gives no rows; further columns are
ignored.  A text is a row of one task, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import split_words

#: Periods that a run has at least, and words.
MIN_EXPONENT, MIN_WORDS = 4, 6


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """For every place the start of the next smaller suffix (``len(s)`` if there is
    none; its distance is the Lyndon array) and how far the two suffixes agree.

    Places are taken from left to right, each compared with the one before it and
    that one's chain of previous smaller suffixes.  Of all matches the one that reaches
    farthest is kept; what lies inside of it is a copy of earlier places, whose
    extensions hold here too, so every word that matches moves its end on."""
    n = len(s)
    following, extent = [n] * n, [0] * n
    before, reach = [-1] * n, [0] * n
    left = right = end = 0
    for r in range(1, n):
        place, m, known = r - 1, 0, False
        up, low = -1, n
        while place >= 0:
            if not known:
                v, shift = -1, right - left
                if r + m < end:
                    if place >= right:
                        if following[place - shift] == r - shift:
                            v = extent[place - shift]
                        elif before[r - shift] == place - shift:
                            v = reach[r - shift]
                    else:
                        # All between are greater than this suffix, an ancestor of the copy's place;
                        # along such a chain the least extension is that of its ends.
                        if up < 0:
                            up = r - shift
                        while up > place:
                            low = min(low, reach[up])
                            up = before[up]
                        v = low if up == place else -1
                    v = min(v, end - r)
                if v >= m:
                    m = v
                if v < 0 or r + m >= end:
                    while r + m < n and s[place + m] == s[r + m]:
                        m += 1
                    if r + m > end:
                        left, right, end, up, low = place, r, r + m, -1, n
            if r + m < n and s[place + m] < s[r + m]:
                before[r], reach[r] = place, m
                break
            following[place], extent[place] = r, m
            e = reach[place]
            known = e != m
            m = min(m, e)
            place = before[place]
    return following, extent


def find_runs(s: list[int], least: int = MIN_EXPONENT, words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` periods (2 or more) and
    ``words`` words, by start, then period."""
    found = set()
    for ranks in (s, [-x for x in s]):
        following, extent = next_smaller(ranks)
        f, e = np.array(following, np.int64), np.array(extent, np.int64)
        period = f - np.arange(len(s))
        # The first root of a run begins less than a period after the run.
        for i in np.flatnonzero((f < len(s)) & (e > (least - 2) * period)).tolist():
            j, m = following[i], extent[i]
            q = j - i
            if i >= q and following[i - q] == i and extent[i - q] == m + q:
                continue
            start = i
            while start and s[start - 1] == s[start - 1 + q]:
                start -= 1
            length = j + m - start
            if length >= max(words, least * q):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ranks: np.ndarray, owner: np.ndarray, least: int = MIN_EXPONENT, words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """First place and end of what is left of the sequences (equal ``owner``, one
    after another) where words that occur fewer than ``least`` times part them."""
    at, part = np.arange(len(ranks)), owner.astype(np.int64)
    width = int(ranks.max(initial=0)) + 1
    while len(at):
        _, inverse, count = np.unique(part * width + ranks[at], return_inverse=True, return_counts=True)
        often = count[inverse] >= least
        whole = bool(often.all())
        at, part = at[often], part[often]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(part) != 0)
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= words if len(at) else np.zeros(0, bool)
        if whole and long.all():
            first = np.flatnonzero(new)
            return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 1).tolist(), strict=True))
        at, part = at[long], part[long]
    return []


def runs_of(texts: list[list[bytes]], least: int = MIN_EXPONENT, words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of each word sequence."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    flat = pa.array([w for t in texts for w in t], pa.large_binary())
    ranks = pc.rank(flat, tiebreaker="dense").to_numpy().astype(np.int64)
    out: list[list] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    for a, b in stretches(ranks, owner, least, words):
        d = int(owner[a])
        shift = a - int(ends[d] - sizes[d])
        out[d] += [(start + shift, length, q) for start, length, q in find_runs(ranks[a:b].tolist(), least, words)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """Words without those that any run repeats: of a run its first period stays."""
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    some = words if kept.all() else [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(some).decode("utf-8", "surrogatepass")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = MIN_EXPONENT, words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the words that stay, of each row of ``docs`` (doc_id, text)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [split_words(t) for t in b.column(1).to_pylist()]
            found = runs_of(texts, least, words)
            kept = [collapsed(t, r) for t, r in zip(texts, found, strict=True)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _RUNS), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(common.task(run), "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_planted_periods(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth document by hash from some word on periodic."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, common.WORD_SPLIT), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    some = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit("")))[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, some).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = periodic_runs(docs.select("doc_id", with_planted_periods(F.col("doc_id"), F.col("text")).alias("text")))
    # The longest first; of equal ones the first, then that of the smaller period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = made.withColumn("top", top)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.short")).alias("period"),
        F.expr("(1000 * top.length) div (-top.short)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))))"
#: Every stretch of a run holds five words in a row that are those of a period before.
ORACLES = {
    "op13_runs": rf"""
with own as (select row_number() over () as row, doc_id, {_CRC} as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as plain from documents),
planned as (select *, len(plain) as n, h // 10 as g, h % 10 = 0 and n > 0 as planted, case when planted then g % n end as a, 1 + (n - a) // (3 + g % 8) as p from own),
made as (select row, doc_id, n, case when planted then list_transform(range(n), lambda i: plain[case when i < a then i else a + (i - a) % p end + 1]) else plain end as words from planned),
placed as (select row, n, unnest(words) as w, generate_subscripts(words, 1) - 1 as i from made),
five as (select row, n, i, concat_ws(' ', w, lead(w, 1) over t, lead(w, 2) over t, lead(w, 3) over t, lead(w, 4) over t) as gram from placed window t as (partition by row order by i) qualify lead(w, 4) over t is not null),
pairs as (select x.row, x.i, y.i - x.i as q from five x join five y on x.row = y.row and x.gram = y.gram and y.i > x.i and {MIN_EXPONENT} * (y.i - x.i) <= x.n),
islands as (select row, q, min(i) as s, count(*) + 4 + q as l from (select *, i - row_number() over (partition by row, q order by i) as island from pairs) group by row, q, island),
long as (select * from islands where l >= greatest({MIN_WORDS}, {MIN_EXPONENT} * q)),
runs as (select * from long x where not exists (select 1 from long y where y.row = x.row and y.q < x.q and y.s <= x.s and y.s + y.l >= x.s + x.l)),
told as (select row, count(*) as n_runs, arg_max(s, (l, -s, -q)) as start, max(l) as length, arg_max(q, (l, -s, -q)) as period, string_agg(concat(s, ',', l, ',', q, chr(10)), '' order by s, q) as lines from runs group by row),
gone as (select distinct row, unnest(range(s + q, s + l)) as i from runs),
kept as (select row, string_agg(w, ' ' order by i) as rest from placed anti join gone using (row, i) group by row)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(rest, '')) as collapsed_sha256 from made left join told using (row) left join kept using (row)"""
}
QUERIES = {"op13_runs": op13_runs}
