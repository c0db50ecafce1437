"""Exact Jaccard join in metric space: pivots, regions, windows, recursion.

A document is the set of its distinct word shingles; d(x, y) = 1 - Jaccard is a
metric, and two documents link when d <= r.  Equal sets are one class, so a group
of copies counts once.

Pivots.  In one fixed order of all shingles, two sets that link must share at
least l of their first n - ceil(s * n) + l shingles (s = 1 - r), so a class with
fewer shared ones links with nothing.  Among the classes left, each shingle of
those prefixes elects the class of least hash that has it as pivot.  A class lies
in the regions of all pivots its prefix elects; classes that link share a prefix
shingle and so lie in a common region.  Shingles that are frequent in a sample
come last in the order, so common passages elect no regions.

Voronoi regions.  A region with too many members or shingles is divided: ``PIVOTS``
of its members become pivots, every member's distance to each is measured, and it
goes to the nearest.  By the triangle inequality a document that links with one of
another pivot's region lies at most 2r further from that pivot than from its own,
so it is replicated to every pivot in that window and to no other.  What lies within
r of its pivot is linked to it, and needn't meet others that are.  Regions are
divided again, by new pivots, in rounds over all tasks.  Where distances are so even
that a member would go to more than ``COPIES`` pivots on average, as among edited
copies of one text, or after ``ROUNDS``, the region is cut into blocks, of which each
pair is joined but those of members that are linked to one pivot.

Recursion.  A region that fits is joined in one task by the same means: a new pivot,
links to what lies within r, which is compared with what lies in (r, 2r] inside the
windows of the triangle inequality, and on with all that did not link.  Every pair
that may link and isn't connected already is compared, so components are exact.
They are found from the links between classes by alternating stars.

Shingles are compared by 64-bit hashes, texts that stand for a set by 128 bits.
Defined results: a null text or one without words has the empty set and links with
nothing; with fewer words than a shingle the whole sequence is one; repeated rows
share a component; rows without an id are members like others, but name a component
only if no member has an id (then it is null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph, shingles

WIDTH = 4
#: Similarity of a link in hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: l as a share of a set's size.
EXTRA = 0.05
#: Documents whose shingles set the order, the least count of a frequent one, and how
#: many are kept at most, the most frequent.  Any order gives the same links.
SAMPLE_ROWS, FREQUENT, FREQUENT_SHINGLES = 10_000, 4, 500_000
#: Members, and shingles, of a region that are joined in one task.
REGION, SHINGLES = 1000, 2_000_000
#: Pivots that divide a larger one, how often one is divided, and how many of the
#: pivots' regions a member may be in on average.
PIVOTS, ROUNDS, COPIES = 8, 3, 2
#: Classes whose ids are broadcast at most to fetch their texts.
BROADCAST_ROWS = 500_000

def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    h, n = shingles.shingle_hashes(texts, width, shingles.lower_words)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if texts else []


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def extra(n: int, share: float = EXTRA) -> int:
    return max(1, int(n * share))


def _need(n: Column, percent: int) -> Column:
    """How many prefix shingles a set of n shares with any that it links with,
    which may be smaller than it by the factor of the threshold."""
    return F.greatest(F.lit(1), F.floor(n * (EXTRA * percent / 100)).cast("int"))


def prefix(s: np.ndarray, common_: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set: rare ones by hash, then frequent ones."""
    n = len(s)
    size = n - -(-percent * n // 100) + extra(n)
    at = np.minimum(np.searchsorted(common_, s), max(len(common_) - 1, 0))
    often = common_[at] == s if len(common_) else np.zeros(n, bool)
    return np.concatenate([s[~often], s[often]])[:size]


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that occur in ``FREQUENT`` documents of a bounded sample, however long
    its texts are at most ``FREQUENT_SHINGLES`` (4 MB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _sets(b.column(0).to_pylist(), width):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    some = common.sampled(docs, SAMPLE_ROWS, "id", "text").select("text")
    often = some.mapInArrow(common.task(run), "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(FREQUENT_SHINGLES).select("h").toPandas()
    return np.sort(often["h"].to_numpy(np.int64).view(np.uint64))


def _classes(docs: DataFrame, width: int, percent: int, common_: np.ndarray) -> DataFrame:
    """Of every row: its number, text digest, class, set size and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = _sets(part.column(3).to_pylist(), width)
                first = [prefix(s, common_, percent).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                    ["id", "d1", "d2", "c", "n", "first"],
                )

    made = docs.select("id", "d1", "d2", "text").mapInArrow(common.task(run), "id long, d1 long, d2 long, c long, n long, first array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _members(texts: DataFrame, width: int) -> DataFrame:
    """The sets of one text of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = _sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c", "s"])

    # Rows that share id and text are one set.
    return texts.select("c", "text").mapInArrow(common.task(run), "c long, s array<long>").dropDuplicates(["c"])


class Region:
    """The sets of one region over a common dictionary."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.end = np.cumsum(self.size)
        self.mark = np.zeros(int(self.flat.max()) + 1, np.int32)
        self.percent = percent
        self.parent = np.arange(len(sets))
        self.compared = 0

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Intersection sizes of member i with others."""
        own = self.flat[self.end[i] - self.size[i] : self.end[i]]
        self.mark[own] = 1
        n = self.size[others]
        at = np.repeat(self.end[others] - np.cumsum(n), n) + np.arange(int(n.sum()))
        out = np.add.reduceat(self.mark[self.flat[at]], np.cumsum(n) - n)
        self.mark[own] = 0
        self.compared += len(others)
        return out

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others whose size lets them link with i."""
        a, b = self.size[i], self.size[others]
        return others[100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)]

    def join(self, label: np.ndarray | None = None) -> None:
        """Unite all members that link, given that those of one ``label`` are linked
        to one pivot outside already; 0 is no label."""
        r = 1 - self.percent / 100
        rest = np.arange(len(self.size))
        if label is not None and label.any():
            names, own, times = np.unique(label, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(names):
                some = np.flatnonzero(own == k)
                for i in some[1:]:
                    self.unite(int(some[0]), int(i))
            largest = int(np.argmax(np.where(names != 0, times, 0)))
            known, rest = np.flatnonzero(own == largest), np.flatnonzero(own != largest)
            for y in rest:
                self._meet(int(y), known)
        while len(rest) > 1:
            p, rest = int(rest[0]), rest[1:]
            both = self.shared(p, rest)
            union = self.size[p] + self.size[rest] - both
            links = 100 * both >= self.percent * union
            for x in rest[links]:
                self.unite(p, int(x))
            d = 1 - both / union
            ball, far = rest[links], rest[~links]
            if len(ball):
                d_ball, d_far = d[links], d[~links]
                ring = d_far <= 2 * r + 1e-9
                for y, dy in zip(far[ring].tolist(), d_far[ring].tolist(), strict=True):
                    self._meet(y, ball[d_ball >= dy - r - 1e-9])
            rest = far

    def _meet(self, y: int, others: np.ndarray) -> None:
        """Compare y with those of others it isn't connected to."""
        others = self.near(y, others)
        if not len(others):
            return
        own = self.root(y)
        if all(self.root(int(others[k])) == own for k in (0, len(others) // 2, -1)):
            others = np.array([x for x in others.tolist() if self.root(x) != own], np.int64)
            if not len(others):
                return
        both = self.shared(y, others)
        for x in others[100 * both >= self.percent * (self.size[y] + self.size[others] - both)]:
            self.unite(y, int(x))


#: A member of a region: the pivot that it is linked to already (0: none), its set.
_REGION = "key string, c long, label long, s array<long>"


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, cut = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:z].copy() for a, z in zip(cut, cut[1:], strict=False)]


def _links(regions: DataFrame, percent: int) -> DataFrame:
    """``regions``: key, c, label, s.  Links of every region as stars."""

    def joined(rows: list[tuple]) -> pa.RecordBatch:
        region = Region([r[3] for r in rows], percent)
        region.join(np.fromiter((r[2] for r in rows), np.int64, len(rows)))
        c = [r[1] for r in rows]
        pairs = [(c[i], c[k]) for i in range(len(rows)) if (k := region.root(i)) != i]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(j).to_pylist() for j in range(3)), _arrays(b.column(3)), strict=True):
                if rows and row[0] != rows[-1][0]:
                    if len(rows) > 1:
                        yield joined(rows)
                    rows = []
                rows.append(row)
        if len(rows) > 1:
            yield joined(rows)

    together = regions.select("key", "c", "label", "s").repartition("key").sortWithinPartitions("key", "c")
    return together.mapInArrow(common.task(run), "a long, b long")


def nearest(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set and pivot: do they link, is it the set's nearest, is it in the
    window of 2r beyond the nearest."""
    r = 1 - percent / 100
    both = np.array([[np.isin(p, s, assume_unique=True).sum() for p in pivots] for s in sets], np.int64).reshape(len(sets), len(pivots))
    union = np.array(list(map(len, sets)), np.int64)[:, None] + np.array(list(map(len, pivots)), np.int64) - both
    d = 1 - both / union
    home = d.argmin(axis=1)
    return 100 * both >= percent * union, np.arange(len(pivots)) == home[:, None], d <= d.min(axis=1)[:, None] + 2 * r + 1e-9


def _divided(large: DataFrame, percent: int, limit: int) -> DataFrame:
    """Each member of ``large`` with ``linked``, the pivots that it links with, and
    ``to``, the numbers of the pivots whose regions it is in; its label is the
    pivot that it is nearest to, if it links with it."""
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("shares"))
    # The least hash of each of PIVOTS kinds, of members without a label if there are any.
    h = F.xxhash64("key", "c")
    picked = large.groupBy("key", F.pmod(h, F.lit(PIVOTS)).alias("j")).agg(F.min(F.struct((F.col("label") != 0).alias("known"), h.alias("h"), "c")).alias("p")).select("key", "j", F.col("p.c").alias("c"))
    dealt = large.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "key")
    pivots = dealt.join(picked, ["key", "c"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rows = dealt.withColumn("share", F.pmod(F.xxhash64("c"), F.col("shares")).cast("int")).withColumn("j", F.lit(None).cast("long"))
    columns = ["key", "share", "j", "c", "label", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, names, sets = None, [], np.zeros(0, np.int64), []
        for b in batches:
            key, share, j, c, label = (b.column(i).to_pylist() for i in range(5))
            s = _arrays(b.column(5))
            out: list[list] = [[] for _ in range(6)]

            def measure(rows: list[int]) -> None:
                if not rows:
                    return
                links, home, window = nearest([s[i] for i in rows], sets, percent)
                for i, l, h, w in zip(rows, links, home, window, strict=True):
                    own = names[l & h]
                    values = (key[i], c[i], int(own[0]) if len(own) else label[i], names[l].tolist(), np.flatnonzero(w).tolist(), s[i])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)

            open_: list[int] = []
            for i in range(b.num_rows):
                if (key[i], share[i]) != at:
                    measure(open_)
                    open_, at, pivots = [], (key[i], share[i]), []
                if j[i] is not None:
                    pivots.append((c[i], s[i]))
                    names, sets = np.array([p for p, _ in pivots], np.int64), [p for _, p in pivots]
                else:
                    open_.append(i)
            measure(open_)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["key", "c", "label", "linked", "to", "s"])

    # A share's pivots come before its members.
    together = pivots.select(*columns).unionByName(rows.select(*columns)).repartition("key", "share").sortWithinPartitions("key", "share", F.asc_nulls_last("j"), "c")
    return together.mapInArrow(common.task(run), "key string, c long, label long, linked array<long>, to array<int>, s array<long>")


def _blocks(large: DataFrame, limit: int, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Members of regions by pairs of blocks.  Blocks of members of the commonest
    label only meet those of others, all others meet all."""
    label = large.where("label <> 0").groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    kind = F.when(F.col("label") == F.col("most"), 0).otherwise(1)
    kinds = written(large.join(label, "key", "left").select("key", "c", "label", "s", kind.alias("kind")), "kinds")
    need = F.greatest(F.ceil(F.count("*") / (limit / 2)), F.ceil(F.sum(F.size("s")) / (SHINGLES / 2))).cast("int")
    table = kinds.groupBy("key", "kind").agg(need.alias("k")).groupBy("key").agg(F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("k"))), F.lit(0)).alias("k0"), F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("k"))), F.lit(0)).alias("k1"))
    placed = kinds.join(table, "key").withColumn("i", F.pmod(F.xxhash64("c"), F.when(F.col("kind") == 0, F.col("k0")).otherwise(F.col("k1"))).cast("int"))
    i = F.col("i")

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def name(kind: str, a, b):
        return F.concat_ws("/", F.col("key"), F.lit(kind), a.cast("string"), b.cast("string"))

    outer = F.concat(F.transform(upto(F.col("k1")), lambda j: name("b", F.least(i, j), F.greatest(i, j))), F.transform(upto(F.col("k0")), lambda j: name("a", j, i)))
    inner = F.transform(upto(F.col("k1")), lambda j: name("a", i, j))
    return placed.withColumn("key", F.explode(F.when(F.col("kind") == 0, inner).otherwise(outer))).select("key", "c", "label", "s")


def _sorted_out(regions: DataFrame, limit: int, written: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Regions that fit a task, and those that don't; those whose members are all
    linked to one pivot are done."""
    sizes = regions.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.size("s")).alias("w"), F.min("label").alias("a"), F.max("label").alias("z")).where("m > 1 and not (a = z and a <> 0)")
    fits = (F.col("m") <= limit) & (F.col("w") <= SHINGLES)
    both = written(sizes.select("key", fits.alias("fits")), "sizes")
    return regions.join(both.where("fits"), "key").drop("fits"), regions.join(both.where("not fits"), "key").drop("fits")


def _region_links(placed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, limit: int, kept: list[DataFrame]) -> DataFrame:
    """Links of all members of all regions; ``placed``: p, c.  What was written for them
    is added to ``kept``, to be deleted once the links are read."""

    def written(df: DataFrame, name: str) -> DataFrame:
        kept.append(common.written(df, name))
        return kept[-1]

    sizes = placed.join(classes.select("c", "n"), "c").groupBy("p").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
    both = written(sizes.select("p", ((F.col("m") <= limit) & (F.col("w") <= SHINGLES)).alias("fits")), "sizes")
    region = (F.col("p").cast("string").alias("key"), "c", F.lit(0).cast("long").alias("label"), "s")
    links = _links(placed.join(both.where("fits"), "p").join(sets, "c").select(*region), percent)
    large = both.where("not fits")
    if large.isEmpty():
        return links
    left = written(placed.join(large, "p").join(sets, "c").select(*region), "large")
    for _ in range(ROUNDS):
        cut = written(_divided(left, percent, limit), "divided")
        links = links.unionByName(cut.select(F.col("c").alias("a"), F.explode("linked").alias("b")))
        spread = written(cut.groupBy("key").agg((F.sum(F.size("to")) <= COPIES * F.count("*")).alias("helps")), "spread")
        stuck = _relabelled(cut.join(spread.where("not helps").select("key"), "key"))
        links = links.unionByName(_links(_blocks(stuck, limit, written), percent))
        parts = cut.join(spread.where("helps").select("key"), "key").withColumn("to", F.explode("to"))
        small, left = _sorted_out(parts.select(F.concat_ws("/", "key", "to").alias("key"), "c", "label", "s"), limit, written)
        links = links.unionByName(_links(small, percent))
        left = written(left, "large")
        if left.isEmpty():
            return links
    return links.unionByName(_links(_blocks(left, limit, written), percent))


def _relabelled(cut: DataFrame) -> DataFrame:
    """Members of regions that stay whole; what links with the pivot that most link
    with has it as label."""
    count = cut.select("key", F.explode("linked").alias("p")).groupBy("key", "p").count()
    most = count.groupBy("key").agg(F.max_by("p", F.struct("count", "p")).alias("most"))
    label = F.when(F.array_contains("linked", F.col("most")), F.col("most")).otherwise(F.col("label"))
    return cut.join(most, "key", "left").select("key", "c", label.alias("label"), "s")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, limit: int = REGION, with_texts: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with ``n_shingles`` and ``component_id``; with
    ``with_texts`` also ``d1`` and ``d2``, a digest of the row's text, and ``class``,
    which names the component whatever the ids in it (null: in none)."""
    common.ship(docs.sparkSession)
    text = common.text_or_empty()
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), text.alias("text"))
    first = common.written(_classes(own, width, percent, _frequent(own, width)), "classes")
    # The row that speaks for a set, known by its number, id and text.
    speaker = F.min(F.struct(F.isnull("id").alias("none"), "id", "row", "d1", "d2")).alias("speaker")
    classes = common.written(first.where("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"), speaker), "ids")
    # Copies of a set speak once.
    copied = classes.where("copies > 1").select("c", F.col("speaker.row").alias("speaks"))
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    single = first.where("c is not null").join(copied, "c", "left").where("speaks is null or speaks = row")
    each = single.select("c", F.explode("first").alias("h"))
    elect = (F.min("c").alias("p"), F.max("c").alias("q"))
    met = common.written(each.groupBy("h").agg(*elect).where("p <> q").select("h"), "met")
    shared = common.written(each.join(met, "h"), "shared")
    left = shared.groupBy("c").agg(F.count("*").alias("have")).join(classes.select("c", _need(F.col("n"), percent).alias("need")), "c").where("have >= need")
    left = common.written(left.select("c", "need"), "left")
    kept = common.written(shared.join(left, "c").select("c", "h", "need"), "kept")
    common.discard(met, shared)
    pivots = common.written(kept.groupBy("h").agg(*elect).where("p <> q").select("h", "p"), "pivots")
    # Each side may leave its least pivots out while they lead fewer than half of
    # the shingles that it must share: two that link keep one in common.
    led = kept.join(pivots, "h").groupBy("c", "p", "need").agg(F.count("*").alias("m"))
    small_first = Window.partitionBy("c").orderBy("m", F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = led.withColumn("dropped", F.sum("m").over(small_first)).where(2 * F.col("dropped") > F.col("need") - 1).select("p", "c")
    placed = common.written(placed, "regions")
    # Pivots are members too: where they left their own region out, they come back.
    regions, placed = placed, common.written(placed.unionByName(placed.select("p", F.col("p").alias("c"))).distinct(), "placed")
    common.discard(kept, pivots, regions, left)
    key = (F.coalesce(F.col("speaker.id"), F.lit(0)).alias("k"), F.col("speaker.d1").alias("d1"), F.col("speaker.d2").alias("d2"))
    members = common.written(classes.join(placed.select("c").distinct(), "c").select("c", *key), "members")
    wanted = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    sets = common.written(_members(own.withColumn("k", F.coalesce("id", F.lit(0))).join(wanted, ["k", "d1", "d2"]), width), "sets")
    done = [placed, members, sets]
    # The links are cut from what they were made of there.
    roots = graph.components(_region_links(placed, classes, sets, percent, limit, done))
    common.discard(*done)
    known = classes.select("c", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(least, "root").select("c", "root", "component")
    whole = first.select("id", "d1", "d2", "c", "n").join(named, "c", "left")
    more = ("d1", "d2", F.col("root").alias("class")) if with_texts else ()
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), *more)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLES = {
    "op2_jaccard": rf"""
with recursive own as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
sets as (select distinct doc_id, md5(array_to_string(words[i:i + {WIDTH - 1}], ' ')) as s from (select doc_id, words, unnest(range(1, greatest(len(words) - {WIDTH - 2}, 2))) as i from own where len(words) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as both_ from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * both_ >= {PERCENT} * (p.n + q.n - both_)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id from documents d left join sizes using (doc_id) join (select x as doc_id, min(y) as c from reach group by x) using (doc_id)"""
}
