"""The best names within reach of every record, found inside the tasks of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.config import EARTH_KM
from canonry.operators.names import NameScorer
from canonry.session import persist_cut

#: Degrees of latitude of a kilometre, with room to spare.
DEGREES_PER_KM = 0.0136 / 1.5
#: Records of a cell that one task asks for, and that it holds at a time to compare them with.
ASKED, AT_ONCE = 16_384, 200_000
#: Scores of pairs of forms, and pairs of records, that are held at a time.
SCORES, PAIRS = 2_000_000, 1_000_000
#: Forms that a form is first compared with the records of; records that are, for each one kept.
FORMS, AHEAD = 64, 6
#: What is kept of a candidate; its form is only needed to score it.
KEPT = ["supplier", "id", "stars", "numbers"]
#: Bytes of records that a task holds at a time to compare others with.
BYTES = 32_000_000
#: Candidates that a task holds before it drops those that nothing keeps.
HELD = 20_000
#: Dense cells that are broadcast; beyond it they are joined.
BROADCAST_CELLS = 100_000

_OUT = "u_supplier string, u_id string, v_supplier string, v_id string, dist_km double, name_score double, stars_score double, apart boolean, rank int"


def _shrink(lat: Column) -> Column:
    return F.cos(F.radians(F.least(F.abs(lat), F.lit(85.0))))


def _column(lon: Column, cy: Column, step: float) -> Column:
    return F.floor(lon * _shrink((F.abs(cy) + 1) * step) / step)


def at_home(records: DataFrame, km: float) -> DataFrame:
    """Records with their own cell, ``cy`` and ``cx``; cells are twice ``km`` wide."""
    step = 2 * DEGREES_PER_KM * km
    band = F.floor(F.col("lat") / step)
    return records.where("lat is not null and lon is not null").withColumns({"cy": band, "cx": _column(F.col("lon"), band, step)})


def box(km: float) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that a circle around a record may reach."""
    reach = DEGREES_PER_KM * km
    return F.lit(reach), reach / _shrink(F.abs("lat") + reach)


def reached(records: DataFrame, km: float) -> DataFrame:
    """Records in every cell that the box of their circle touches, about four."""
    step = 2 * DEGREES_PER_KM * km
    high, wide = box(km)
    bands = F.sequence(F.floor((F.col("lat") - high) / step), F.floor((F.col("lat") + high) / step))
    own = records.where("lat is not null and lon is not null")
    return own.withColumn("cy", F.explode(bands)).withColumn("cx", F.explode(F.sequence(_column(F.col("lon") - wide, F.col("cy"), step), _column(F.col("lon") + wide, F.col("cy"), step))))


def dealt(records: DataFrame, km: float, asked: int = ASKED, only: DataFrame | None = None) -> DataFrame:
    """Every record in its own cell to ask (``role`` 0) and, to be found (1), in each cell
    that it reaches.  Cells with more than ``asked`` records are asked for in parts, by
    hash; with ``only`` (cy, cx) no others are asked for."""
    home, found = at_home(records, km), reached(records, km)
    if only is not None:
        home, found = (df.join(only, ["cy", "cx"], "left_semi") for df in (home, found))
    # Cells with more than a task's share: one of ``asked`` records at most.
    dense = persist_cut(home.groupBy("cy", "cx").count().where(F.col("count") > asked).select("cy", "cx", F.ceil(F.col("count") / asked).cast("int").alias("parts")))
    cells = dense.count()
    dense = F.broadcast(dense) if cells <= BROADCAST_CELLS else dense
    of = lambda df: df.join(dense, ["cy", "cx"], "left") if cells else df.withColumn("parts", F.lit(None).cast("int"))
    asks = of(home).withColumn("part", F.pmod(F.xxhash64("supplier", "id"), F.coalesce("parts", F.lit(1))).cast("int")).withColumn("role", F.lit(0))
    given = of(found).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("role", F.lit(1))
    return asks.unionByName(given).drop("parts")


class Places:
    """Coordinates of records, for distances between chosen ones."""

    def __init__(self, t: pa.Table):
        self.lat, self.lon = (np.radians(t.column(c).to_numpy()) for c in ("lat", "lon"))
        self.cos = np.cos(self.lat)
        self.unit = np.stack((self.cos * np.cos(self.lon), self.cos * np.sin(self.lon), np.sin(self.lat)), axis=1)

    def km(self, i: np.ndarray, other: Places, j: np.ndarray) -> np.ndarray:
        half_lat, half_lon = np.sin((other.lat[j] - self.lat[i]) / 2), np.sin((other.lon[j] - self.lon[i]) / 2)
        a = half_lat * half_lat + self.cos[i] * other.cos[j] * half_lon * half_lon
        return 2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0)))


class Forms:
    """Records by form: each form once, and where its records are, in their order."""

    def __init__(self, t: pa.Table, kernel):
        known = kernel.keys(t.column("form").combine_chunks()).dictionary_encode()
        self.of = known.indices.to_numpy().astype(np.int64)
        self.counts = np.bincount(self.of, minlength=len(known.dictionary))
        self.starts = np.cumsum(self.counts) - self.counts
        self.order = np.argsort(self.of, kind="stable")
        self.forms = t.column("form").take(pa.array(self.order[self.starts]))

    def records(self, forms: np.ndarray) -> np.ndarray:
        n = self.counts[forms]
        return self.order[np.repeat(self.starts[forms] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Best:
    """A bounded heap for each asked record: what is found comes in slices, and only what
    beats the last of a full heap is kept.  In a slice equal forms are scored once, and the
    records of the best forms come first, those of one score by supplier and id; so a record
    is done with a slice as soon as its heap is full, however many others it has."""

    def __init__(self, asked: pa.Table, kernel, km: float, k: int):
        self.asked, self.kernel, self.km, self.k = asked, kernel, km, k
        self.sizes = kernel.sizes(asked.column("form").combine_chunks())
        self.own, self.places = Forms(asked, kernel), Places(asked)
        self.last = np.full(len(asked), -np.inf)
        self.held: pa.Table | None = None
        self.u, self.v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.dist = np.zeros(0), np.zeros(0)
        #: Pairs of records that were compared.
        self.compared = 0

    def add(self, found: pa.Table) -> None:
        size = self.kernel.sizes(found.column("form").combine_chunks())
        # Names of too different a length can't beat what is there.
        open_ = self.kernel.bound(self.sizes, int(size.min()), int(size.max())) >= self.last
        if not open_.any():
            return
        found = found.take(pc.sort_indices(found, sort_keys=[("supplier", "ascending"), ("id", "ascending")]))
        given, places = Forms(found, self.kernel), Places(found)
        asking = np.unique(self.own.of[open_])
        step, out = max(1, SCORES // len(given.forms)), []
        for i in range(0, len(asking), step):
            some = asking[i : i + step]
            scores = self.kernel.matrix(self.own.forms.take(pa.array(some)), given.forms)
            for form, score in zip(some.tolist(), scores, strict=True):
                rows = self.own.records(np.array([form]))
                out += self._walk(rows[open_[rows]], score, given, places)
        if not out:
            return
        u, v, score, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        seen, of = np.unique(v, return_inverse=True)
        base, more = 0 if self.held is None else len(self.held), found.select(KEPT).take(pa.array(seen))
        self.held = more if self.held is None else pa.concat_tables([self.held, more])
        self.u, self.v = np.concatenate((self.u, u)), np.concatenate((self.v, base + of))
        self.score, self.dist = np.concatenate((self.score, score)), np.concatenate((self.dist, dist))
        self._cut()

    def _walk(self, rows: np.ndarray, score: np.ndarray, given: Forms, places: Places) -> Iterator[tuple]:
        """What the records ``rows`` of one form keep: row, place in the slice, score, distance."""
        least, below, take, piece = self.last[rows].min(), np.inf, FORMS, AHEAD * self.k
        missing = np.full(len(rows), self.k)
        while len(rows):
            forms = np.flatnonzero((score < below) & (score >= least))
            if not len(forms):
                return
            if len(forms) > take:
                forms = forms[score[forms] >= np.partition(score[forms], len(forms) - take)[len(forms) - take]]
            forms = forms[np.argsort(-score[forms], kind="stable")]
            n = np.cumsum(given.counts[forms])
            if n[-1] > piece:
                forms = forms[score[forms] >= score[forms[np.searchsorted(n, piece)]]]
            below, take = score[forms[-1]], 4 * take
            at, like = given.records(forms), np.repeat(score[forms], given.counts[forms])
            order = np.lexsort((at, -like))
            at, like, s = at[order], like[order], 0
            while s < len(at) and len(rows):
                e = s + min(piece, max(1, PAIRS // len(rows)))
                some, worth = at[s:e], like[s:e]
                self.compared += len(rows) * len(some)
                # Cosines leave none out that is near enough; distances decide.
                i, j = np.nonzero(self.places.unit[rows] @ places.unit[some].T >= np.cos(self.km / EARTH_KM) - 1e-13)
                far = self.places.km(rows[i], places, some[j])
                keep = (far <= self.km) & (worth[j] >= self.last[rows[i]])
                i, j, far = i[keep], j[keep], far[keep]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                keep = nth < missing[i]
                i, j, far = i[keep], j[keep], far[keep]
                if len(i):
                    yield rows[i], some[j], worth[j], far
                missing = missing - np.bincount(i, minlength=len(rows))
                on = (missing > 0) & (worth[-1] >= self.last[rows])
                rows, missing = rows[on], missing[on]
                s, piece = e, 2 * piece

    def _cut(self) -> None:
        seen, of = np.unique(self.v, return_inverse=True)
        # Ties go to the lesser supplier and id.
        by_name = pc.sort_indices(self.held.select(["supplier", "id"]).take(pa.array(seen)), sort_keys=[("supplier", "ascending"), ("id", "ascending")]).to_numpy()
        rank = np.empty(len(seen), np.int64)
        rank[by_name] = np.arange(len(seen))
        order = np.lexsort((rank[of], -self.score, self.u))
        first = np.flatnonzero(np.diff(self.u[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[place < self.k]
        self.place = place[place < self.k]
        self.u, self.v, self.score, self.dist = self.u[kept], self.v[kept], self.score[kept], self.dist[kept]
        full = self.place == self.k - 1
        self.last[self.u[full]] = self.score[full]
        if len(self.held) > HELD:
            seen, self.v = np.unique(self.v, return_inverse=True)
            self.held = self.held.take(pa.array(seen))

    def rows(self) -> pa.Table | None:
        """Pairs of different suppliers."""
        if not len(self.u):
            return None
        u, v = self.asked.select(KEPT).take(pa.array(self.u)), self.held.take(pa.array(self.v))
        other = pc.not_equal(u.column("supplier"), v.column("supplier")).to_numpy()
        stars = np.maximum(0.0, 1 - np.abs(u.column("stars").to_numpy() - v.column("stars").to_numpy()) / 2)
        apart = np.zeros(len(u), bool)
        count = lambda t: pc.list_value_length(t.column("numbers")).to_numpy()
        both = np.flatnonzero(other & (count(u) > 0) & (count(v) > 0))
        if len(both):
            ours, theirs = (t.column("numbers").take(pa.array(both)).to_pylist() for t in (u, v))
            apart[both] = [not set(a) & set(b) for a, b in zip(ours, theirs, strict=True)]
        keep = pa.array(other)
        columns = [
            u.column("supplier"), u.column("id"), v.column("supplier"), v.column("id"),
            pa.array(self.dist), pa.array(self.score), pa.array(np.nan_to_num(stars)), pa.array(apart), pa.array((self.place + 1).astype(np.int32)),
        ]
        made = pa.table(dict(zip([c.split()[0] for c in _OUT.split(", ")], columns, strict=True))).filter(keep)
        return made if len(made) else None


def best_within(records: DataFrame, km: float, k: int, scorer: NameScorer, asked: int = ASKED, only: DataFrame | None = None) -> DataFrame:
    """Per record the ``k`` best names at most ``km`` away, itself and its own supplier's
    among them, which leave only afterwards: ``u_`` and ``v_`` supplier and id, distance,
    name and stars scores, whether their numbers are ``apart``, and ``rank``.  ``records``:
    supplier, id, lat, lon, stars, numbers, form.

    What a cell's task is sent is as narrow as that, and no pair leaves it but the kept
    ones.  A task holds ``asked`` records and their heaps; what they are compared with is
    streamed past in slices, in order of names' lengths.  Poles and the antimeridian are out of scope."""
    kernel = scorer.kernel
    names = ["supplier", "id", "lat", "lon", "stars", "numbers", "form"]
    own = records.select("supplier", "id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce(F.col("stars").cast("double"), F.lit(float("nan"))).alias("stars"), "numbers", "form")
    by_size = F.size("form") if isinstance(own.schema["form"].dataType, type(own.schema["numbers"].dataType)) else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asks, given, best = None, [], [], None

        def past():
            """Hold what was given against what asks."""
            nonlocal given, best
            if best is None:
                best = Best(pa.concat_tables(asks).combine_chunks(), kernel, km, k)
            best.add(pa.concat_tables(given).combine_chunks())
            given = []

        def done():
            if given:
                past()
            made = best.rows() if best is not None else None
            return made.to_batches(max_chunksize=AT_ONCE // 4) if made is not None else []

        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("cy", "cx", "part", "role")]
            new = np.zeros(len(b), bool)
            new[:1] = True
            for c in keys:
                new[1:] |= np.diff(c) != 0
            edges = [*np.flatnonzero(new).tolist(), len(b)]
            for i, j in zip(edges, edges[1:], strict=False):
                cell, role = tuple(int(c[i]) for c in keys[:3]), int(keys[3][i])
                rows = pa.Table.from_batches([b.slice(i, j - i)]).select(names)
                if cell != at:
                    yield from done()
                    at, asks, given, best = cell, [], [], None
                if role == 0:
                    asks.append(rows)
                elif asks:
                    given.append(rows)
                    if sum(map(len, given)) >= AT_ONCE or sum(t.nbytes for t in given) >= BYTES:
                        past()
        yield from done()

    spread = dealt(own, km, asked, only).withColumn("size", by_size)
    return spread.repartition("cy", "cx", "part").sortWithinPartitions("cy", "cx", "part", "role", "size").mapInArrow(run, _OUT)
