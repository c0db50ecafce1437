"""Matching that goes on from the last build: what no change can reach is kept.

The state of a build is three tables partitioned by build and tile (a square of degrees):
records with a hash of their content, each record's best candidates, and the matched
edges.  An update

1. compares hashes; records that came, went or differ are its changes;
2. re-scores the cells that a change reaches, before or after it; all others keep their
   candidates, since nothing within their radius is new;
3. re-solves the connected components that hold an end of an edge that came, went or
   differs; all others keep their matching, since they are the same component as before.

It reads and writes the tiles around the changes only (more, where a component leads out
of them); a table of tiles says which build holds each.  It is written last and publishes
the update at once.  What comes out equals a full build."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.config import DEFAULT, MatchConfig
from canonry.operators import candidates, matching, nearby
from canonry.operators.components import components
from canonry.operators.names import DICE, NameScorer
from canonry.session import persist_cut
from canonry.sources.artifact import current, missing

#: Degrees that a tile is wide and high; the earth has 64,800 of them at most.
TILE = 1.0


_WHERE = "build string, tile long"
SCHEMAS = {
    "directed": f"u_supplier string, u_id string, v_supplier string, v_id string, dist_km double, name_score double, stars_score double, apart boolean, rank int, cy long, cx long, {_WHERE}",
    "matched": f"supplier_a string, a_id string, supplier_b string, b_id string, confidence double, geo_score double, name_score double, stars_score double, dist_km double, eligible boolean, is_rescue boolean, {_WHERE}",
}


@dataclass
class UpdateReport:
    changed: int = 0
    #: Cells and records re-scored, edges re-solved, tiles read.
    cells: int = 0
    scored: int = 0
    solved: int = 0
    tiles: list = field(default_factory=list)


def _row(lat, degrees: float):
    return F.floor((lat + 90) / degrees)


def _place(lon, degrees: float):
    return F.floor((lon + 180) / degrees)


def _numbered(row, place, degrees: float):
    return (row * (int(360 // degrees) + 2) + place).cast("long")


def hashed(records: DataFrame, degrees: float = TILE) -> DataFrame:
    """Records with ``tile`` and ``content``, a hash of all their columns but ``line``, the
    place in a file."""
    return records.withColumns({"content": F.md5(F.to_json(F.struct(*(c for c in records.columns if c != "line")))), "tile": _numbered(_row(F.col("lat"), degrees), _place(F.col("lon"), degrees), degrees)})


def tiles_of(places: DataFrame, km: float, degrees: float = TILE) -> set[int]:
    """Tiles that circles around ``places`` (lat, lon) touch: as many as there are at most."""
    high, wide = nearby.box(km)
    own = places.where("lat is not null and lon is not null").select("lat", "lon", high.alias("high"), wide.alias("wide"))
    rows = own.withColumn("row", F.explode(F.sequence(_row(F.col("lat") - F.col("high"), degrees), _row(F.col("lat") + F.col("high"), degrees))))
    each = rows.withColumn("place", F.explode(F.sequence(_place(F.col("lon") - F.col("wide"), degrees), _place(F.col("lon") + F.col("wide"), degrees))))
    return {r[0] for r in each.select(_numbered(F.col("row"), F.col("place"), degrees)).distinct().collect()}


class MatchState:
    """The tables of the last build at ``path``."""

    def __init__(self, spark: SparkSession, path: str, degrees: float = TILE):
        self.spark, self.path, self.degrees = spark, path, degrees
        at = current(spark, path)
        self.map = spark.read.parquet(at) if at else None

    def read(self, name: str, tiles: set[int] | None = None) -> DataFrame:
        """A table, of some tiles only if they are given: others aren't opened."""
        try:
            whole = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}") if name in SCHEMAS else self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing has ever matched
            if not missing(e):
                raise
            whole = self.spark.createDataFrame([], SCHEMAS[name])
        some = self.map if tiles is None else self.map.where(F.col("tile").isin(sorted(tiles)))
        part = whole if tiles is None else whole.where(F.col("tile").isin(sorted(tiles)))
        # As many rows as tiles.
        return part.withColumn("tile", F.col("tile").cast("long")).join(F.broadcast(some), ["tile", "build"], "left_semi").drop("build")

    def write(self, tables: dict[str, DataFrame], tiles: set[int] | None) -> None:
        """Add the rows of ``tiles`` (all, if None) and publish them."""
        build = f"build-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.withColumn("build", F.lit(build)).hint("rebalance", "tile").write.mode("append").partitionBy("build", "tile").parquet(f"{self.path}/{name}")
        mine = tables["records"].select("tile").distinct() if tiles is None else self.spark.createDataFrame([(t,) for t in sorted(tiles)], "tile long")
        mine = mine.withColumn("build", F.lit(build))
        if self.map is not None and tiles is not None:
            mine = mine.unionByName(self.map.join(mine, "tile", "left_anti"))
        mine.write.parquet(f"{self.path}/{build}")
        self.spark.createDataFrame([(time.time_ns(), build)], "at long, build string").coalesce(1).write.mode("append").json(f"{self.path}/published")
        self.map = self.spark.read.parquet(f"{self.path}/{build}")


def _scored(records: DataFrame, cfg: MatchConfig, scorer: NameScorer, only: DataFrame | None = None) -> DataFrame:
    """Best candidates, with the tile and cell of the record that asked."""
    best = nearby.best_within(candidates.prepared(records, scorer), cfg.rescue_km, cfg.candidates, scorer, only=only)
    place = nearby.at_home(records.select("supplier", "id", "lat", "lon", "tile"), cfg.rescue_km).select(F.col("supplier").alias("u_supplier"), F.col("id").alias("u_id"), "tile", "cy", "cx")
    return best.join(place, ["u_supplier", "u_id"])


def _valid(best: DataFrame, cfg: MatchConfig) -> DataFrame:
    return candidates.valid_edges(candidates.edges_of(best, cfg), cfg)


def _placed(matched: DataFrame, records: DataFrame) -> DataFrame:
    return matched.join(records.select(F.col("supplier").alias("supplier_a"), F.col("id").alias("a_id"), "tile"), ["supplier_a", "a_id"])


def full(spark: SparkSession, records: DataFrame, path: str, cfg: MatchConfig = DEFAULT, scorer: NameScorer = DICE, degrees: float = TILE) -> MatchState:
    """Match all records and keep the state."""
    state = MatchState(spark, path, degrees)
    own = persist_cut(hashed(records, degrees).where("tile is not null"))
    best = persist_cut(_scored(own, cfg, scorer))
    matched = matching.max_weight_matching(persist_cut(_valid(best, cfg)))
    state.write({"records": own, "directed": best, "matched": _placed(matched, own)}, None)
    return state


def update(spark: SparkSession, records: DataFrame, path: str, cfg: MatchConfig = DEFAULT, scorer: NameScorer = DICE, degrees: float = TILE) -> tuple[MatchState, UpdateReport]:
    """Go on from the state at ``path`` to ``records``, all that there are now; a full
    build where there is none.  ``scorer`` must score names by themselves: weights
    fitted on all records change with every one of them."""
    state = MatchState(spark, path, degrees)
    if state.map is None:
        return full(spark, records, path, cfg, scorer, degrees), UpdateReport()
    km = cfg.rescue_km
    own = persist_cut(hashed(records, degrees).where("tile is not null"))
    key = ["supplier", "id"]
    was = state.read("records").select(*key, F.col("content").alias("old_content"), F.col("lat").alias("old_lat"), F.col("lon").alias("old_lon"))
    differ = own.select(*key, "content", "lat", "lon").join(was, key, "full").where(~F.col("content").eqNullSafe(F.col("old_content")))
    differ = persist_cut(differ)
    report = UpdateReport(changed=differ.count())
    if not report.changed:
        return state, report
    places = differ.select("lat", "lon").unionByName(differ.select(F.col("old_lat").alias("lat"), F.col("old_lon").alias("lon")))
    cells = persist_cut(nearby.reached(places, km).select("cy", "cx").distinct())
    asked = persist_cut(nearby.at_home(own.select("lat", "lon"), km).join(cells, ["cy", "cx"], "left_semi").select("lat", "lon"))
    tiles = tiles_of(places.unionByName(asked), km, degrees)
    again = persist_cut(_scored(own.where(F.col("tile").isin(sorted(tiles))), cfg, scorer, cells))
    while True:
        old = state.read("directed", tiles)
        new = persist_cut(old.join(cells, ["cy", "cx"], "left_anti").unionByName(again))
        before, after = persist_cut(_valid(old, cfg)), persist_cut(_valid(new, cfg))
        ends = persist_cut(matching._ends(before.exceptAll(after).unionByName(after.exceptAll(before))).distinct())
        node = lambda s, i: F.concat_ws("\u0001", s, i)
        named = after.withColumns({"u": node("supplier_a", "a_id"), "v": node("supplier_b", "b_id")})
        roots = components(named.select(F.col("u").alias("a"), F.col("v").alias("b")))
        open_ = roots.join(ends.select(node("supplier", "id").alias("node")), "node", "left_semi").select("root").distinct()
        within = persist_cut(roots.join(open_, "root", "left_semi").select("node"))
        reach = tiles_of(own.join(within, node(F.col("supplier"), F.col("id")) == within["node"], "left_semi"), km, degrees)
        if reach <= tiles:
            break
        # A component leads on; what is around it is read, too.
        tiles |= reach
    gone = persist_cut(within.unionByName(ends.select(node("supplier", "id").alias("node"))).distinct())
    solved = named.join(within, F.col("u") == F.col("node"), "left_semi").select(after.columns)
    kept = state.read("matched", tiles).drop("tile")
    for side in ("a", "b"):
        kept = kept.join(gone, node(F.col(f"supplier_{side}"), F.col(f"{side}_id")) == gone["node"], "left_anti")
    matched = persist_cut(kept.select(after.columns).unionByName(matching.max_weight_matching(solved)))
    report.cells, report.scored, report.solved, report.tiles = cells.count(), asked.count(), solved.count(), sorted(tiles)
    state.write({"records": own.where(F.col("tile").isin(report.tiles)), "directed": new, "matched": _placed(matched, own)}, tiles)
    return state, report
