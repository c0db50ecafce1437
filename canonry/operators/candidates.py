"""Candidate pairs: everything within a radius, best names first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.config import DEFAULT, MatchConfig
from canonry.functions import scores, text
from canonry.operators.names import DICE, NameScorer, cosine_scorer, ngram_scorer
from canonry.operators.nearby import DEGREES_PER_KM, best_within

__all__ = ["DEFAULT", "DICE", "NameScorer", "best_candidates", "cosine_scorer", "edges_of", "ngram_scorer", "prepared", "scored_edges", "valid_edges", "within"]


def prepared(feeds: DataFrame, scorer: NameScorer = DICE) -> DataFrame:
    """Name forms of each record; only what scoring needs."""
    return scorer.attach(feeds).select("supplier", "id", "lat", "lon", "stars", "form", text.property_numbers(F.col("name")).alias("numbers"))


def within(records: DataFrame, km: float, once: bool = False) -> DataFrame:
    """Ordered pairs (u, v) of records at most ``km`` apart, u with itself too; with ``once``
    each pair of different ids in one order only, whichever, from half of the cells around.
    Bands of latitude are cut into cells no smaller than the radius, each band by its
    own width; one side is dealt to its cell and the eight around it, so the join is
    on equality of cells.  Dense cells are split at run time where a join side is
    skewed.  Poles and the antimeridian are out of scope."""
    step = DEGREES_PER_KM * km
    band = F.floor(F.col("lat") / step)

    def cell(cy: Column) -> Column:
        """Of a longitude in a band; wide enough for the bands beside it too."""
        return F.floor(F.col("lon") * F.cos(F.radians(F.least((F.abs(cy) + 2) * step, F.lit(85.0)))) / step)

    names = [c for c in records.columns]
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if once else [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    around = F.array(*(F.struct((band + dy).alias("cy"), (cell(band + dy) + dx).alias("cx"), F.lit((dy, dx) == (0, 0)).alias("home")) for dy, dx in steps))
    u = records.select(*(F.col(c).alias(f"u_{c}") for c in names), F.explode(around).alias("o")).select("*", "o.cy", "o.cx", "o.home").drop("o")
    v = records.select(*(F.col(c).alias(f"v_{c}") for c in names), band.alias("cy"), cell(band).alias("cx"))
    far = scores.haversine_km(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
    met = u.join(v, ["cy", "cx"])
    if once:
        met = met.where(F.when(F.col("home"), F.col("u_id") < F.col("v_id")).otherwise(F.col("u_id") != F.col("v_id")))
    return met.withColumn("dist_km", far).where(F.col("dist_km") <= km).drop("cy", "cx", "home")


def best_candidates(records: DataFrame, cfg: MatchConfig = DEFAULT, scorer: NameScorer = DICE) -> DataFrame:
    """Per record the ``cfg.candidates`` best names in reach, itself and records of
    its own supplier among them; these leave only afterwards."""
    return best_within(records, cfg.rescue_km, cfg.candidates, scorer)


def scored_edges(feeds: DataFrame, cfg: MatchConfig = DEFAULT, scorer: NameScorer = DICE) -> DataFrame:
    """One row for each unordered pair that either side ranks and that scores."""
    return edges_of(best_candidates(prepared(feeds, scorer), cfg, scorer), cfg)


def edges_of(best: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """The edges of candidates as ``best_candidates`` has them."""
    first = F.struct("u_supplier", "u_id") < F.struct("v_supplier", "v_id")
    pick = lambda c: F.when(first, F.col(f"u_{c}")).otherwise(F.col(f"v_{c}"))
    other = lambda c: F.when(first, F.col(f"v_{c}")).otherwise(F.col(f"u_{c}"))
    pairs = best.select(
        pick("supplier").alias("supplier_a"), pick("id").alias("a_id"), other("supplier").alias("supplier_b"), other("id").alias("b_id"),
        "dist_km", "name_score", "stars_score", "apart",
    )
    main = F.col("dist_km") <= cfg.max_km
    rescue = ~main & (F.col("name_score") >= cfg.rescue_name) & ~F.col("apart")
    geo = F.when(main, scores.decay(F.col("dist_km"), cfg.half_life_km)).otherwise(scores.decay(F.col("dist_km"), cfg.rescue_half_life_km))
    plain = cfg.weight_geo * F.col("geo_score") + cfg.weight_name * F.col("name_score") + cfg.weight_stars * F.col("stars_score")
    saved = cfg.rescue_weight_name * F.col("name_score") + cfg.rescue_weight_geo * F.col("geo_score") + cfg.rescue_weight_stars * F.col("stars_score")
    veto = F.col("apart") & (F.col("name_score") < cfg.number_veto_name)
    made = pairs.where(main | rescue).withColumn("is_rescue", rescue).withColumn("geo_score", geo)
    made = made.withColumn("confidence", F.when(F.col("is_rescue"), saved).otherwise(plain)).withColumn("eligible", F.col("is_rescue") | ((F.col("name_score") >= cfg.least_name) & ~veto))
    # Both directions of a pair have the same scores up to the last bit: keep the larger.
    value = F.max_by(F.struct("confidence", "geo_score", "name_score", "stars_score", "dist_km", "eligible", "is_rescue"), "confidence").alias("e")
    return made.where(F.col("confidence") >= cfg.near_miss).groupBy("supplier_a", "a_id", "supplier_b", "b_id").agg(value).select("supplier_a", "a_id", "supplier_b", "b_id", "e.*")


def valid_edges(edges: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return edges.where(F.col("eligible") & (F.col("confidence") >= cfg.accept))
