"""Rooms: pairs inside a cluster, matching, merged rooms with attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.config import DEFAULT, MatchConfig
from canonry.functions import text
from canonry.operators import merge
from canonry.operators.matching import max_weight_matching, unmatched
from canonry.operators.names import ROOM_DICE, NameScorer


def of_clusters(rooms: DataFrame, clusters: DataFrame, scorer: NameScorer = ROOM_DICE) -> DataFrame:
    """Rooms (supplier, hotel_id, room_id, name, amenities) of clustered
    properties, with what pairs are scored by: the forms of names and the beds."""
    owner = merge.members(clusters).select("canonical_id", "supplier", F.col("id").alias("hotel_id"), F.col("place").alias("hotel_place"))
    own = rooms.join(owner, ["supplier", "hotel_id"])
    return scorer.attach(own).withColumn("bed", text.bed_type(text.room_text(F.col("name"), F.col("amenities"))))


def scored_pairs(placed: DataFrame, cfg: MatchConfig = DEFAULT, scorer: NameScorer = ROOM_DICE) -> DataFrame:
    """All pairs of a cluster's rooms of different suppliers whose names are alike
    enough and whose beds don't conflict.  A cluster has the rooms of few
    properties, so its pairs are few."""
    side = lambda x: placed.select("canonical_id", F.col("supplier").alias(f"supplier_{x}"), F.col("room_id").alias(f"{x}_id"), F.col("form").alias(f"form_{x}"), F.col("bed").alias(f"bed_{x}"))
    pairs = side("a").join(side("b"), "canonical_id").where("supplier_a < supplier_b")
    scored = pairs.withColumn("confidence", scorer.score(F.col("form_a"), F.col("form_b")))
    conflict = F.coalesce(F.col("bed_a") != F.col("bed_b"), F.lit(False))
    return scored.where((F.col("confidence") >= cfg.room_accept) & ~conflict).select("canonical_id", "supplier_a", "a_id", "supplier_b", "b_id", "confidence")


def match(pairs: DataFrame) -> DataFrame:
    return max_weight_matching(pairs, ["canonical_id"])


def canonical_rooms(placed: DataFrame, matched: DataFrame) -> DataFrame:
    """Merged rooms; attributes are read from the merged name and amenities."""
    node = lambda s, i: F.struct(F.col(s).alias("supplier"), F.col(i).alias("id"))
    nodes = placed.select("supplier", F.col("room_id").alias("id"), "canonical_id")
    single = unmatched(nodes, matched).select("canonical_id", F.array(node("supplier", "id")).alias("nodes"), F.lit(1.0).alias("confidence"))
    both = matched.select("canonical_id", F.array(node("supplier_a", "a_id"), node("supplier_b", "b_id")).alias("nodes"), "confidence").unionByName(single)
    least = F.concat_ws("::", "canonical_id", F.when(F.size("nodes") > 1, "0").otherwise("1"), F.col("nodes")[0]["supplier"], F.col("nodes")[0]["id"])
    ided = merge.numbered(both.withColumn("_least", least), [F.col("_least")], "n").withColumn("id", F.format_string("CAN-RM-%06d", "n")).drop("_least", "n")
    each = ided.withColumnRenamed("id", "canonical_room_id").select("*", F.posexplode("nodes").alias("place", "node")).select("*", F.col("node.supplier").alias("supplier"), F.col("node.id").alias("room_id")).drop("nodes", "node")
    full = each.join(placed.select("supplier", "room_id", "canonical_id", "name", "amenities"), ["supplier", "room_id", "canonical_id"])
    place = F.col("place")
    made = full.groupBy("canonical_room_id", "canonical_id", "confidence").agg(
        merge.longest(F.col("name"), place).alias("best_name"),
        merge.united(F.col("amenities"), place).alias("amenities"),
        F.count("*").alias("sources"),
        merge.source_map(F.col("supplier"), F.col("room_id"), place).alias("source_room_ids"),
        merge.source_map(F.col("supplier"), F.col("name"), place).alias("source_names"),
    )
    made = made.withColumnRenamed("best_name", "name")
    whole = text.room_text(F.col("name"), F.col("amenities"))
    return made.select(
        F.col("canonical_room_id").alias("id"), F.col("canonical_id").alias("canonical_hotel_id"), "name",
        text.bed_type(whole).alias("bed_type"), text.occupancy(whole).alias("occupancy"), text.meal_plan(whole).alias("meal_plan"), text.view(whole).alias("view"), text.is_smoking(whole).alias("is_smoking"),
        "amenities", F.when(F.col("sources") > 1, "matched").otherwise("singleton").alias("match_status"), F.round("confidence", 4).alias("match_confidence"), "source_room_ids", "source_names",
    )
