"""Ids that outlive a build: clusters take over the id that most of their nodes had."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.operators import merge
from canonry.operators.components import components
from canonry.session import persist_cut

#: What happened to an id: its cluster is new, went with its nodes, went into that of
#: ``other_id``, or lost nodes to it.
EVENTS = ("new", "retired", "merged", "split")


def _number(id_):
    return F.substring(id_, 5, 20).cast("long")


def _greedy(part: pd.DataFrame) -> pd.DataFrame:
    """Largest overlaps first, ties to the older id, then to the lesser node."""
    own, old, kept = set(), set(), []
    for i in part.sort_values(["n", "number", "key"], ascending=[False, True, True], kind="stable").index:
        key, number = part.at[i, "key"], part.at[i, "number"]
        if key not in own and number not in old:
            own.add(key)
            old.add(number)
            kept.append(i)
    return part.loc[kept, ["key", "canonical_id"]]


def assigned(overlaps: DataFrame) -> DataFrame:
    """One-to-one ``key`` and ``canonical_id`` of ``overlaps`` (key, canonical_id, n),
    greedily by size.  Pairs that nothing contests need no choice; the others are chosen
    among in their connected component."""
    degrees = [overlaps.groupBy(c).agg(F.count("*").alias(f"of_{c}")) for c in ("key", "canonical_id")]
    counted = persist_cut(overlaps.join(degrees[0], "key").join(degrees[1], "canonical_id"))
    lone = counted.where("of_key = 1 and of_canonical_id = 1").select("key", "canonical_id")
    rest = counted.where("of_key > 1 or of_canonical_id > 1").select("key", "canonical_id", "n", _number("canonical_id").alias("number"))
    new, old = F.concat(F.lit("n"), "key"), F.concat(F.lit("o"), "canonical_id")
    roots = components(rest.select(new.alias("a"), old.alias("b")))
    placed = rest.join(roots, new == roots["node"]).select("root", "key", "canonical_id", "n", "number")
    return lone.unionByName(placed.groupBy("root").applyInPandas(_greedy, "key string, canonical_id string"))


def lasting_ids(clusters: DataFrame, known: DataFrame, highest: int = 0) -> tuple[DataFrame, DataFrame]:
    """``clusters`` with ``canonical_id``, and the history of this build.

    ``known`` has the ``canonical_id`` of every node (supplier, id) in the last build.  A
    cluster takes the id that it shares most nodes with, one cluster an id; so a cluster
    whose nodes stayed keeps its id.  Others get numbers after ``highest`` and all known
    ones, in the order of ``merge.with_ids``; no id is given twice.  The history has
    ``canonical_id``, ``event`` (see EVENTS), ``other_id`` and ``n``, the nodes concerned."""
    least = F.array_min(F.transform("nodes", lambda n: F.concat_ws("::", n["supplier"], n["id"])))
    keyed = persist_cut(clusters.withColumn("key", least))
    was = persist_cut(known.select("supplier", "id", "canonical_id"))
    nodes = merge.members(keyed.select("key", "nodes"))
    overlaps = persist_cut(nodes.join(was, ["supplier", "id"]).groupBy("key", "canonical_id").agg(F.count("*").alias("n")))
    kept = persist_cut(assigned(overlaps))
    top = max(highest, was.agg(F.max(_number("canonical_id"))).first()[0] or 0)
    fresh = merge.with_ids(keyed.join(kept, "key", "left_anti")).withColumn("canonical_id", F.format_string("CAN-%05d", _number("canonical_id") + top))
    out = persist_cut(keyed.join(kept, "key").select(fresh.columns).unionByName(fresh))
    moved = overlaps.join(kept, ["key", "canonical_id"], "left_anti").join(out.select("key", F.col("canonical_id").alias("other_id")), "key")
    stays = kept.select("canonical_id", F.lit(True).alias("stays"))
    parted = moved.join(stays, "canonical_id", "left").select("canonical_id", F.when(F.col("stays"), "split").otherwise("merged").alias("event"), "other_id", "n")
    none = F.lit(None).cast("string").alias("other_id")
    gone = was.groupBy("canonical_id").agg(F.count("*").alias("n")).join(overlaps, "canonical_id", "left_anti").select("canonical_id", F.lit("retired").alias("event"), none, "n")
    new = fresh.join(overlaps, "key", "left_anti").select("canonical_id", F.lit("new").alias("event"), none, F.size("nodes").cast("long").alias("n"))
    return out.drop("key"), parted.unionByName(gone).unionByName(new)
