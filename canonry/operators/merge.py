"""Survivors of a cluster: longest strings, means, united lists, sources, ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonry.functions import text
from canonry.session import persist_cut


def longest(value: Column, place: Column) -> Column:
    """Aggregate: the longest trimmed string, the first of equal ones, else ''."""
    trimmed = text.stripped(value)
    kept = F.when(F.length(trimmed) > 0, trimmed)
    return F.coalesce(F.max_by(kept, F.when(kept.isNotNull(), F.struct(F.length(kept), -place))), F.lit(""))


def mean(value: Column) -> Column:
    """Aggregate: mean to six places, null if there is nothing."""
    return F.round(F.avg(value), 6)


def united(items: Column, place: Column) -> Column:
    """Aggregate: all items in order of place, each once whatever its case."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), items.alias("items")))), lambda x: F.coalesce(x["items"], F.array().cast("array<string>")))
    return text.distinct_ignoring_case(F.filter(F.flatten(lists), lambda x: text.stripped(x) != ""))


def last_by_key(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Of rows that share a key the last."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(place)))
    return df.withColumn("_newest", newest).where("_newest = 1").drop("_newest")


def source_map(supplier: Column, id_: Column, place: Column) -> Column:
    """Aggregate: id by supplier, the last where a supplier has several."""
    entries = F.array_sort(F.collect_list(F.struct(place.alias("place"), supplier.alias("k"), id_.alias("v"))))
    unique = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(F.transform(unique, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``out``: 1, 2, ... in the given total order.  Rows are sorted over all tasks;
    only each task's row count is needed before the others'."""
    ordered = df.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ordered = persist_cut(ordered)
    # One row a task.
    sizes = ordered.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    local = F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    return ordered.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + local + 1).drop("_p", "_i", "_before")


def members(clusters: DataFrame) -> DataFrame:
    """One row for each node: cluster columns, ``place``, ``supplier``, ``id``."""
    return clusters.select("*", F.posexplode("nodes").alias("place", "n")).select("*", F.col("n.supplier").alias("supplier"), F.col("n.id").alias("id")).drop("nodes", "n")


def with_ids(clusters: DataFrame) -> DataFrame:
    """``canonical_id``: pairs first, then single records, then promoted ones, each
    by their least node."""
    rank = F.when(F.col("method") == "llm", 2).when(F.col("method") == "singleton", 1).otherwise(0)
    least = F.array_min(F.transform("nodes", lambda n: F.concat_ws("::", n["supplier"], n["id"])))
    made = numbered(clusters.withColumns({"_rank": rank, "_least": least}), [F.col("_rank"), F.col("_least")], "n")
    return made.withColumn("canonical_id", F.format_string("CAN-%05d", "n")).drop("_rank", "_least", "n")


def canonical_properties(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """``clusters`` with ``canonical_id``; ``records`` with amenities and
    image_urls as arrays."""
    each = members(clusters).join(records.select("supplier", "id", "name", "address", "lat", "lon", "stars", "amenities", "image_urls"), ["supplier", "id"])
    place = F.col("place")
    made = each.groupBy("canonical_id", "confidence", "method", "note").agg(
        longest(F.col("name"), place).alias("name"),
        longest(F.col("address"), place).alias("address"),
        mean(F.col("lat")).alias("lat"),
        mean(F.col("lon")).alias("lon"),
        mean(F.col("stars")).alias("stars"),
        united(F.col("amenities"), place).alias("amenities"),
        united(F.col("image_urls"), place).alias("image_urls"),
        source_map(F.col("supplier"), F.col("id"), place).alias("source_ids"),
    )
    return made.select(
        F.col("canonical_id").alias("id"), "name", "address", "lat", "lon", "stars", "amenities", "image_urls",
        F.when(F.size("source_ids") > 1, "matched").otherwise("singleton").alias("match_status"),
        F.round("confidence", 4).alias("match_confidence"), F.col("method").alias("match_method"), F.col("note").alias("match_note"), "source_ids",
    )


def attach_near_misses(near: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each pair at the canonical record of both of its ends."""
    owner = members(clusters).select("supplier", "id", "canonical_id")
    scores = [F.round(c, 4).alias(c) for c in ("confidence", "geo_score", "name_score")]
    forth = near.select(F.col("supplier_a").alias("supplier"), F.col("a_id").alias("id"), F.col("supplier_b").alias("candidate_supplier"), F.col("b_id").alias("candidate_id"), *scores)
    back = near.select(F.col("supplier_b").alias("supplier"), F.col("b_id").alias("id"), F.col("supplier_a").alias("candidate_supplier"), F.col("a_id").alias("candidate_id"), *scores)
    return forth.unionByName(back).join(owner, ["supplier", "id"]).select(F.col("canonical_id").alias("canonical_hotel_id"), "candidate_supplier", "candidate_id", "confidence", "geo_score", "name_score")


def fetched_fingerprints(urls: DataFrame, fetch: Callable[[str], str | None], known: DataFrame | None = None) -> DataFrame:
    """``url`` and ``fingerprint`` of every distinct url: from ``known`` where it is
    there, else what ``fetch`` returns on the executors, null where it returns nothing
    or fails.  The result, written, is the next build's ``known``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for url in p["url"]:
                try:
                    got.append(fetch(url))
                except Exception:  # what can't be fetched is kept, as not known
                    got.append(None)
            yield pd.DataFrame({"url": p["url"], "fingerprint": pd.Series(got, dtype="object")})

    schema = "url string, fingerprint string"
    wanted = urls.select("url").where("url is not null").distinct()
    if known is None:
        return wanted.mapInPandas(run, schema)
    own = known.select("url", "fingerprint").dropDuplicates(["url"])
    return wanted.join(own, "url").select("url", "fingerprint").unionByName(wanted.join(own, "url", "left_anti").mapInPandas(run, schema))


def dedupe_by_content(df: DataFrame, key: str, urls: str, fingerprints: DataFrame) -> DataFrame:
    """``urls`` without later ones of equal fingerprint; those without one stay.
    Lists of fewer than two are not looked up."""
    many = df.where(F.size(urls) > 1).select(key, F.posexplode(urls).alias("place", "url")).join(fingerprints, "url", "left")
    first = F.row_number().over(Window.partitionBy(key, "fingerprint").orderBy("place"))
    kept = many.withColumn("first", first).where("fingerprint is null or first = 1")
    again = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("_kept"))
    return df.join(again, key, "left").withColumn(urls, F.coalesce("_kept", urls)).drop("_kept")
