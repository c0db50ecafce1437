"""Feeds and rooms made of the star-schema tables, as one SQL text for any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDS = """
  select 'a' as supplier, concat('A-', lpad(cast(k as string), 6, '0')) as id,
    concat(case when k % 6 = 0 then concat('OYO ', cast(100 + k % 50 as string), ' ') else '' end, pn, ' ', seg) as name,
    concat(cast(k % 90 as string), ' ', pn, ' road') as address, lat, lon, stars, k as truth_key from b
  union all
  select 'b', concat('B-', lpad(cast(k as string), 6, '0')),
    concat(case when k % 9 = 0 then 'Treebo ' else '' end,
      case when k % 6 = 0 then concat(cast(100 + (k + k % 2 * 3 + k % 5) % 50 as string), ' ') else '' end,
      case when k % 3 = 0 then concat(seg, ' ', pn) else concat(pn, ' ', seg) end,
      case when k % 5 = 0 then ' inn' else '' end),
    concat(cast(k % 90 as string), ' ', pn, ' rd'),
    lat + ((k * 31) % 13) * 0.0005e0, lon + ((k * 17) % 7) * 0.0003e0,
    case when k % 4 = 0 then stars + 1.0e0 else stars end, k
  from b where k % 4 <> 3"""

BASE = """
  select c.c_custkey as k, lower(c.c_mktsegment) as seg, p.p_name as pn,
    12.8e0 + ((c.c_custkey * 7919) % 10007) / 10007.0e0 * 0.3e0 as lat,
    77.45e0 + ((c.c_custkey * 104729) % 10007) / 10007.0e0 * 0.3e0 as lon,
    case when c.c_custkey % 7 = 0 then null else 1.0e0 + (c.c_custkey % 5) end as stars
  from customer c join part p on p.p_partkey = c.c_custkey % 64"""

ROOMS = """
  select supplier, hotel_id, concat('R', upper(supplier), '-', lpad(cast(j as string), 7, '0')) as room_id,
    concat(case j % 4 when 0 then 'Deluxe' when 1 then 'Standard' when 2 then 'Superior' else 'Executive' end,
      case j % 7 when 0 then ' King' when 1 then ' Queen' when 2 then ' Twin' when 3 then ' Dbl' when 4 then ', 2 Bedroom' when 5 then '' else ' Dorm' end,
      case when supplier = 'a' then ' Room' else '' end,
      case j % 5 when 0 then ' w/ Breakfast' when 1 then ' - City view' when 2 then ' Pool View' when 3 then '' else ' Half Board' end,
      case j % 11 when 0 then ' Non-Smoking' when 1 then ' Smoking' else '' end) as name,
    case when supplier = 'a' then case j % 6 when 0 then '3 Adults|Wifi|WIFI' when 1 then 'Queen Bed|2 Guests' when 2 then 'sleeps 4| TV ||tv' else '' end else '' end as amenities_raw
  from (select supplier, hotel_id, k, i, k * 3 + i as j from (select supplier, id as hotel_id, truth_key as k from feeds) f
        cross join (select 0 as i union all select 1 union all select 2) r where i <= k % 3) x"""

#: The feeds, where supplier b writes every third of its names another way.
MISSPELT = "case when supplier = 'b' and truth_key % 3 = 1 then translate(concat(substr(name, 1, 2), substr(name, 4, 1), substr(name, 3, 1), substr(name, 5)), 'e', 'a') else name end"

#: The feeds as they were before: records that had not come, other names and places.
EARLIER = """select supplier, id, case when truth_key % 29 = 5 then concat(name, ' x') else name end as name, address,
    case when supplier = 'b' and truth_key % 11 = 4 then lat + 0.02e0 when supplier = 'b' and truth_key % 5 = 2 then lat - ((truth_key * 31) % 13) * 0.0005e0 else lat end as lat, lon, stars, truth_key
  from {feeds} where supplier = 'a' or truth_key % 7 <> 3"""

WITH_FEEDS = f"with b as ({BASE}),\nfeeds as ({FEEDS})"
WITH_ROOMS = f"{WITH_FEEDS},\nrooms as ({ROOMS})"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part")}
    return spark.sql(sql.replace("from customer c join part p", "from {customer} c join {part} p"), **tables)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, f"{WITH_FEEDS} select * from feeds")


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EARLIER, feeds=feeds(spark, sf_dir))


def misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds(spark, sf_dir).withColumn("name", F.expr(MISSPELT))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, f"{WITH_ROOMS} select * from rooms")
