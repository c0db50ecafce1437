"""Rate limits against walking all requests in order."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from canonry.streaming import ratelimit

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id int, user_id string, ts timestamp, stretch string"


def brute(rows, limit, seconds):
    recent, out = defaultdict(deque), {}
    for i, client, t, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        now = recent[client]
        while now and (t - now[0]).total_seconds() > seconds:
            now.popleft()
        out[i] = len(now) < limit
        if out[i]:
            now.append(t)
    return out


def requests(seed, n, spread):
    rng = random.Random(seed)
    return [(i, rng.choice(["u", "u", "u", "v", None]), START + timedelta(milliseconds=rng.choice([rng.randrange(spread * 1000), 60_000 * rng.randrange(spread // 60)])), "x") for i in range(n)]


def test_stretches_between_pauses(spark):
    for n, spread in ((300, 40_000), (300, 2000)):
        rows = requests(n + spread, n, spread)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r["event_id"]: r["admitted"] for r in ratelimit.admitted(df.drop("stretch"), limit=2).collect()}
        assert got == brute(rows, 2, 60)
        cut = defaultdict(list)
        for r in ratelimit.stretches(df.drop("stretch")).collect():
            cut[r["user_id"], r["stretch"]].append(r["ts"])
        for client in ("u", "v", None):
            mine = sorted((min(t), max(t)) for (c, _), t in cut.items() if c == client)
            assert all((b[0] - a[1]).total_seconds() > 60 for a, b in zip(mine, mine[1:], strict=False))
            assert all((y - x).total_seconds() <= 60 for (c, _), t in cut.items() if c == client for x, y in zip(sorted(t), sorted(t)[1:], strict=False))


def test_one_client_uses_many_tasks(spark):
    rows = [(i, "hot", START + timedelta(seconds=200 * (i // 5) + i % 5), "x") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).drop("stretch")
    cut = ratelimit.stretches(df).repartition(8, "user_id", "stretch")
    assert cut.select(F.spark_partition_id()).distinct().count() == 8
    assert {r["event_id"]: r["admitted"] for r in ratelimit.admitted(df, limit=3).collect()} == {i: i % 5 < 3 for i in range(400)}


def test_empty(spark):
    assert ratelimit.admitted(spark.createDataFrame([], SCHEMA).drop("stretch")).collect() == []


def test_a_stream_out_of_order(spark, tmp_path):
    """Requests come late and mixed, files apart in time; answers are those of their own times."""
    rng = random.Random(7)
    rows = [(i, rng.choice("uv"), START + timedelta(seconds=rng.randrange(600)), "x") for i in range(120)]
    rows.sort(key=lambda r: r[2])
    # Up to half a minute out of order.
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(30)))
    late = [(900, "u", START + timedelta(seconds=1), "x")]
    last = [(999, "w", START + timedelta(days=1), "x")]
    parts = [mixed[i : i + 30] for i in range(0, 120, 30)]
    for n, part in enumerate([*parts[:3], parts[3] + late, last]):
        spark.createDataFrame(part, SCHEMA).select("event_id", "user_id", "ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema("event_id int, user_id string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = ratelimit.admitted_stream(source, limit=4, delay="1 minute")
    query = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = sorted((r["user_id"], r["ts"].replace(tzinfo=timezone.utc), r["admitted"]) for r in spark.table("limited").collect())
    flags = brute(rows, 4, 60)
    assert got == sorted((u, t, flags[i]) for i, u, t, _ in rows)
    assert sum(p["numRowsDroppedByWatermark"] for q in query.recentProgress for p in q["stateOperators"]) == 1
