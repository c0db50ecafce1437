"""Sliding-window rate limits, on tables and on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S, LIMIT = 60, 300


def offered(requests: DataFrame, client: str = "user_id", ts: str = "ts", seconds: int = WINDOW_S) -> DataFrame:
    """``offered``: requests of the client in the window up to each, itself too."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    back = Window.partitionBy(client).orderBy(micros).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return requests.withColumn("offered", F.count("*").over(back))


def _admit(times: Iterable[float], recent: deque, limit: int, seconds: float) -> list[bool]:
    """Only admitted requests count; they leave when older than the window."""
    out = []
    for t in times:
        while recent and t - recent[0] > seconds:
            recent.popleft()
        out.append(limit <= 0 or len(recent) < limit)
        if out[-1] and limit > 0:
            recent.append(t)
    return out


def stretches(requests: DataFrame, client: str = "user_id", ts: str = "ts", seconds: int = WINDOW_S) -> DataFrame:
    """``requests`` with ``stretch``: a pause longer than the window forgets all before it,
    so a client's stretches between such pauses are independent of each other.

    Times are cut into slices as long as the window.  Requests of one slice are no pause
    apart, so all pauses show between the last and the first request of slices that follow
    each other; these are found on one row a client and slice, not on requests."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    own = requests.withColumn("_slice", F.floor(micros / span))
    slices = own.groupBy(client, "_slice").agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    order = Window.partitionBy(client).orderBy("_slice")
    pause = F.col("first") - F.lag("last").over(order) > span
    told = slices.withColumn("pause", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("stretch", F.sum("pause").over(order)).select(F.col(client).alias("_client"), F.col("_slice").alias("_of"), "stretch")
    return own.join(told, F.col(client).eqNullSafe(F.col("_client")) & F.col("_slice").eqNullSafe(F.col("_of")), "left").drop("_client", "_of", "_slice")


def admitted(requests: DataFrame, client: str = "user_id", ts: str = "ts", event: str = "event_id", limit: int = LIMIT, seconds: int = WINDOW_S) -> DataFrame:
    """``admitted`` for each request.  Whether one is depends on all before it since the
    client's last pause, so a stretch is walked in order, streamed, not gathered; a client
    with pauses uses many tasks.  One that never pauses is one stretch, which only a walk
    from its start can decide."""
    columns = [f.name for f in requests.schema]
    at_client, at_ts, at_stretch = columns.index(client), columns.index(ts), len(columns)
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, recent = object(), deque()
        for p in parts:
            flags = []
            clients, cuts = (p.iloc[:, c].astype(object).where(p.iloc[:, c].notna(), None).tolist() for c in (at_client, at_stretch))
            times = (p.iloc[:, at_ts].astype("datetime64[ns]").astype("int64") / 1e9).tolist()
            start = 0
            # Rows of one stretch follow each other.
            for i, key in enumerate(zip(clients, cuts, strict=True)):
                if key != who:
                    flags += _admit(times[start:i], recent, limit, seconds)
                    who, recent, start = key, deque(), i
            flags += _admit(times[start:], recent, limit, seconds)
            yield p.iloc[:, :at_stretch].assign(admitted=flags)

    cut = stretches(requests, client, ts, seconds)
    return cut.repartition(client, "stretch").sortWithinPartitions(client, "stretch", ts, event).mapInPandas(run, schema)


def admitted_stream(requests: DataFrame, client: str = "user_id", ts: str = "ts", limit: int = LIMIT, seconds: int = WINDOW_S, delay: str = "1 minute") -> DataFrame:
    """The same on a stream, by the requests' own times, however slowly or out of order
    they come: a request waits in its client's state until the watermark, ``delay`` behind
    the latest time, has passed it, and is decided in order of times; so the answer is that
    of ``admitted`` on all requests that aren't later than ``delay``.  Later ones get no
    answer (Spark counts them as dropped by the watermark).

    The state of a client is what waits and the times it was admitted at in the last
    window, at most ``limit`` of them; it goes when the watermark has passed that window."""
    schema = T.StructType([T.StructField(client, requests.schema[client].dataType), T.StructField(ts, T.TimestampType()), T.StructField("admitted", T.BooleanType())])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, waiting = (list(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for p in parts:
                waiting += [t.value // 1000 for t in p[ts]]
        mark = state.getCurrentWatermarkMs() * 1000
        ready, waiting = sorted(t for t in waiting if t <= mark), [t for t in waiting if t > mark]
        now = deque(t / 1e6 for t in recent)
        flags = _admit((t / 1e6 for t in ready), now, limit, seconds)
        if ready:
            recent = [round(t * 1e6) for t in now]
            yield pd.DataFrame({client: key[0], ts: pd.to_datetime(ready, unit="us"), "admitted": flags})
        if recent and mark - recent[-1] > seconds * 1_000_000:
            recent = []
        if not recent and not waiting:
            state.remove()
            return
        state.update((recent, waiting))
        due = min(waiting) if waiting else recent[-1] + seconds * 1_000_000
        state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)

    state = T.StructType([T.StructField(x, T.ArrayType(T.LongType())) for x in ("recent", "waiting")])
    return requests.withWatermark(ts, delay).groupBy(client).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
