"""From feeds to the canonical layer."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from canonry.config import DEFAULT, MatchConfig
from canonry.operators import adjudicate, candidates, lasting, matching, merge, rooms
from canonry.plans import incremental
from canonry.session import counted, persist_cut
from canonry.sources import artifact, feeds

_one_build = threading.Lock()
_status = {"state": "idle", "error": None}


@dataclass
class BuildReport:
    skipped: bool = False
    counts: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)
    #: Rows without coordinates, by supplier.
    dropped: dict = field(default_factory=dict)
    #: Rows whose key a later row of the same supplier has too, by kind.
    replaced: dict = field(default_factory=dict)
    #: As adjudicate.run_report has it.
    adjudication: dict = field(default_factory=dict)
    #: What was re-scored and re-solved, where the build went on from the last one.
    update: incremental.UpdateReport | None = None
    #: Ids by what happened to them.
    ids: dict = field(default_factory=dict)

#: What happened to ids, build by build.
ID_HISTORY = "canonical_id string, event string, other_id string, n long, at long"


def layers(records: DataFrame, room_rows: DataFrame, cfg: MatchConfig = DEFAULT, verdicts: DataFrame | None = None, adjudicator: Callable[[str], str | tuple | None] | None = None, fingerprints: DataFrame | None = None, told: dict | None = None, state: str | None = None, known: DataFrame | None = None, highest: int = 0) -> dict[str, DataFrame]:
    """All tables of the canonical layer.  ``records`` and ``room_rows`` are clean
    and unique by (supplier, id) and (supplier, room_id).  ``told`` is filled with the
    adjudication's report and its new verdicts.  With ``state``, a path, matching goes on
    from what is there; with ``known`` (supplier, id, canonical_id) ids do."""
    if state is None:
        edges = persist_cut(candidates.scored_edges(records, cfg))
        matched = persist_cut(matching.max_weight_matching(candidates.valid_edges(edges, cfg)))
    else:
        kept, update = incremental.update(records.sparkSession, records, state, cfg)
        edges = persist_cut(candidates.edges_of(kept.read("directed"), cfg))
        matched = persist_cut(kept.read("matched").drop("tile"))
        if told is not None:
            told["update"] = update
    nodes = records.select("supplier", "id")
    groups = matching.clusters(nodes, matched)
    near = persist_cut(matching.near_misses(edges, matched).withColumns({c: F.round(c, 4) for c in ("confidence", "geo_score", "name_score", "stars_score", "dist_km")}))
    judged = adjudication(near, matched, records, cfg, verdicts, adjudicator)
    if judged is not None:
        judged, cases, cached, answers, new = judged
        accepted = persist_cut(adjudicate.greedy_one_to_one(judged))
        if told is not None:
            told |= {"report": adjudicate.run_report(cases, cached, answers, accepted, cfg), "verdicts": new}
        groups = adjudicate.promote(groups, accepted)
        near = near.join(accepted.select(matching.PAIR), matching.PAIR, "left_anti")
    if known is None:
        ided = persist_cut(merge.with_ids(groups))
    else:
        ided, history = lasting.lasting_ids(groups, known, highest)
        if told is not None:
            told["history"] = persist_cut(history)
    canonical = merge.canonical_properties(ided, records)
    if fingerprints is not None:
        canonical = merge.dedupe_by_content(canonical, "id", "image_urls", fingerprints)
    placed = persist_cut(rooms.of_clusters(room_rows, ided))
    pairs = persist_cut(rooms.scored_pairs(placed, cfg))
    return {
        "raw_hotels": records,
        "canonical_hotels": canonical,
        "raw_rooms": room_rows,
        "canonical_rooms": rooms.canonical_rooms(placed, rooms.match(pairs)),
        "near_misses": merge.attach_near_misses(near, ided),
    }


def adjudication(near: DataFrame, matched: DataFrame, records: DataFrame, cfg: MatchConfig, verdicts: DataFrame | None, adjudicator: Callable[[str], str | tuple | None] | None) -> tuple | None:
    """Hard cases with their verdicts, all cases, those that the cache knew, what was
    answered and the new verdicts; None if there is nothing to ask."""
    if verdicts is None and adjudicator is None:
        return None
    spark = near.sparkSession
    claimed = matching._ends(matched).distinct()
    cases = persist_cut(adjudicate.hard_cases(near, claimed, cfg))
    known = verdicts if verdicts is not None else spark.createDataFrame([], adjudicate.VERDICT)
    known = known.dropDuplicates(["key"])
    cached = persist_cut(adjudicate.with_cached(cases, known).where("same_hotel is not null"))
    answers = new = None
    if adjudicator is not None:
        open_ = adjudicate.with_cached(cases, known).where("same_hotel is null").select(cases.columns)
        numbered = adjudicate.batches(open_, cfg)
        answers = persist_cut(adjudicate.ask(adjudicate.prompts(adjudicate.prompt_lines(numbered, records)), adjudicator))
        new = persist_cut(adjudicate.read_answers(answers, numbered, cfg).dropDuplicates(["key"]))
        known = known.unionByName(new)
    return adjudicate.with_cached(cases, known).where("same_hotel is not null"), cases, cached, answers, new


def build(
    spark: SparkSession, folder: str, path: str, force: bool = False, cfg: MatchConfig = DEFAULT, adjudicator: Callable[[str], str | tuple | None] | None = None, verdicts: str | None = None, spend: str | None = None,
    fetch: Callable[[str], str | None] | None = None, fingerprints: str | None = None, goes_on: bool = False,
) -> BuildReport:
    """Build all tables and the nested documents from a folder of feeds.  ``verdicts``,
    ``spend`` and ``fingerprints`` are paths of side tables that are read and added to:
    what a model has answered, what runs have cost, and what ``fetch`` has returned.
    With ``goes_on``, matching starts from the state of the last such build (under
    ``state``), clusters keep their ids, and what happened to ids is added to ``ids``."""
    if not force and artifact.exists(spark, path):
        return BuildReport(skipped=True)
    if not _one_build.acquire(blocking=False):
        raise RuntimeError("a build is running")
    report, began = BuildReport(), time.monotonic()
    try:
        _status.update(state="running", error=None)
        loaded = Observation()
        raw = persist_cut(feeds.scan(spark, folder, "hotels").observe(loaded, F.count(F.lit(1)).alias("rows"), F.count_if(feeds.without_place()).alias("dropped")))
        if loaded.get["dropped"]:
            report.dropped = {r["supplier"]: r["n"] for r in feeds.dropped_rows(raw).collect()}
        records, own = counted(merge.last_by_key(feeds.clean_properties(raw), ["supplier", "id"], "line"))
        records = persist_cut(records)
        raw_rooms, room_lines = counted(feeds.scan(spark, folder, "rooms"))
        raw_rooms = persist_cut(raw_rooms)
        room_rows, own_rooms = counted(merge.last_by_key(feeds.clean_rooms(raw_rooms), ["supplier", "room_id"], "line"))
        room_rows = persist_cut(room_rows)
        report.replaced = {"hotels": loaded.get["rows"] - loaded.get["dropped"] - own.get["rows"], "rooms": room_lines.get["rows"] - own_rooms.get["rows"]}
        report.seconds["load"] = time.monotonic() - began
        known = feeds.side_table(spark, verdicts, adjudicate.VERDICT) if verdicts else None
        prints = None
        if fetch is not None or fingerprints is not None:
            old = persist_cut(feeds.side_table(spark, fingerprints, "url string, fingerprint string")) if fingerprints else None
            prints = persist_cut(merge.fetched_fingerprints(records.select(F.explode("image_urls").alias("url")), fetch or (lambda url: None), old))
            if fetch is not None and fingerprints:
                feeds.keep(prints.join(old.select("url"), "url", "left_anti"), fingerprints)
        told: dict = {}
        last, highest = None, 0
        if goes_on:
            past = feeds.side_table(spark, f"{path}/ids", ID_HISTORY)
            highest = past.agg(F.max(lasting._number("canonical_id"))).first()[0] or 0
            if artifact.exists(spark, path):
                last = artifact.Catalog(spark, path).table("canonical_hotels").select(F.col("id").alias("canonical_id"), F.explode("source_ids").alias("supplier", "id"))
        tables = layers(records, room_rows, cfg, known, adjudicator, prints, told, f"{path}/state" if goes_on else None, last, highest)
        report.update = told.get("update")
        report.adjudication = told.get("report", {})
        if told.get("verdicts") is not None:
            if verdicts:
                feeds.keep(told["verdicts"], verdicts)
            if spend:
                r = report.adjudication
                feeds.keep(spark.createDataFrame([(r["prompt_tokens"], r["completion_tokens"], r["called"], r["cost_usd"])], adjudicate.RUN), spend)
        report.counts = artifact.write(path, tables)
        if told.get("history") is not None:
            report.ids = {r["event"]: r["count"] for r in told["history"].groupBy("event").count().collect()}
            feeds.keep(told["history"].withColumn("at", F.lit(time.time_ns())), f"{path}/ids")
        report.seconds["total"] = time.monotonic() - began
        _status.update(state="completed")
        return report
    except BaseException as e:
        _status.update(state="error", error=str(e))
        raise
    finally:
        _one_build.release()


def status() -> dict:
    return dict(_status)
