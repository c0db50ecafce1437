"""Bounded adjudication of hard cases: selection, cached verdicts, promotion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonry.config import DEFAULT, MatchConfig
from canonry.operators.components import components
from canonry.operators.matching import PAIR

VERDICT = "key string, same_hotel boolean, confidence double, reason string"

PREAMBLE = (
    "Decide for each numbered pair of listings whether both describe one and the same property.\n"
    "Brand changes and other spellings may still be the same; other property numbers or plainly other names are not.\n"
    'If in doubt answer false. Answer only with JSON: {"adjudications": [{"index": 0, "same_hotel": false, "confidence": 0.0, "reason": ""}]}\n'
)


def priority():
    return F.col("geo_score") - F.abs(F.col("name_score") - 0.5)


def hard_cases(near: DataFrame, claimed: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """The near misses most worth a verdict; ``claimed`` (supplier, id) are done."""
    a = claimed.select(F.col("supplier").alias("supplier_a"), F.col("id").alias("a_id"))
    b = claimed.select(F.col("supplier").alias("supplier_b"), F.col("id").alias("b_id"))
    band = near.where((F.col("geo_score") >= cfg.hard_geo) & (F.col("name_score") >= cfg.hard_name_low) & (F.col("name_score") < cfg.hard_name_high))
    free = band.join(a, ["supplier_a", "a_id"], "left_anti").join(b, ["supplier_b", "b_id"], "left_anti")
    return free.orderBy(F.desc(priority()), *PAIR).limit(cfg.hard_pairs)


def pair_key():
    return F.concat_ws("::", "supplier_a", "a_id", "supplier_b", "b_id")


def with_cached(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cases with the verdict that is known for them, if any."""
    return cases.withColumn("key", pair_key()).join(verdicts.select("key", "same_hotel", F.col("confidence").alias("verdict_confidence"), "reason"), "key", "left")


def batches(cases: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Number of the request and index in it; there are ``cfg.hard_pairs`` at most."""
    n = F.row_number().over(Window.orderBy(F.desc(priority()), *PAIR)) - 1
    return cases.withColumn("batch", F.floor(n / cfg.batch_pairs).cast("int")).withColumn("index", (n % cfg.batch_pairs).cast("int"))


def prompt_lines(numbered: DataFrame, records: DataFrame) -> DataFrame:
    """One line for each pair, with both names, addresses and stars; the line's format
    is a fixed value."""
    stars = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    a = records.select(*(F.col(c).alias(f"{c}_x") for c in ("supplier", "id", "name", "address", "stars")))
    b = records.select(*(F.col(c).alias(f"{c}_y") for c in ("supplier", "id", "name", "address", "stars")))
    full = numbered.join(a, (F.col("supplier_a") == F.col("supplier_x")) & (F.col("a_id") == F.col("id_x")), "left").join(b, (F.col("supplier_b") == F.col("supplier_y")) & (F.col("b_id") == F.col("id_y")), "left")
    side = lambda letter, x: F.concat(F.lit(f'{letter}="'), F.coalesce(f"name_{x}", F.lit("")), F.lit('" ('), F.coalesce(f"address_{x}", F.lit("")), F.lit(", "), stars(f"stars_{x}"), F.lit(" stars)"))
    line = F.concat(F.col("index").cast("string"), F.lit(". "), side("A", "x"), F.lit(" vs "), side("B", "y"), F.lit("; "), F.round(F.col("dist_km") * 1000).cast("long").cast("string"), F.lit("m apart."))
    return full.select("batch", "index", line.alias("line"))


def prompts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("batch").agg(F.concat(F.lit(PREAMBLE), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n")).alias("prompt"))


def ask(requests: DataFrame, adjudicator: Callable[[str], str | tuple[str, int, int] | None] | None) -> DataFrame:
    """``batch``, ``answer``, ``prompt_tokens`` and ``completion_tokens``.  The
    adjudicator returns an answer, or an answer with both counts; without one, or
    where it fails, the answer is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            answers, asked, told = [], [], []
            for prompt in p["prompt"]:
                try:
                    got = adjudicator(prompt) if adjudicator else None
                except Exception:  # a failed request leaves its pairs near misses
                    got = None
                answer, a, t = got if isinstance(got, tuple) else (got, 0, 0)
                answers.append(answer)
                asked.append(a)
                told.append(t)
            yield pd.DataFrame({"batch": p["batch"], "answer": pd.Series(answers, dtype="object"), "prompt_tokens": pd.Series(asked, dtype="int64"), "completion_tokens": pd.Series(told, dtype="int64")})

    return requests.select("batch", "prompt").mapInPandas(run, "batch int, answer string, prompt_tokens long, completion_tokens long")


def read_answers(answers: DataFrame, numbered: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Verdicts by key; answers that can't be read and missing indexes are skipped."""
    shape = "struct<adjudications: array<struct<index: int, same_hotel: boolean, confidence: double, reason: string>>>"
    read = answers.select("batch", F.explode(F.from_json("answer", shape)["adjudications"]).alias("v")).where("v.index is not null")
    keyed = numbered.select("batch", "index", pair_key().alias("key"))
    return read.select("batch", F.col("v.index").alias("index"), F.coalesce("v.same_hotel", F.lit(False)).alias("same_hotel"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"), F.substring(F.coalesce("v.reason", F.lit("")), 1, cfg.reason_chars).alias("reason")).join(keyed, ["batch", "index"]).select("key", "same_hotel", "confidence", "reason")


def greedy_one_to_one(judged: DataFrame) -> DataFrame:
    """Of positive verdicts, by falling confidence, those whose a is not yet an a
    and whose b is not yet a b.  ``judged`` is bounded by ``cfg.hard_pairs``."""
    ordered = judged.where("same_hotel").withColumn("place", F.row_number().over(Window.orderBy(F.desc("verdict_confidence"), F.desc(priority()), *PAIR)))
    schema = T.StructType([*ordered.schema.fields])

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, keep = set(), set(), []
        rows = rows.sort_values("place")
        for r in rows.itertuples():
            a, b = (r.supplier_a, r.a_id), (r.supplier_b, r.b_id)
            keep.append(a not in used_a and b not in used_b)
            if keep[-1]:
                used_a.add(a)
                used_b.add(b)
        return rows[pd.Series(keep, index=rows.index, dtype=bool)]

    return ordered.groupBy(F.isnull("place").alias("one")).applyInPandas(take, schema)


def promote(clusters: DataFrame, accepted: DataFrame) -> DataFrame:
    """Clusters joined by accepted pairs become one.  Its confidence and note are
    those of the verdict applied last, the least confident.  Pairs with an unknown
    end, or inside one cluster, change nothing."""
    named = clusters.withColumn("first", F.array_min(F.transform("nodes", lambda n: F.struct(n["supplier"], n["id"]).cast("struct<supplier:string,id:string>"))))
    named = named.withColumn("cid", F.concat_ws("::", "first.supplier", "first.id")).drop("first")
    owner = named.select("cid", F.explode("nodes").alias("n")).select("cid", F.col("n.supplier").alias("supplier"), F.col("n.id").alias("id"))
    a = owner.select(F.col("cid").alias("ca"), F.col("supplier").alias("supplier_a"), F.col("id").alias("a_id"))
    b = owner.select(F.col("cid").alias("cb"), F.col("supplier").alias("supplier_b"), F.col("id").alias("b_id"))
    links = accepted.join(a, ["supplier_a", "a_id"]).join(b, ["supplier_b", "b_id"]).where("ca <> cb")
    roots = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    last = links.join(roots, links["ca"] == roots["node"]).groupBy("root").agg(F.max_by(F.struct("verdict_confidence", "reason"), "place").alias("v"))
    placed = named.join(roots, named["cid"] == roots["node"], "left")
    kept = placed.where("root is null").select("nodes", "confidence", "method", "note")
    merged = placed.where("root is not null").groupBy("root").agg(F.array_sort(F.flatten(F.collect_list("nodes"))).alias("nodes")).join(last, "root")
    return kept.unionByName(merged.select("nodes", F.col("v.verdict_confidence").alias("confidence"), F.lit("llm").alias("method"), F.col("v.reason").alias("note")))


RUN = "prompt_tokens long, completion_tokens long, pairs_called long, cost_usd double"


def run_report(cases: DataFrame, cached: DataFrame, answers: DataFrame | None, accepted: DataFrame, cfg: MatchConfig = DEFAULT) -> dict:
    """What a run considered, had in its cache, asked for, found and paid.  ``answers``
    is null where nobody was asked."""
    considered, hits = cases.count(), cached.count()
    asked = answers.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("p"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("c")).first() if answers is not None else {"p": 0, "c": 0}
    cost = round(asked["p"] / 1e6 * cfg.prompt_price + asked["c"] / 1e6 * cfg.completion_price, 6)
    return {"enabled": answers is not None, "pairs_considered": considered, "cached_hit": hits, "called": considered - hits if answers is not None else 0, "new_matches": accepted.count(), "prompt_tokens": asked["p"], "completion_tokens": asked["c"], "cost_usd": cost}


def spend_summary(runs: DataFrame) -> DataFrame:
    """Totals of a log of runs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return runs.agg(total("prompt_tokens").alias("lifetime_prompt_tokens"), total("completion_tokens").alias("lifetime_completion_tokens"), total("pairs_called").alias("lifetime_pairs_adjudicated"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("lifetime_cost_usd"))
