"""Full-text search, listing, detail and statistics over canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonry.config import DEFAULT, MatchConfig
from canonry.functions import text

# Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
STATUSES = ("matched", "singleton")
#: What is searched.
COLUMNS = ("id", "name", "address")
MOST_ROWS = 200


def index_terms(docs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The inverted index: ``key``, ``term``, ``col``, ``pos``."""
    each = F.array(*(F.struct(F.lit(i).alias("col"), text.search_terms(F.col(c)).alias("terms")) for i, c in enumerate(columns)))
    return docs.select(F.col(key).alias("key"), F.explode(each).alias("c")).select("key", F.col("c.col").alias("col"), F.posexplode("c.terms").alias("pos", "term")).select("key", "term", "col", "pos")


def index_lengths(docs: DataFrame, key: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``key`` and ``len``, the number of its terms, of every row."""
    return docs.select(F.col(key).alias("key"), sum((F.size(text.search_terms(F.col(c))) for c in columns), F.lit(0)).cast("long").alias("len"))


def query_phrases(query: str, spark) -> list[list[str]]:
    """Phrases of a query: its words, each cut into terms; words without any are
    left out.  The last term of a phrase is a prefix."""
    words = query.split()
    if not words:
        return []
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r["t"] for r in frame.select("i", text.search_terms(F.col("w")).alias("t")).orderBy("i").collect() if r["t"]]


def phrase_hits(terms: DataFrame, phrase: list[str]) -> DataFrame:
    """``key`` and how often the phrase stands in it."""
    *whole, last = phrase
    hits = None
    for i, t in enumerate(whole):
        own = terms.where(F.col("term") == t).select("key", "col", (F.col("pos") - i).alias("pos"))
        hits = own if hits is None else hits.join(own, ["key", "col", "pos"])
    end = terms.where(F.col("term").startswith(last)).select("key", "col", (F.col("pos") - len(whole)).alias("pos"))
    hits = end if hits is None else hits.join(end, ["key", "col", "pos"])
    return hits.groupBy("key").agg(F.count("*").alias("f"))


def ranked(terms: DataFrame, docs: DataFrame, key: str, phrases: list[list[str]], lengths: DataFrame | None = None) -> DataFrame:
    """``key`` and ``score`` (greater is better) of rows that hold all phrases;
    ``lengths`` as a build has kept them, else counted."""
    if not phrases:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).where(F.lit(False))
    # Two scalars describe the whole collection.
    lengths = index_lengths(docs, key) if lengths is None else lengths
    whole = lengths.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    out = None
    for p in phrases:
        hits = phrase_hits(terms, p)
        n = hits.agg(F.count("*").alias("n"))
        scored = hits.join(lengths, "key").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(whole))
        idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
        mean = F.col("total") / F.col("docs")
        score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / mean))
        one = scored.select("key", score.alias("s"))
        out = one.select("key", F.col("s").alias("score")) if out is None else out.join(one, "key").select("key", (F.col("score") + F.col("s")).alias("score"))
    return out


def checked(limit: int, offset: int, status: str | None) -> None:
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if status is not None and status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")


def of_status(df: DataFrame, status: str | None) -> DataFrame:
    return df if status is None else df.where(F.col("match_status") == status)


def search(canonical: DataFrame, query: str, limit: int = 20, offset: int = 0, status: str | None = None, terms: DataFrame | None = None, lengths: DataFrame | None = None) -> tuple[int, DataFrame]:
    """Total and one page: best matches first, ties by id; all rows by id where
    the query is blank."""
    checked(limit, offset, status)
    if not query.strip():
        own = of_status(canonical, status)
        return own.count(), own.orderBy("id").offset(offset).limit(limit)
    index = terms if terms is not None else index_terms(canonical, "id", COLUMNS)
    hits = ranked(index, canonical, "id", query_phrases(query, canonical.sparkSession), lengths)
    own = of_status(canonical.join(hits, canonical["id"] == hits["key"]).drop("key"), status)
    return own.count(), own.orderBy(F.desc("score"), "id").offset(offset).limit(limit).drop("score")


def like(canonical: DataFrame, query: str, limit: int = 20, offset: int = 0, status: str | None = None) -> DataFrame:
    """One page of ``like_total``."""
    return like_total(canonical, query, limit, offset, status)[1]


def like_total(canonical: DataFrame, query: str, limit: int = 20, offset: int = 0, status: str | None = None, among: DataFrame | None = None) -> tuple[int, DataFrame]:
    """Total and one page of a substring search, by name; ``%`` and ``_`` stand for
    anything, as in patterns, a backslash for itself.  Only rows of ``among`` (key, as
    ``postings.may_match`` finds them by trigrams) are looked at, if it is given."""
    checked(limit, offset, status)
    canonical = canonical if among is None else canonical.join(among, canonical["id"] == among["key"], "left_semi")
    pattern = "%" + query.replace("\\", "\\\\") + "%"
    own = of_status(canonical, status).where(F.col("name").ilike(pattern) | F.col("address").ilike(pattern))
    return own.count(), own.orderBy("name", "id").offset(offset).limit(limit)


def has_more(total: int, offset: int, returned: int) -> bool:
    return offset + returned < total


def top_near_misses(near: DataFrame, records: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Per canonical record its best near misses, with the candidate's names."""
    rank = F.row_number().over(Window.partitionBy("canonical_hotel_id").orderBy(F.desc("confidence"), "candidate_supplier", "candidate_id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= cfg.near_misses_shown)
    names = records.select(F.col("supplier").alias("candidate_supplier"), F.col("id").alias("candidate_id"), "name", "address")
    return best.join(names, ["candidate_supplier", "candidate_id"], "left").select("canonical_hotel_id", "rank", "candidate_supplier", "candidate_id", "confidence", "geo_score", "name_score", F.coalesce("name", F.lit("")).alias("candidate_name"), F.coalesce("address", F.lit("")).alias("candidate_address"))


def gathered(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Rows of each key as an array of structs."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(out))


def detail(canonical: DataFrame, records: DataFrame, rooms: DataFrame, raw_rooms: DataFrame, near: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Everything about a canonical record in one nested row."""
    raw = records.select("supplier", "id", F.struct("id", "name", "address", "lat", "lon", "stars", "amenities", "image_urls").alias("raw"))
    sources = canonical.select(F.col("id").alias("cid"), F.explode("source_ids").alias("supplier", "id")).join(raw, ["supplier", "id"], "left")
    by_supplier = sources.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("supplier", "raw"))).alias("sources"))
    raw_room = raw_rooms.select("supplier", "room_id", F.struct("room_id", "name", "amenities").alias("raw"))
    room_sources = rooms.select("id", F.explode("source_room_ids").alias("supplier", "room_id")).join(raw_room, ["supplier", "room_id"], "left").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("supplier", "raw"))).alias("sources"))
    full_rooms = rooms.join(room_sources, "id", "left").drop("source_room_ids", "source_names")
    own_rooms = full_rooms.groupBy("canonical_hotel_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in full_rooms.columns if c not in ("id", "canonical_hotel_id")])), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("rooms"))
    best = gathered(top_near_misses(near, records, cfg), "canonical_hotel_id", ["rank"], "near_misses")
    out = canonical.join(by_supplier, canonical["id"] == by_supplier["cid"], "left").drop("cid")
    out = out.join(own_rooms, out["id"] == own_rooms["canonical_hotel_id"], "left").drop("canonical_hotel_id")
    out = out.join(best, out["id"] == best["canonical_hotel_id"], "left").drop("canonical_hotel_id")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({"rooms": empty("rooms"), "near_misses": empty("near_misses")})


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def match_rate(canonical: DataFrame) -> DataFrame:
    matched = F.sum(F.when(F.col("match_status") == "matched", 1).otherwise(0))
    return canonical.agg(F.count("*").alias("total"), F.coalesce(matched, F.lit(0)).alias("matched"), F.round(F.try_divide(matched, F.count("*")), 6).alias("match_rate"))
