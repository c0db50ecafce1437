"""Every query of the engine over the driver's tables, with its SQL form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canonry.config import DEFAULT as CFG
from canonry.functions import scores, text
from canonry.operators import adjudicate, candidates, lasting, matching, merge, postings, rooms, search, vectors
from canonry.plans import build, incremental, synthetic
from canonry.session import persist_cut, scratch, tabled
from canonry.streaming import ratelimit


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic records with lists of amenities and image urls."""
    words = F.split("name", " ")
    return synthetic.feeds(spark, d).withColumns({"amenities": words, "image_urls": F.transform(words, lambda w: F.concat(F.lit("img/"), F.lower(w)))})


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return candidates.scored_edges(synthetic.feeds(spark, d))


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return candidates.valid_edges(_edges(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("dist_km", "geo_score", "name_score", "stars_score", "confidence")})


def _isolated(spark: SparkSession, d: str) -> DataFrame:
    return matching.isolated_edges(_valid(spark, d))[0]


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.max_weight_matching(persist_cut(_valid(spark, d)))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All edges, and the matched ones."""
    edges = persist_cut(_edges(spark, d))
    return edges, persist_cut(matching.max_weight_matching(candidates.valid_edges(edges)))


def _clusters_of(spark: SparkSession, d: str, matched: DataFrame) -> DataFrame:
    """Clusters of all records, known by their first node."""
    made = matching.clusters(synthetic.feeds(spark, d).select("supplier", "id"), matched)
    return made.withColumn("canonical_id", F.col("nodes")[0]["id"])


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters_of(spark, d, persist_cut(_matched(spark, d)))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return merge.canonical_properties(_clusters(spark, d), _records(spark, d))


def _near_of(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges but the matched ones, rounded as they are kept."""
    return matching.near_misses(edges, matched).withColumns({c: F.round(c, 4) for c in ("confidence", "geo_score", "name_score", "stars_score", "dist_km")})


def _near(spark: SparkSession, d: str) -> DataFrame:
    return _near_of(*_graph(spark, d))


def _hard_of(edges: DataFrame, matched: DataFrame) -> DataFrame:
    return adjudicate.hard_cases(_near_of(edges, matched), matching._ends(matched).distinct())


def _hard(spark: SparkSession, d: str) -> DataFrame:
    return _hard_of(*_graph(spark, d))


def _verdicts(cases: DataFrame) -> DataFrame:
    """Verdicts that depend on the pair alone, for want of a model."""
    key = adjudicate.pair_key()
    x = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")
    return cases.select(key.alias("key"), (x % 3 == 0).alias("same_hotel"), (x % 100 / 100.0).alias("confidence"), F.lit("by key").alias("reason"))


def _judged_of(edges: DataFrame, matched: DataFrame) -> DataFrame:
    cases = persist_cut(_hard_of(edges, matched))
    return adjudicate.with_cached(cases, _verdicts(cases))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return _judged_of(*_graph(spark, d))


def _layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw_rooms = _room_rows(spark, d)
    return build.layers(_records(spark, d), raw_rooms)


def _room_rows(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.rooms(spark, d).withColumn("amenities", text.pipe_list(F.col("amenities_raw"))).drop("amenities_raw")


def _placed_rooms(spark: SparkSession, d: str) -> DataFrame:
    return rooms.of_clusters(_room_rows(spark, d), _clusters(spark, d))


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


# -- queries ------------------------------------------------------------------


def feed_union(spark, d):
    return synthetic.feeds(spark, d).select("supplier", "id", "name", "address", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "stars")


def name_normalize(spark, d):
    return synthetic.feeds(spark, d).select("id", text.property_name(F.col("name")).alias("normal"))


def property_numbers(spark, d):
    return synthetic.feeds(spark, d).select("id", F.array_join(text.property_numbers(F.col("name")), ",").alias("numbers"))


def pipe_list_dedupe(spark, d):
    return synthetic.rooms(spark, d).select("room_id", F.array_join(text.pipe_list(F.col("amenities_raw")), "|").alias("amenities"))


def numeric_coerce_drop(spark, d):
    raw = _table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("n/a")).when(F.col("p_partkey") % 7 == 0, F.lit("NaN")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "))).alias("raw"))
    return raw.withColumn("value", text.number(F.col("raw"))).where("value is not null").select("p_partkey", "value")


def html_unescape_titles(spark, d):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return _table(spark, d, "pages").select("page_id", text.unescape_html(title).alias("title"))


def room_attributes(spark, d):
    whole = text.room_text(F.col("name"), F.col("amenities"))
    return _room_rows(spark, d).select("room_id", text.bed_type(whole).alias("bed_type"), text.meal_plan(whole).alias("meal_plan"), text.view(whole).alias("view"), text.is_smoking(whole).alias("is_smoking"))


def room_occupancy(spark, d):
    return _room_rows(spark, d).select("room_id", text.occupancy(text.room_text(F.col("name"), F.col("amenities"))).alias("occupancy"))


def room_name_normalize(spark, d):
    return synthetic.rooms(spark, d).select("room_id", text.room_name(F.col("name")).alias("normal"))


def haversine_pairs(spark, d):
    near = candidates.within(synthetic.feeds(spark, d).select("id", "lat", "lon"), CFG.max_km, once=True)
    return near.select(F.least("u_id", "v_id").alias("a_id"), F.greatest("u_id", "v_id").alias("b_id"), F.round("dist_km", 6).alias("dist_km"))


def topk_before_supplier_filter(spark, d):
    return candidates.best_candidates(candidates.prepared(synthetic.feeds(spark, d))).select(F.col("u_id").alias("a_id"), F.col("v_id").alias("b_id"), "rank", F.round("name_score", 6).alias("name_score"))


def scored_edges(spark, d):
    return _rounded(_edges(spark, d))


def semantic_edges(spark, d):
    """Edges by embeddings that the feeds bring: records of one truth have one vector."""
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    n = v.count()
    own = synthetic.feeds(spark, d).join(v, F.pmod("truth_key", F.lit(n)) == F.col("k"))
    return _rounded(candidates.scored_edges(own, scorer=candidates.cosine_scorer("embedding")))


def ngram_edges(spark, d):
    """Edges of feeds with misspelt names, by weighted n-grams."""
    own = synthetic.misspelt(spark, d)
    return _rounded(candidates.scored_edges(own, scorer=candidates.ngram_scorer(own)))


def ngram_room_pairs(spark, d):
    """Pairs of a cluster's rooms by weighted n-grams of their names."""
    own = _room_rows(spark, d)
    scorer = candidates.ngram_scorer(own, text.room_name)
    placed = rooms.of_clusters(own, _clusters(spark, d), scorer)
    return rooms.scored_pairs(placed, scorer=scorer).withColumn("confidence", F.round("confidence", 6))


def valid_edges(spark, d):
    return _rounded(_valid(spark, d))


def vector_topk(spark, d):
    """Per vector its five most similar of the other supplier, the parity of the id."""
    v = _table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.pmod("vec_id", F.lit(2)).alias("supplier"))
    return vectors.nearest(v.withColumn("supplier", 1 - F.col("supplier")), v, 5, "supplier")


def similarity_stretch(spark, d):
    v = _table(spark, d, "embeddings")
    pair = v.select((F.col("vec_id") + 1).alias("next"), F.col("embedding").alias("e")).join(v, F.col("next") == F.col("vec_id"))
    return pair.select("vec_id", F.round(scores.stretch((scores.cosine(F.col("e"), F.col("embedding")) + 1) / 2), 5).alias("stretched"))


def isolated_edge_matching(spark, d):
    return _rounded(_isolated(spark, d))


def dominant_edges(spark, d):
    """Edges that every best matching has, by the first round of reductions."""
    own = _valid(spark, d).withColumns({"u": F.concat_ws("::", "supplier_a", "a_id"), "v": F.concat_ws("::", "supplier_b", "b_id")})
    return matching.dominant(persist_cut(own.withColumn("weight", F.round(F.col("confidence") * matching.SCALE).cast("long"))))


def max_weight_matching(spark, d):
    return _rounded(_matched(spark, d))


def clusters(spark, d):
    nodes = synthetic.feeds(spark, d).select("supplier", "id")
    made = merge.with_ids(matching.clusters(nodes, _matched(spark, d)))
    return made.select("canonical_id", F.array_join(F.transform("nodes", lambda n: n["id"]), "|").alias("nodes"), F.round("confidence", 4).alias("confidence"), "method")


def singletons(spark, d):
    return matching.unmatched(synthetic.feeds(spark, d).select("supplier", "id"), _matched(spark, d))


def near_misses(spark, d):
    return _near(spark, d)


def hard_cases(spark, d):
    return _hard(spark, d).select(*matching.PAIR, "geo_score", "name_score")


def verdict_cache_join(spark, d):
    return _judged(spark, d).select("key", "same_hotel", "verdict_confidence")


def llm_batches(spark, d):
    return adjudicate.batches(persist_cut(_hard(spark, d))).select("a_id", "b_id", "batch", "index")


def prompt_lines(spark, d):
    return adjudicate.prompt_lines(adjudicate.batches(persist_cut(_hard(spark, d))), synthetic.feeds(spark, d))


def prompts(spark, d):
    return adjudicate.prompts(prompt_lines(spark, d))


def greedy_one_to_one(spark, d):
    return adjudicate.greedy_one_to_one(_judged(spark, d)).select(*matching.PAIR, "verdict_confidence")


def promote(spark, d):
    nodes = synthetic.feeds(spark, d).select("supplier", "id")
    edges, matched = _graph(spark, d)
    accepted = persist_cut(adjudicate.greedy_one_to_one(_judged_of(edges, matched)))
    made = adjudicate.promote(matching.clusters(nodes, matched), accepted)
    return made.select(F.array_join(F.transform("nodes", lambda n: n["id"]), "|").alias("nodes"), F.round("confidence", 4).alias("confidence"), "method", "note")


def spend_summary(spark, d):
    runs = _table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("prompt_tokens"), (F.col("o_custkey") % 100).alias("completion_tokens"), F.lit(20).alias("pairs_called"), F.lit(0.0).alias("cost_usd"))
    return adjudicate.spend_summary(runs)


def merge_name_longest(spark, d):
    return _canonical(spark, d).select("id", "name", "address")


def merge_avg(spark, d):
    return _canonical(spark, d).select("id", "lat", "lon", "stars")


def merge_list_union(spark, d):
    return _canonical(spark, d).select("id", _joined("amenities"))


def source_map(spark, d):
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("source_ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _canonical(spark, d).select("id", entries.alias("source_ids"), "match_status", "match_method")


def canonical_ids(spark, d):
    nodes = synthetic.feeds(spark, d).select("supplier", "id")
    made = merge.with_ids(matching.clusters(nodes, persist_cut(_matched(spark, d))))
    return made.select("canonical_id", F.array_min(F.transform("nodes", lambda n: n["id"])).alias("first_id"), "method")


def incremental_matching(spark, d):
    """The matching of a build that went on from one of earlier feeds."""
    with scratch(spark) as path:
        incremental.full(spark, synthetic.earlier(spark, d), path, degrees=0.05)
        state, _ = incremental.update(spark, synthetic.feeds(spark, d), path, degrees=0.05)
        return persist_cut(_rounded(state.read("matched").drop("tile")))


def _lasting(spark, d):
    """Clusters with ids that go on from those of earlier feeds, and what changed."""
    before = synthetic.earlier(spark, d)
    matched = matching.max_weight_matching(persist_cut(candidates.valid_edges(candidates.scored_edges(before))))
    known = merge.members(merge.with_ids(matching.clusters(before.select("supplier", "id"), persist_cut(matched)))).select("supplier", "id", "canonical_id")
    now = matching.clusters(synthetic.feeds(spark, d).select("supplier", "id"), persist_cut(_matched(spark, d)))
    return lasting.lasting_ids(now, known)


def lasting_ids(spark, d):
    return _lasting(spark, d)[0].select("canonical_id", F.array_join(F.transform("nodes", lambda n: n["id"]), "|").alias("nodes"))


def id_history(spark, d):
    return _lasting(spark, d)[1]


def near_miss_attach(spark, d):
    edges, matched = _graph(spark, d)
    return merge.attach_near_misses(_near_of(edges, matched), _clusters_of(spark, d, matched))


def image_dedupe(spark, d):
    """Documents stand for images: a source's list of them, by content."""
    docs = _table(spark, d, "documents").where("text is not null")
    url = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    lists = docs.groupBy("source").agg(F.sort_array(F.collect_list(url)).alias("urls"))
    prints = docs.select(url.alias("url"), F.concat_ws(":", F.octet_length("text").cast("string"), F.md5("text")).alias("fingerprint"))
    return merge.dedupe_by_content(lists, "source", "urls", prints).select("source", F.size("urls").cast("long").alias("n"), F.md5(F.array_join("urls", "|")).alias("urls_md5"))


def room_pairs_scored(spark, d):
    return rooms.scored_pairs(_placed_rooms(spark, d)).withColumn("confidence", F.round("confidence", 6))


def room_matching(spark, d):
    return rooms.match(persist_cut(rooms.scored_pairs(_placed_rooms(spark, d)))).withColumn("confidence", F.round("confidence", 6))


def canonical_rooms(spark, d):
    placed = persist_cut(_placed_rooms(spark, d))
    made = rooms.canonical_rooms(placed, rooms.match(persist_cut(rooms.scored_pairs(placed))))
    return made.drop("source_room_ids", "source_names").withColumn("amenities", F.array_join("amenities", "|"))


def canonical_hotels(spark, d):
    made = _layers(spark, d)["canonical_hotels"]
    return made.drop("source_ids").withColumns({"amenities": F.array_join("amenities", "|"), "image_urls": F.array_join("image_urls", "|")})


def _documents_as_records(spark, d):
    return _table(spark, d, "documents").select(F.format_string("DOC-%09d", "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("name"), F.coalesce("source", F.lit("")).alias("address"))


QUERY = "the ofth"


def fts_search(spark, d):
    """Rows that hold every term of a query, the last letters free."""
    own = _documents_as_records(spark, d)
    terms = search.index_terms(own, "id", ("id", "name", "address"))
    return search.ranked(terms, own, "id", search.query_phrases(QUERY, spark)).select("key")


def fts_rank(spark, d):
    own = _documents_as_records(spark, d)
    terms = persist_cut(search.index_terms(own, "id", ("id", "name", "address")))
    lengths = persist_cut(search.index_lengths(own, "id"))
    return search.ranked(terms, own, "id", search.query_phrases(QUERY, spark), lengths).select("key", F.round("score", 6).alias("score"))


def fts_top20(spark, d):
    """The first page of ``fts_rank`` from blocks, most of which are never scored."""
    own = _documents_as_records(spark, d)
    size = 64
    numbered = persist_cut(postings.numbers(own, "id"))
    # A table: terms are looked up in it, several times.
    blocks = tabled(postings.term_blocks(own, numbered, "id", size=size))
    return postings.top(blocks, numbered, search.query_phrases(QUERY, spark), 20, size, 2).select("key", F.round("score", 6).alias("score"))


def like_trigrams(spark, d):
    """``like_fallback`` by a trigram index."""
    own = persist_cut(_canonical(spark, d))
    numbered = persist_cut(postings.numbers(own, "id"))
    grams = persist_cut(postings.gram_blocks(own, numbered, "id"))
    return search.like_total(own, "road", 50, 5, None, postings.may_match(grams, numbered, "road"))[1].select("id", "name")


def like_fallback(spark, d):
    return search.like(_canonical(spark, d), "road", 50, 5).select("id", "name")


def list_page(spark, d):
    return search.search(_canonical(spark, d), "", 20, 40, "matched")[1].select("id", "name")


def near_miss_top10(spark, d):
    return search.top_near_misses(near_miss_attach(spark, d), synthetic.feeds(spark, d))


def hotel_detail(spark, d):
    made = {k: persist_cut(v) for k, v in _layers(spark, d).items()}
    out = search.detail(made["canonical_hotels"], made["raw_hotels"], made["canonical_rooms"], made["raw_rooms"], made["near_misses"])
    return out.select("id", "name", F.size("sources").alias("n_sources"), F.size("rooms").alias("n_rooms"), F.size("near_misses").alias("n_near_misses"), F.to_json("rooms").alias("rooms"), F.to_json("near_misses").alias("near_misses"))


def stats_by_status(spark, d):
    return search.counts(_cluster_stats(spark, d), "match_status")


def stats_by_method(spark, d):
    return search.counts(_cluster_stats(spark, d), "match_method")


def _cluster_stats(spark, d):
    return _clusters(spark, d).select(F.when(F.size("nodes") > 1, "matched").otherwise("singleton").alias("match_status"), F.col("method").alias("match_method"), "confidence")


def confidence_bands(spark, d):
    return search.counts(_cluster_stats(spark, d).where("match_status = 'matched'").select(search.confidence_band(F.round("confidence", 4)).alias("band")), "band")


def match_rate(spark, d):
    return search.match_rate(_cluster_stats(spark, d))


def rate_limit_offered(spark, d):
    return ratelimit.offered(_table(spark, d, "events").select("event_id", "user_id", "ts"), seconds=86400).select("event_id", F.col("offered").cast("long").alias("offered"))


def rate_limit_admitted(spark, d):
    return ratelimit.admitted(_table(spark, d, "events").select("event_id", "user_id", "ts"), limit=2, seconds=86400).select("event_id", "admitted")


_OWN = (
    feed_union, name_normalize, property_numbers, pipe_list_dedupe, numeric_coerce_drop, html_unescape_titles, room_attributes, room_occupancy, room_name_normalize,
    haversine_pairs, topk_before_supplier_filter, scored_edges, semantic_edges, ngram_edges, ngram_room_pairs, valid_edges, vector_topk, similarity_stretch, isolated_edge_matching, dominant_edges, max_weight_matching, clusters, singletons, near_misses,
    hard_cases, verdict_cache_join, llm_batches, prompt_lines, prompts, greedy_one_to_one, promote, spend_summary,
    merge_name_longest, merge_avg, merge_list_union, source_map, canonical_ids, incremental_matching, lasting_ids, id_history, near_miss_attach, image_dedupe,
    room_pairs_scored, room_matching, canonical_rooms, canonical_hotels, fts_search, fts_rank, fts_top20, like_trigrams, like_fallback, list_page, near_miss_top10, hotel_detail,
    stats_by_status, stats_by_method, confidence_bands, match_rate, rate_limit_offered, rate_limit_admitted,
)


def queries() -> dict:
    return {f.__name__: f for f in _OWN}
