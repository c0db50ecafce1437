import pytest
from pyspark.sql import functions as F

from canonry.operators import search
from canonry.plans import build
from canonry.sources import artifact, feeds
from canonry.streaming import ratelimit

HOTELS = 'id,name,address,lat,lon,stars,amenities,image_urls\n'


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("feeds"), str(tmp_path_factory.mktemp("out") / "layer")
    (folder / "a_hotels.csv").write_text(HOTELS + 'A1,Crystal Castle,"1, Lake Rd",12.97,77.59,4,Wifi|WIFI,u1|u2\nA2,OYO 77 Tom &amp; Co,2 Rd,12.99,77.60,,,\nA3,No place,3 Rd,x,77.6,3,,\nA1,Crystal Castle Inn,1 Lake Rd,12.97,77.59,4,Wifi,u1\n')
    (folder / "b_hotels.csv").write_text("name,id ,address,lat,lon,stars,amenities,image_urls\nCrystal Castle,B1,1 Lake,12.9701,77.5901,4,Bar,u3\n")
    (folder / "a_rooms.csv").write_text("hotel_id,room_id,name,amenities\nA1,R1,Deluxe King Room,2 Guests\nA1,R2,Twin Room,\nA9,R9,Orphan,\n")
    (folder / "b_rooms.csv").write_text("hotel_id,room_id,name,amenities\nB1,S1,King Deluxe Room,City view\n")
    report = build.build(spark, str(folder), out)
    return folder, out, report


def test_build(spark, built):
    folder, out, report = built
    assert report.counts["canonical_hotels"] == 2 and report.counts["canonical_rooms"] == 2 and report.counts["raw_rooms"] == 4 and report.counts["raw_hotels"] == 3
    assert build.status()["state"] == "completed"
    assert build.build(spark, str(folder), out).skipped
    assert artifact.health(spark, out) == {"status": "ok", "db": "ready"} and artifact.health(spark, out + "x")["db"] == "missing"


def test_catalog(spark, built):
    catalog = artifact.Catalog(spark, built[1])
    found = catalog.search("cryst cas")
    assert found["total"] == 1 and not found["has_more"]
    hotel = found["results"][0]
    assert hotel["id"] == "CAN-00001" and hotel["source_ids"] == {"a": "A1", "b": "B1"} and hotel["amenities"] == ["Wifi", "Bar"] and hotel["match_status"] == "matched"
    detail = catalog.detail("CAN-00001")
    assert {r["name"]: (r["bed_type"], r["view"], r["match_status"]) for r in detail["rooms"]} == {"Deluxe King Room": ("King", "City", "matched"), "Twin Room": ("Twin", None, "singleton")}
    assert detail["sources"]["b"]["name"] == "Crystal Castle" and detail["near_misses"] == []
    assert catalog.search("tom")["results"][0]["name"] == "OYO 77 Tom & Co"
    assert catalog.search("can")["total"] == 2 and catalog.search(limit=1)["has_more"]
    for odd in ("a)(b", "-", '"', "'; drop", "* OR"):
        assert catalog.search(odd)["total"] == 0
    assert catalog.search("tom", status="matched")["total"] == 0
    assert catalog.stats() == {"hotels": {"matched": 1, "singleton": 1}, "hotels_by_match_method": {"geo_fuzzy": 1, "singleton": 1}, "rooms": {"matched": 1, "singleton": 1}, "near_misses": 0}
    with pytest.raises(KeyError):
        catalog.detail("CAN-99999")
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"status": "x"}):
        with pytest.raises(ValueError):
            catalog.search(**bad)
    with pytest.raises(artifact.ArtifactMissing):
        artifact.Catalog(spark, built[1] + "x")
    nested = artifact.Catalog(spark, built[1]).documents().orderBy("id").collect()
    assert len(nested) == 2 and len(nested[0]["rooms"]) == 2 and nested[1]["near_misses"] == []


def test_adjudicated_build_keeps_what_it_paid_for(spark, tmp_path):
    import json

    folder, out = tmp_path / "feeds", str(tmp_path / "layer")
    folder.mkdir()
    (folder / "a_hotels.csv").write_text(HOTELS + "A1,Crystal Castle Lake,1 Rd,12.97,77.59,4,,u1|u2\nA2,Nowhere,1 Rd,,77.59,4,,\n")
    (folder / "b_hotels.csv").write_text(HOTELS + "B1,Crystal Fort Hill,1 Rd,12.97,77.59,1,,u3\n")
    for x in "ab":
        (folder / f"{x}_rooms.csv").write_text("hotel_id,room_id,name,amenities\n")
    asked = tmp_path / "asked"
    asked.mkdir()

    def adjudicator(prompt):
        import uuid

        (asked / uuid.uuid4().hex).write_text(prompt)
        return json.dumps({"adjudications": [{"index": 0, "same_hotel": True, "confidence": 0.8, "reason": "same"}]}), 100, 7

    side = {k: str(tmp_path / k) for k in ("verdicts", "spend", "fingerprints")}
    fetch = lambda url: {"u1": "p", "u3": "p"}.get(url)
    first = build.build(spark, str(folder), out, adjudicator=adjudicator, fetch=fetch, **side)
    assert first.dropped == {"a": 1}
    assert first.adjudication == {"enabled": True, "pairs_considered": 1, "cached_hit": 0, "called": 1, "new_matches": 1, "prompt_tokens": 100, "completion_tokens": 7, "cost_usd": 0.0}
    old = artifact.Catalog(spark, out)
    assert old.search("crystal")["results"][0]["match_method"] == "llm" and old.search("crystal")["results"][0]["image_urls"] == ["u1", "u2"]
    again = build.build(spark, str(folder), out, force=True, adjudicator=adjudicator, fetch=fetch, **side)
    assert again.adjudication["cached_hit"] == 1 and again.adjudication["called"] == 0 and len(list(asked.iterdir())) == 1
    # Readers of the first build still have it; new ones get the second.
    new = artifact.Catalog(spark, out)
    assert new.path != old.path and old.search()["total"] == new.search()["total"] == 1
    spend = feeds.side_table(spark, side["spend"], "prompt_tokens long, completion_tokens long, pairs_called long, cost_usd double")
    assert new.stats(spend)["llm_spend"] == {"lifetime_prompt_tokens": 100, "lifetime_completion_tokens": 7, "lifetime_pairs_adjudicated": 1, "lifetime_cost_usd": 0.0}
    # Without its index a build is searched by pattern.
    import shutil

    shutil.rmtree(f"{new.path}/search_terms")
    assert new.search("castle")["total"] == 1 and new.search("nothing")["total"] == 0


def test_patterns(spark):
    df = spark.createDataFrame([("1", "a\\b", ""), ("2", "ab", "a_c"), ("3", "axc", "")], "id string, name string, address string").withColumn("match_status", F.lit("matched"))
    ids = lambda q: [r["id"] for r in search.like(df, q).orderBy("id").collect()]
    assert ids("a\\b") == ["1"] and ids("A_C") == ["2", "3"] and ids("\\") == ["1"] and ids("%") == ["1", "2", "3"]


def test_feed_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    target = feeds.register(str(tmp_path), " My Feed! ", "hotels", str(tmp_path / "x.csv"))
    assert target.endswith("/myfeed_hotels.csv") and {"filename": "myfeed_hotels.csv", "size_kb": 0.0} in feeds.listed(str(tmp_path))
    with pytest.raises(feeds.FeedError):
        feeds.scan(spark, str(tmp_path), "hotels")
    for bad in (("x", "cars", "x.csv"), ("!", "hotels", "x.csv"), ("x", "hotels", "x.txt")):
        with pytest.raises(feeds.FeedError):
            feeds.register(str(tmp_path), bad[0], bad[1], str(tmp_path / bad[2]))
    feeds.remove(str(tmp_path), "myfeed_hotels.csv")
    with pytest.raises(FileNotFoundError):
        feeds.remove(str(tmp_path), "myfeed_hotels.csv")
    with pytest.raises(feeds.FeedError):
        feeds.remove(str(tmp_path), "../x.csv")
    assert feeds.supplier_name(" Café-Été_9! ") == "café-été_9"
    assert feeds.side_table(spark, str(tmp_path / "none.json"), "key string").count() == 0


def test_phrases_and_ranks(spark):
    docs = spark.createDataFrame([("1", "St.Marks Café", ""), ("2", "Marks and st", ""), ("3", "cafeteria café cafe", "")], "id string, name string, address string")
    terms = search.index_terms(docs, "id", ("id", "name", "address"))
    rank = lambda q: [r["key"] for r in search.ranked(terms, docs, "id", search.query_phrases(q, spark)).orderBy(F.desc("score"), "key").collect()]
    assert rank("st.mar") == ["1"] and rank("mar st") == ["1", "2"] and set(rank("CAFÉ")) == {"1", "3"} and rank("- cafe")[0] in ("1", "3") and rank("-") == []


def test_rate_limits(spark):
    rows = [(i, "u", f"2024-01-01 00:00:{s:02}") for i, s in enumerate((0, 1, 2, 50))] + [(9, "v", "2024-01-01 00:00:00"), (4, "u", "2024-01-01 00:01:01")]
    df = spark.createDataFrame(rows, "event_id int, user_id string, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"))
    got = {r["event_id"]: r["admitted"] for r in ratelimit.admitted(df, limit=2).collect()}
    # The first left after 60 s; the rejected ones never counted.
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 9: True}
    assert all(r["admitted"] for r in ratelimit.admitted(df, limit=0).collect())
    assert {r["event_id"]: r["offered"] for r in ratelimit.offered(df).collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 9: 1}
