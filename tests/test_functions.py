import math

import pytest
from pyspark.sql import functions as F

from canonry.functions import scores, text


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("Wifi|WIFI| wifi ", ["Wifi"]), ("a||b| ", ["a", "b"]), ("", []), (None, []), ("x|Y|y|X", ["x", "Y"])],
)
def test_pipe_list(spark, raw, want):
    assert one(spark, text.pipe_list(F.col("c").cast("string")), c=raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [("  OYO 123 Grand  Inn", "123 grand inn"), ("Oyo Rooms Plaza", "rooms plaza"), ("Treebo Trend Lake", "lake"), ("The Hosteller  X", " x"), (None, ""), ("Grand oyo", "grand oyo")],
)
def test_property_name(spark, raw, want):
    assert one(spark, text.property_name(F.col("c").cast("string")), c=raw) == want


def test_property_numbers(spark):
    assert one(spark, text.property_numbers(F.col("c")), c="OYO 123 at 7 and 45, 123 or 1234567") == ["123", "45"]


@pytest.mark.parametrize("raw,want", [(" 4.5 ", 4.5), ("n/a", None), ("NaN", None), ("", None), (None, None), ("1d", None), ("12.5f", None), ("0x1p3", None), ("1e3", 1000.0), ("+.5", 0.5), ("1.2.3", None), ("-Infinity", float("-inf"))])
def test_number(spark, raw, want):
    assert one(spark, text.number(F.col("c").cast("string")), c=raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [("Dlx Dbl w/ Brkfst", "deluxe double with breakfast"), ("Std. Non-AC Apt!", "standard non air conditioned apartment"), ("", "")],
)
def test_room_name(spark, raw, want):
    assert one(spark, text.room_name(F.col("c")), c=raw) == want


ROOMS = [
    ("Deluxe King Room", [], "King", "Room Only", None, None, "Double"),
    ("2 Bedroom Suite - City view", [], "Multiple Beds", "Room Only", "City", None, None),
    ("Suite", ["sleeps 4", "Half Board"], None, "Half Board", None, None, "Family"),
    ("Mixed Dorm Non-Smoking", ["B & B"], "Dormitory", "Breakfast", None, False, "Family"),
    ("Smoking Twin, pool", ["3 Adults"], "Twin", "Room Only", "Pool", True, "Triple"),
    ("1 Bed Apartment", ["All Inclusive", "0 guests"], "Double", "Full Board", None, None, "Family"),
    ("Sofa cum bed, sea", [], "Sofa Bed", "Room Only", None, None, None),
]


@pytest.mark.parametrize("name,amenities,bed,meal,view,smoking,occupancy", ROOMS)
def test_room_attributes(spark, name, amenities, bed, meal, view, smoking, occupancy):
    t = text.room_text(F.col("n"), F.split("a", "\\|"))
    df = spark.createDataFrame([(name, "|".join(amenities))], "n string, a string")
    got = df.select(text.bed_type(t), text.meal_plan(t), text.view(t), text.is_smoking(t), text.occupancy(t)).first()
    assert tuple(got) == (bed, meal, view, smoking, occupancy)


def test_scores(spark):
    df = spark.createDataFrame([(12.97, 77.59, 12.98, 77.60)], "a double, b double, c double, d double")
    got = df.select(scores.haversine_km(*map(F.col, "abcd"))).first()[0]
    p = math.sin(math.radians(0.01) / 2) ** 2 + math.cos(math.radians(12.97)) * math.cos(math.radians(12.98)) * math.sin(math.radians(0.01) / 2) ** 2
    assert got == pytest.approx(2 * 6371 * math.asin(math.sqrt(p)))
    assert one(spark, scores.decay(F.col("k"), 0.15), k=0.15) == pytest.approx(0.5)
    stars = spark.createDataFrame([(4.0, 4.0, 1.0), (4.0, 3.0, 0.5), (5.0, 1.0, 0.0), (None, 3.0, 0.0)], "a double, b double, w double")
    assert all(r[0] == r[1] for r in stars.select(scores.stars_score(F.col("a"), F.col("b")), "w").collect())
    assert one(spark, scores.stretch(F.col("s")), s=0.875) == pytest.approx(0.5) and one(spark, scores.stretch(F.col("s")), s=0.2) == 0
    sets = spark.createDataFrame([(["a", "b"], ["b", "a"], 1.0), (["a"], [], 0.0), ([], [], 0.0)], "a array<string>, b array<string>, w double")
    assert all(r[0] == r[1] for r in sets.select(scores.dice(F.col("a"), F.col("b")), "w").collect())


def test_folding_and_html(spark):
    assert one(spark, text.search_terms(F.col("c")), c="Café St.Marks-Õ 12") == ["cafe", "st", "marks", "o", "12"]
    df = spark.createDataFrame([("  A &amp;#39; &eacute; ",), (None,)], "c string")
    assert [r[0] for r in df.select(text.unescape_html("c")).collect()] == ["A &#39; é", None]


def test_white_space_of_any_kind_is_stripped(spark):
    rows = [("\tOYO 123 Inn\n", "\u00a0x |\ty\u2003| X\n|\u2003", "\n 4.5\t")]
    df = spark.createDataFrame(rows, "name string, items string, n string")
    (r,) = df.select(text.property_name(F.col("name")).alias("p"), text.pipe_list(F.col("items")).alias("l"), text.number(F.col("n")).alias("n")).collect()
    assert (r["p"], r["l"], r["n"]) == ("123 inn", ["x", "y"], 4.5)
