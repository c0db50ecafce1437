from pyspark.sql import functions as F

from canonry.llm import urls

CASES = [
    ("http://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("https://a.example.com", "a.example.com", "", None, "allow"),
    ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("ftp://b.net/es/1://c", "b.net", "/es/1://c", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://bnet/fr/", "bnet", "/fr/", None, "allow"),
    ("http://É.net#/es/", "É.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "host string, good int")


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "own") for i, (u, *_) in enumerate(CASES)], "page_id int, url string, fit string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, outcomes(spark, [("a.org", None)])).collect()}
    assert got == {i: tuple(c[1:]) for i, c in enumerate(CASES)}


def test_columns_of_the_same_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "http://b.net/es/1", "h", "p", "r", "v", "kept")], "page_id int, url string, host string, path string, rule string, verdict string, bad string")
    (r,) = urls.judge(df, outcomes(spark, [("a.org", 1)])).collect()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["bad"]) == ("b.net", "/es/1", "net/es/", "block", "kept")


def test_reputation_shrinks(spark):
    rows = [("bad.x.org", 0)] * 60 + [("one.x.org", 0)] + [(f"h{i}.x.org", 1) for i in range(40) for _ in range(5)] + [("new.x.org", None), ("new.zz", None)]
    got = {r["host"]: r for r in urls.reputation(outcomes(spark, rows)).collect()}
    assert got["bad.x.org"]["upper"] < 0.5
    # One bad page tells less than sixty, and none tells what the parents do.
    assert got["bad.x.org"]["mean"] < got["one.x.org"]["mean"] < got["new.x.org"]["mean"] < got["h1.x.org"]["mean"]
    assert abs(got["new.zz"]["mean"] - 200 / 262) < 0.2
    judged = urls.judge(spark.createDataFrame([("http://bad.x.org/1",), ("http://one.x.org/1",)], "url string"), outcomes(spark, rows)).collect()
    assert [r["verdict"] for r in sorted(judged, key=lambda r: r["host"])] == ["block", "allow"]


def test_posteriors_agree_with_plain_arithmetic(spark):
    rows = [("a.x.org", 1)] * 3 + [("a.x.org", 0)] + [("b.x.org", 0)] * 4 + [("b.x.org", 1)] + [("c.y.org", 1)] * 6
    got = {r["host"]: r for r in urls.reputation(outcomes(spark, rows)).collect()}
    strength = {}

    def level(children):
        parents = {}
        for _, parent, g, n in children:
            a, b = parents.get(parent, (0, 0))
            parents[parent] = (a + g, b + n)
        free, total = len(children) - len(parents), sum(c[3] for c in children)
        if free <= 0 or total <= len(children):
            return 1000.0
        between = sum(n * (g / n - parents[p][0] / parents[p][1]) ** 2 for _, p, g, n in children) / free
        within = sum(n * (g / n) * (1 - g / n) for _, p, g, n in children) / (total - len(children))
        size = (total - sum(n * n / parents[p][1] for _, p, g, n in children)) / free
        if between <= within or between + (size - 1) * within <= 0:
            return 1000.0
        return min(1000.0, max(1.0, (between + (size - 1) * within) / (between - within) - 1))

    hosts = [("a.x.org", "x.org", 3, 4), ("b.x.org", "x.org", 1, 5), ("c.y.org", "y.org", 6, 6)]
    domains = [("x.org", "org", 4, 9), ("y.org", "org", 6, 6)]
    s = {"org": level([("org", 0, 10, 15)]), "domain": level(domains), "host": level(hosts)}
    m0 = 11 / 17
    m1 = (s["org"] * m0 + 10) / (s["org"] + 15)
    for d, _, g, n in domains:
        strength[d] = (s["domain"] * m1 + g) / (s["domain"] + n)
    for h, d, g, n in hosts:
        assert abs(got[h]["mean"] - (s["host"] * strength[d] + g) / (s["host"] + n)) < 1e-9


def test_empty(spark):
    none = outcomes(spark, [])
    assert urls.judge(spark.createDataFrame([], "url string"), none).count() == 0
    assert urls.judge(spark.createDataFrame([("http://a.org/",)], "url string"), none).first()["verdict"] == "allow"
    labels = spark.createDataFrame([(7, 1, None), (8, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([("http://a.org/en/7.html?x=8",), ("http://a.org/8/",), ("http://a.org/x",), (None,)], "url string")
    got = sorted((r["host"], r["good"]) for r in urls.page_outcomes(pages, labels).where(F.col("host") == "a.org").collect() if r["good"] is not None)
    assert got == [("a.org", 0), ("a.org", 1)]


def test_pages_are_counted_before_they_meet_labels(spark):
    """As a row for each page: documents that many pages show, labels given twice,
    documents without labels, pages that name none."""
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (8, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    shown = [("a.org", 7)] * 40 + [("a.org", 8)] * 3 + [("a.org", 9)] * 2 + [("b.org", 7)] + [("c.org", None)] * 30
    pages = spark.createDataFrame([(f"http://{h}/x/{'' if d is None else d}",) for h, d in shown], "url string")
    counted = urls.page_outcomes(pages, labels)
    assert counted.count() == 7  # three on a.org are labelled, one on b.org, and a row for each host
    goods = {7: [1], 8: [0, 1], 9: [None], None: [None]}
    plain = outcomes(spark, [(h, g) for h, d in shown for g in goods[d]])
    rows = [{r["host"]: r.asDict() for r in urls.reputation(x).collect()} for x in (counted, plain)]
    assert rows[0].keys() == rows[1].keys() == {"a.org", "b.org", "c.org"}
    for h, r in rows[0].items():
        assert all(abs(r[k] - rows[1][h][k]) < 1e-9 for k in ("good", "n", "a", "b", "mean", "upper"))


def test_suffixes_are_a_parameter(spark):
    df = spark.createDataFrame([("x.y.github.io",), ("a.b.co.uk",)], "h string")
    got = [tuple(r) for r in df.select(urls.domain_of(F.col("h"), ("github.io",)), urls.suffix_of(F.col("h"), ("github.io",)), urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()]
    assert got == [("y.github.io", "github.io", "github.io", "io"), ("co.uk", "uk", "b.co.uk", "co.uk")]
