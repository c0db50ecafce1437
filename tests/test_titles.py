"""Titles, and the SQL that they are held against."""

from pyspark.sql import SparkSession

import __spark_entry__ as entry

TITLES = [
    "a &amp;&amp b &amp", "&lt;b&gt; &quot;x&#39;", "caf&eacute; caf&eacute &eacutex &notit; &notin; &nosuch; &a; & &; &#", "&#8364; &#128; &#x80 &#0; &#xD800; &#x110000; &#99999999999999999999; &#1; &#xFFFE; &#000065;", "&amp;lt; twice",
    " &nbsp; both ends  ", "&NotEqualTilde; two code points", "", "   ", "two\nlines", "a b", "it's &apos;", "&ampx;y &copy2", "&" + "x" * 40, "&#x;", "&#xg",
]


def test_sql_states_all_references(spark: SparkSession, tmp_path):
    import duckdb

    rows = [(i, f"<html><title>{t}</title></html>") for i, t in enumerate(TITLES)] + [(98, "no title"), (99, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in entry.queries()["html_unescape_titles"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        want = dict(db.execute(entry.oracle_sql()["html_unescape_titles"]).fetchall())
    assert got == want and got[0] == "a && b &"
