import time

from pyspark.sql import functions as F

from canonry.plans import build
from canonry.session import counted, persist_cut
from canonry.sources import artifact

HOTELS = "id,name,address,lat,lon,stars,amenities,image_urls\n"


def test_builds_go_when_nobody_holds_them(spark, tmp_path):
    folder, out = tmp_path / "feeds", tmp_path / "layer"
    folder.mkdir()
    (folder / "a_hotels.csv").write_text(HOTELS + "A1,Crystal Castle,1 Rd,12.97,77.59,4,,\nA1,Crystal Castle,1 Rd,12.97,77.59,5,,\nA2,No place,1 Rd,,77.59,4,,\n")
    (folder / "a_rooms.csv").write_text("hotel_id,room_id,name,amenities\nA1,R1,Twin,\nA1,R1,King,\nA1,R2,King,\n")

    def builds():
        return {p.name for p in out.glob("build-*")}

    report = build.build(spark, str(folder), str(out))
    assert report.replaced == {"hotels": 1, "rooms": 1} and report.dropped == {"a": 1}
    catalog = artifact.Catalog(spark, str(out))
    assert report.counts == {name: catalog.table(name).count() for name in artifact.TABLES}
    first = builds()
    assert artifact.remove_old(spark, str(out), 0) == [] and artifact.remove_old(spark, str(tmp_path / "none")) == []
    lease = artifact.Lease(spark, str(out))
    with artifact.Lease(spark, str(out)) as held:
        assert held.path == catalog.path
        build.build(spark, str(folder), str(out), force=True)
        assert len(builds()) == 2 and artifact.remove_old(spark, str(out), 0) == []
    assert artifact.remove_old(spark, str(out), 0) == []  # the other lease
    lease.seconds = 0.01
    lease.renew()
    assert artifact.remove_old(spark, str(out), 0) == [], "the longest term counts"
    assert lease.catalog.search()["total"] == 1
    lease.release()
    assert artifact.remove_old(spark, str(out), 3600) == []  # not yet
    # Folders that were never published go by their age.
    (out / "build-begun").mkdir()
    assert artifact.remove_old(spark, str(out), 0) == sorted(first) and "build-begun" in builds()
    time.sleep(0.1)
    assert artifact.remove_old(spark, str(out), 0, 0) == ["build-begun"]
    assert artifact.Catalog(spark, str(out)).search()["total"] == 1 and len(builds()) == 1
    # A lease that ran out holds nothing.
    late = artifact.Lease(spark, str(out), 0.001)
    build.build(spark, str(folder), str(out), force=True)
    assert artifact.remove_old(spark, str(out), 0) == [late.catalog.path.rsplit("/", 1)[1]]


def test_a_lease_takes_the_newer_build(spark, tmp_path, monkeypatch):
    """A build that is published between the look at the last one and the lease."""
    out = str(tmp_path)
    publish = lambda at, b: spark.createDataFrame([(at, b)], artifact.PUBLISHED).write.mode("append").json(f"{out}/published")
    publish(1, "build-a")
    renew, done = artifact.Lease.renew, []

    def slow(self):
        if not done:
            done.append(publish(2, "build-b"))
        renew(self)

    monkeypatch.setattr(artifact.Lease, "renew", slow)
    lease = artifact.Lease(spark, out)
    assert lease.catalog.path.endswith("/build-b")
    assert {r["build"] for r in artifact._rows(spark, f"{out}/leases", artifact.HELD, "until")} == {"build-b"}


def test_counts_come_with_the_cut(spark):
    df, seen = counted(spark.range(1000).repartition(7).where(F.col("id") % 3 == 0))
    assert persist_cut(df).count() == 334 and seen.get["rows"] == 334
    df, seen = counted(spark.range(10).where("id < 0"))
    assert persist_cut(df).count() == 0 and seen.get["rows"] == 0
