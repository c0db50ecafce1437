import pytest

from canonry.sources import feeds


def hotels(folder, supplier, text):
    (folder / f"{supplier}_hotels.csv").write_text(text)


def test_one_scan_for_any_number_of_files(spark, tmp_path):
    names = ["id", "name", "address", "lat", "lon", "stars", "amenities", "image_urls"]

    def write(i):
        turned = names[i % 8 :] + names[: i % 8]
        head = [" extra "] * (i % 3) + turned
        row = lambda k: ["?"] * (i % 3) + [f'"{c} {i}, {k}\nof ""two"" lines"' for c in turned]
        hotels(tmp_path, f"s{i}", "\n".join(",".join(x) for x in (head, row(1), row(2))) + "\n")

    def nodes(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("\n")

    for i in range(2):
        write(i)
    few = nodes(feeds.scan(spark, str(tmp_path), "hotels"))
    for i in range(2, 30):
        write(i)
    df = feeds.scan(spark, str(tmp_path), "hotels")
    assert nodes(df) == few
    got = df.collect()
    assert sorted((r["supplier"], *(r[c] for c in names)) for r in got) == sorted((f"s{i}", *(f'{c} {i}, {k}\nof "two" lines' for c in names)) for i in range(30) for k in (1, 2))
    line = {(r["supplier"], r["id"].split()[2]): r["line"] for r in got}
    assert all(line[f"s{i}", "1"] < line[f"s{i}", "2"] for i in range(30))


def test_files_of_odd_shape(spark, tmp_path):
    head = "id,name,address,lat,lon,stars,amenities,image_urls"
    hotels(tmp_path, "none", head + "\n")
    hotels(tmp_path, "bom", "﻿" + head + "\n1,a,b,1,2,3,x,y\n")
    hotels(tmp_path, "short", "\r\n" + head + "\r\n2,only\r\n3,a,b,1,2,3,x,y,too,many\r\n")
    hotels(tmp_path, "same", head + "\n4,a\n4,a\n")
    (tmp_path / "x_rooms.csv").write_text("other")
    got = sorted((r["supplier"], r["id"], r["name"], r["image_urls"]) for r in feeds.scan(spark, str(tmp_path), "hotels").collect())
    assert got == [("bom", "1", "a", "y"), ("same", "4", "a", ""), ("same", "4", "a", ""), ("short", "2", "only", ""), ("short", "3", "a", "y")]
    for i, (bad, why) in enumerate((("id,name\n1,2\n", "no column address"), (head + ",name\n", "more than one column name"), ('"id\n",' + head + "\n", "several lines"))):
        folder = tmp_path / f"bad{i}"
        folder.mkdir()
        hotels(folder, "fine", head + "\n")
        hotels(folder, "bad", bad)
        with pytest.raises(feeds.FeedError, match=why):
            feeds.scan(spark, str(folder), "hotels")
    # A file without a byte is no feed yet.
    hotels(tmp_path / "bad0", "bad", "")
    assert feeds.scan(spark, str(tmp_path / "bad0"), "hotels").count() == 0
    with pytest.raises(feeds.FeedError, match="no "):
        feeds.scan(spark, str(tmp_path / "bad0"), "rooms")
