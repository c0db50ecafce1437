"""Supplier feeds: discovery, scanning, cleaning, registration."""

from __future__ import annotations

import csv
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonry.functions import text

PROPERTY_COLUMNS = ("id", "name", "address", "lat", "lon", "stars", "amenities", "image_urls")
ROOM_COLUMNS = ("hotel_id", "room_id", "name", "amenities")
KINDS = {"hotels": PROPERTY_COLUMNS, "rooms": ROOM_COLUMNS}


class FeedError(ValueError):
    """A feed that can't be taken or read."""


def headers(spark: SparkSession, folder: str, kind: str) -> list[tuple[str, str, list[int]]]:
    """Path, supplier and places of the kind's columns, of each file.  The driver gets
    the first line of each file, no more."""
    suffix = f"_{kind}.csv"
    named = spark.read.option("pathGlobFilter", f"*{suffix}")
    files = named.format("binaryFile").load(folder).select("_metadata.file_path", "_metadata.file_name")
    lines = named.text(folder).select("_metadata.file_path", "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("at"))
    first = lines.where("file_block_start = 0 and value <> ''").groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    out = []
    for f in files.join(first, "file_path", "left").orderBy("file_path").collect():
        header = (f["header"] or "").lstrip("\ufeff")
        if header.count('"') % 2:
            raise FeedError(f"{f['file_path']} has a header of several lines")
        cells = [c.strip() for c in next(csv.reader([header]), [])]
        for problem, columns in (("no", [c for c in KINDS[kind] if c not in cells]), ("more than one", [c for c in KINDS[kind] if cells.count(c) > 1])):
            if columns:
                raise FeedError(f"{f['file_path']} has {problem} column {', '.join(columns)}")
        out.append((f["file_path"], f["file_name"][: -len(suffix)], [cells.index(c) for c in KINDS[kind]]))
    if not out:
        raise FeedError(f"no *{suffix} in {folder}")
    return out


def scan(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All feeds of a kind in one frame of strings, with ``supplier`` from the
    file's name and ``line``, its place in the file.  One scan reads all files by
    place; where a file has which column is looked up in a broadcast row for each
    file, so the plan is the same for any number of feeds.  Headers may differ in
    order and have other columns; what a short row leaves out is empty, and a file
    without a byte has no rows."""
    found = headers(spark, folder, kind)
    cells = [f"c{i}" for i in range(1 + max(max(places) for _, _, places in found))]
    # The schema goes by place, and each file's own header is passed over.
    lines = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("pathGlobFilter", f"*_{kind}.csv").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    rows = lines.csv(folder).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.array(*cells).alias("cells"))
    known = spark.createDataFrame(found, "path string, supplier string, places array<int>")
    values = (F.coalesce(F.get("cells", F.get("places", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(KINDS[kind]))
    return rows.join(F.broadcast(known), "path").select("supplier", "line", *values)


def clean_properties(raw: DataFrame) -> DataFrame:
    """Typed records; those without coordinates go."""
    made = raw.withColumns(
        {
            "name": text.unescape_html("name"),
            "address": text.unescape_html("address"),
            "lat": text.number(F.col("lat")),
            "lon": text.number(F.col("lon")),
            "stars": text.number(F.col("stars")),
            "amenities": text.pipe_list(F.col("amenities")),
            "image_urls": text.pipe_list(F.col("image_urls")),
        }
    )
    return made.where("lat is not null and lon is not null")


def clean_rooms(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"name": text.stripped(F.col("name")), "amenities": text.pipe_list(F.col("amenities"))})


def supplier_name(name: str) -> str:
    clean = "".join(c for c in name.strip().lower() if c.isalnum() or c in "_-")
    if not clean:
        raise FeedError("a supplier's name needs letters or digits")
    return clean


def register(folder: str, supplier: str, kind: str, source: str) -> str:
    """Take a .csv or .xlsx file as a supplier's feed, in place of any before."""
    if kind not in KINDS:
        raise FeedError(f"kind must be one of {', '.join(KINDS)}")
    target = Path(folder) / f"{supplier_name(supplier)}_{kind}.csv"
    if source.endswith(".csv"):
        shutil.copyfile(source, target)
    elif source.endswith(".xlsx"):
        import pandas as pd

        try:
            pd.read_excel(source, dtype=str, keep_default_na=False).to_csv(target, index=False)
        except ImportError as e:
            raise FeedError("reading .xlsx needs openpyxl") from e
    else:
        raise FeedError("only .csv and .xlsx files are taken")
    return str(target)


def listed(folder: str) -> list[dict]:
    return [{"filename": p.name, "size_kb": round(p.stat().st_size / 1024, 1)} for p in sorted(Path(folder).glob("*.csv"))]


def remove(folder: str, filename: str) -> None:
    if not filename.endswith(".csv") or "/" in filename or os.sep in filename:
        raise FeedError("not the name of a feed")
    path = Path(folder) / filename
    if not path.exists():
        raise FileNotFoundError(filename)
    path.unlink()


def without_place() -> Column:
    """Whether a raw row has no coordinates."""
    return text.number(F.col("lat")).isNull() | text.number(F.col("lon")).isNull()


def dropped_rows(raw: DataFrame) -> DataFrame:
    """``n`` of the rows of each supplier that have no coordinates."""
    return raw.where(without_place()).groupBy("supplier").agg(F.count("*").alias("n"))


def keep(rows: DataFrame, path: str) -> None:
    """Add rows to a cache or log that ``side_table`` reads."""
    rows.write.mode("append").json(path)


def side_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A cache kept as JSON lines; empty if it is missing, without the lines that
    can't be read."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
