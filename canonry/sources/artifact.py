"""The built canonical layer: tables, nested documents and search index."""

from __future__ import annotations

import itertools
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from canonry.operators import adjudicate, merge, postings, search
from canonry.session import counted, delete

TABLES = ("raw_hotels", "canonical_hotels", "raw_rooms", "canonical_rooms", "near_misses", "search_lengths", "search_terms")
#: Postings in blocks, beside the plain index: numbers of rows, blocks of terms, of trigrams.
BLOCKS = ("search_numbers", "search_blocks", "search_grams")


#: Rows of what was published, and of leases.
PUBLISHED, HELD = "at long, build string", "build string, until long"


class ArtifactMissing(FileNotFoundError):
    """Nothing has been built at this path."""


def missing(e: Exception) -> bool:
    return any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the build that was published last, if any."""
    rows = _rows(spark, f"{path}/published", PUBLISHED, "at", "build")
    return f"{path}/{rows[-1]['build']}" if rows else None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished build is there."""
    return current(spark, path) is not None


def write(path: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """All tables and the nested documents, in a folder of their own; of raw rows that
    share a key the last one stays.  One row, written last, publishes them all at once, and readers of an
    earlier build go on with that.  Returns how many rows each of ``TABLES`` has, as
    counted while they were written."""
    spark = tables["canonical_hotels"].sparkSession
    build = f"build-{uuid.uuid4().hex}"
    counts: dict[str, Observation] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        df, counts[name] = counted(df)
        df.write.parquet(f"{path}/{build}/{name}")
        return spark.read.parquet(f"{path}/{build}/{name}")

    for name in TABLES[:-2]:
        df = tables[name]
        if name.startswith("raw_"):
            df = merge.last_by_key(df, ["supplier", "id" if name == "raw_hotels" else "room_id"], "line").drop("line")
        keep(name, df)
    hotels, rooms, near = (spark.read.parquet(f"{path}/{build}/{name}") for name in ("canonical_hotels", "canonical_rooms", "near_misses"))
    nested(hotels, rooms, near).write.json(f"{path}/{build}/documents")
    keep("search_lengths", search.index_lengths(hotels, "id"))
    # In order of terms, so that a search reads few row groups.
    keep("search_terms", search.index_terms(hotels, "id", search.COLUMNS).sort("term"))
    numbered = keep("search_numbers", postings.numbers(hotels, "id"))
    keep("search_blocks", postings.term_blocks(hotels, numbered, "id").sort("term", "range"))
    keep("search_grams", postings.gram_blocks(hotels, numbered, "id"))
    spark.createDataFrame([(time.time_ns(), build)], PUBLISHED).coalesce(1).write.mode("append").json(f"{path}/published")
    return {name: counts[name].get["rows"] for name in TABLES}


class Lease:
    """A catalog whose build is not removed for so many seconds, or until ``renew``
    has been called no more.  A context: at its end the build may go.

    The lease is written before the build is seen to be the current one still; so
    whoever finds that build superseded later on finds the lease too, and machines'
    clocks decide nothing but when a lease runs out."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600):
        self.spark, self.path, self.seconds, self.id = spark, path, seconds, uuid.uuid4().hex
        while True:
            self.catalog = Catalog(spark, path)
            self.renew()
            if current(spark, path) == self.catalog.path:
                return
            self.release()  # superseded meanwhile

    def renew(self) -> None:
        until = time.time_ns() + int(self.seconds * 1e9)
        self.spark.createDataFrame([(self.catalog.path.rsplit("/", 1)[1], until)], HELD).coalesce(1).write.mode("append").json(f"{self.path}/leases/{self.id}")

    def release(self) -> None:
        delete(self.spark, f"{self.path}/leases/{self.id}")

    def __enter__(self) -> Catalog:
        return self.catalog

    def __exit__(self, *_) -> None:
        self.release()


def remove_old(spark: SparkSession, path: str, grace: float = 3600, abandoned: float = 7 * 86400) -> list[str]:
    """Delete builds that were superseded more than ``grace`` seconds ago and that
    nobody leases, and folders of builds that were begun ``abandoned`` seconds ago and
    never published.  ``grace`` is for catalogs without a lease.  The current build
    always stays.  Returns the names of what went; stopped half-way, it goes on when
    called again.  At most one row for each build and lease reaches the driver."""
    published = _rows(spark, f"{path}/published", PUBLISHED, "at", "build")
    if not published:
        return []
    now = time.time_ns()
    since = {own["build"]: after["at"] for own, after in itertools.pairwise(published)}
    held = {r["build"] for r in _rows(spark, f"{path}/leases", HELD, "until") if r["until"] > now}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone = []
    for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
        name = f.getPath().getName()
        if not name.startswith("build-") or name in held or name == published[-1]["build"]:
            continue
        if now - since[name] > grace * 1e9 if name in since else now - f.getModificationTime() * 10**6 > abandoned * 1e9:
            delete(spark, f"{path}/{name}")
            gone.append(name)
    return sorted(gone)


def _rows(spark: SparkSession, path: str, schema: str, *order: str) -> list:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(path).orderBy(*order).collect()
    except Exception as e:
        if missing(e):
            return []
        raise


def nested(canonical: DataFrame, rooms: DataFrame, near: DataFrame) -> DataFrame:
    """Canonical records with their rooms and near misses inside."""
    out = canonical
    for name, df in (("rooms", rooms), ("near_misses", near)):
        rest = [c for c in df.columns if c != "canonical_hotel_id"]
        texts = [F.to_json(F.col(c)).alias(c) if dict(df.dtypes)[c].startswith("map") else F.col(c) for c in rest]
        own = df.select("canonical_hotel_id", *texts).groupBy("canonical_hotel_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(own, out["id"] == own["canonical_hotel_id"], "left").drop("canonical_hotel_id")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


class Catalog:
    """Read-only access to a build."""

    def __init__(self, spark: SparkSession, path: str):
        folder = current(spark, path)
        if folder is None:
            raise ArtifactMissing(path)
        self.spark, self.path = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        """The nested documents, read from JSON."""
        return self.spark.read.json(f"{self.path}/documents")

    def search(self, query: str = "", limit: int = 20, offset: int = 0, status: str | None = None) -> dict:
        hotels = self.table("canonical_hotels")
        try:
            total, page = self._from_blocks(hotels, query, limit, offset) if status is None and query.strip() else (None, None)
            if page is None:
                total, page = search.search(hotels, query, limit, offset, status, self.table("search_terms"), self.table("search_lengths"))
        except Exception as e:  # without an index, by pattern
            if not missing(e):
                raise
            total, page = self.like(query, limit, offset, status)
        rows = page.collect()  # at most the limit
        return {"total": total, "limit": limit, "offset": offset, "has_more": search.has_more(total, offset, len(rows)), "results": [r.asDict(recursive=True) for r in rows]}

    def _from_blocks(self, hotels: DataFrame, query: str, limit: int, offset: int) -> tuple[int | None, DataFrame | None]:
        """Total and page of single words; None for phrases, which need positions."""
        search.checked(limit, offset, None)
        phrases = search.query_phrases(query, self.spark)
        if not phrases or any(len(p) > 1 for p in phrases):
            return None, None
        blocks = self.table("search_blocks")
        best = postings.top(blocks, self.table("search_numbers"), phrases, offset + limit)
        page = hotels.join(F.broadcast(best), hotels["id"] == best["key"]).orderBy(F.desc("score"), "id").offset(offset).limit(limit)
        return postings.total(blocks, phrases), page.drop("key", "score")

    def like(self, query: str, limit: int = 20, offset: int = 0, status: str | None = None) -> tuple[int, DataFrame]:
        """Substring search, by trigrams where the build has them."""
        among = None
        try:
            among = postings.may_match(self.table("search_grams"), self.table("search_numbers"), query)
        except Exception as e:
            if not missing(e):
                raise
        return search.like_total(self.table("canonical_hotels"), query, limit, offset, status, among)

    def detail(self, id_: str) -> dict:
        own = self.table("canonical_hotels").where(F.col("id") == id_)
        rooms = self.table("canonical_rooms").where(F.col("canonical_hotel_id") == id_)
        near = self.table("near_misses").where(F.col("canonical_hotel_id") == id_)
        rows = search.detail(own, self.table("raw_hotels"), rooms, self.table("raw_rooms"), near).collect()
        if not rows:
            raise KeyError(id_)
        return rows[0].asDict(recursive=True)

    def stats(self, spend: DataFrame | None = None) -> dict:
        """Counts by status and method; with the log of runs also what was spent."""
        canonical, rooms = self.table("canonical_hotels"), self.table("canonical_rooms")
        as_dict = lambda df, by: {r[by]: r["n"] for r in search.counts(df, by).collect()}
        return {"hotels": as_dict(canonical, "match_status"), "hotels_by_match_method": as_dict(canonical, "match_method"), "rooms": as_dict(rooms, "match_status"), "near_misses": self.table("near_misses").count()} | ({} if spend is None else {"llm_spend": adjudicate.spend_summary(spend).first().asDict()})


def health(spark: SparkSession, path: str) -> dict:
    return {"status": "ok", "db": "ready" if exists(spark, path) else "missing"}
