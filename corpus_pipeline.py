"""A corpus from documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.

1. ``quality``: documents that the rule ensemble rejects (score below 0.7, where
   ``op6_quality`` predicts 0) go; where nothing could be learnt, all stay.
   It is learnt from the labels of documents that are not held out.
2. ``near_duplicates``: of each group of documents linked by five-word shingles
   at a Jaccard similarity of 0.8 or more, the one of smallest doc_id stays, whatever
   else has that id; of equal rows one stays.
3. ``substrings``: words inside windows of 50 words that also start elsewhere
   go, wherever they stand; a document that loses all its words stays, empty.
4. ``packing``: what is left is packed into sequences of 1024 tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm import common, jaccard, packing, quality, substrings

SHINGLE, PERCENT = 5, 80
PASSAGE = 50
#: Ids that are broadcast at most.
BROADCAST_ROWS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier does not reject; a null text counts as empty."""
    model = quality.learn(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    if not model.rules and model.intercept == 0:
        return docs
    scored = quality.with_statistics(docs, keep_text=True)
    return scored.where(model.column(F.col(quality.COLUMN)) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, known by its id and text: the smallest id, of
    several texts with that id the least digest, of equal rows one.  A missing id
    counts as larger than any.  Texts without words are in no group and stay."""
    found = common.written(jaccard.join(docs.select("doc_id", "text"), SHINGLE, PERCENT, with_texts=True).where("class is not null"), "grouped")
    row = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "d1", "d2")
    groups = found.groupBy("class").agg(F.min(row).alias("k"), F.count("*").alias("n"))
    kept = groups.where("n > 1").select("class", "k")
    # Rows of groups of several, and which of them stays.
    known = found.select("class", row.alias("row")).join(kept, "class")
    gone = common.written(known.where(F.col("row") != F.col("k")).select("row.*").distinct(), "gone")
    stay = common.written(known.where(F.col("row") == F.col("k")).groupBy("row").count().where("count > 1").select("row.*"), "twice")
    own = ["__none", "__id", "__d1", "__d2"]  # names that no input has
    text = common.text_or_empty()
    keyed = docs.withColumns(dict(zip(own, (F.isnull("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)))
    key = lambda df: df.select("none", F.coalesce("id", F.lit(0)), "d1", "d2").toDF(*own)
    gone = F.broadcast(key(gone)) if gone.count() <= BROADCAST_ROWS else key(gone)
    left = keyed.join(gone, own, "left_anti")
    # Equal rows: only these are looked at again.
    if stay.isEmpty():
        return left.select(*docs.columns)
    once = left.join(key(stay), own, "left_anti").select(*docs.columns)
    return once.unionByName(left.join(key(stay), own, "left_semi").dropDuplicates(own).select(*docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in several places out of all of them."""
    cut = substrings.without_repeats(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: Learning and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
