"""From raw documents to a training mix: each stage works on all that the one before it kept.

``run`` applies the stages to ``documents``; what a stage keeps is written to the shared folder and read by the next one,
so a lost executor costs a part of one stage at most. What the next stage has read is removed.

Decisions are carried by a row key, a hash of doc_id and text, so null and repeated ids are rows like others: a row goes only
if its own text is the reason. Rows with the same id and text are one document to the near-duplicate stage, which keeps one of them,
and share their fate in all other stages. Null texts are empty; empty and blank texts are kept or dropped by quality alone, get no
copies in the mix, and so aren't in its result. All stages give an empty result for an empty table and pass other columns on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.decontamination import decontaminate
from quarrystone.llm.jaccard_join import similar_components
from quarrystone.llm.line_dedup import line_dedup
from quarrystone.llm.mixing import mix
from quarrystone.llm.quality import select_quality
from quarrystone.llm.runs import split_join
from quarrystone.llm.store import drop, saved
from quarrystone.llm.text import whole

#: Keys (8 bytes each) that may be sent to all executors; more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000
KEY = "row_key_"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", whole("text")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among ``keys``."""
    keys = saved(keys.select(KEY).distinct(), "dropped-keys")
    return _keyed(docs).join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, KEY, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps. Empty texts have weight 0. Ties at the last place stay."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` follows the text. Null texts become empty ones."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the smallest doc_id (null last). Repeated rows are one document."""
    keyed = _keyed(docs)
    found = saved(similar_components(keyed.select(F.col(KEY).alias("doc_id"), "text")), "similar")
    ids = keyed.groupBy(KEY).agg(F.first("doc_id").alias("id"), F.count("*").alias("times"))
    members = found.select(F.col("doc_id").alias(KEY), "component_id").distinct()
    linked = members.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(split_join(members, linked, "component_id", "n", members.count()).drop("n").join(ids, KEY), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", KEY)).alias("least"), F.count("*").alias("n"))
    gone = split_join(members, first, "component_id", "n", members.count()).where(F.col(KEY) != F.col(f"least.{KEY}"))
    kept = _without(docs, gone)
    repeated = saved(ids.where("times > 1").select(KEY), "repeated-keys")
    if not repeated.isEmpty():
        once = _keyed(kept).join(repeated, KEY, "left_semi").dropDuplicates([KEY])
        kept = _without(kept, repeated).unionByName(once.select(docs.columns))
    drop(found)
    return kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    found = decontaminate(_keyed(docs).select(F.col(KEY).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias(KEY)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy of a document, numbered by ``copy``, with its size and its source's target."""
    return mix(docs).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]
#: Hashed n-gram models with noise and the entropy balancing aren't SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs
