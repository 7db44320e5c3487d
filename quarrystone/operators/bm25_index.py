"""A saved BM25 index: postings sorted by term, so that a search reads the row groups of its words and nothing else."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

#: Raised when the tables or the terms of an index change, so that saved ones are built anew.
FORMAT = 1
K1, B = 1.5, 0.75
QUERY = "the and with for that thing"


def terms_of(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    """``postings`` (t, doc_id, f, n: the document's length) and ``totals`` (docs, mean) of docs (doc_id, text). doc_id is unique; texts
    without terms, null ones among them, aren't counted. Files are ranges of (t, doc_id), so a word that most documents have
    is divided over tasks, and minima and maxima of t leave out what a search doesn't ask for."""
    d = docs.select("doc_id", terms_of("text").alias("w")).withColumn("n", F.size("w")).where("n > 0")
    postings = d.select("doc_id", "n", F.explode("w").alias("t")).groupBy("t", "doc_id", "n").agg(F.count("*").alias("f"))
    postings = postings.repartitionByRange("t", "doc_id").sortWithinPartitions("t", "doc_id")
    return {"postings": postings, "totals": d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))}


def search(spark: SparkSession, folder: str, query: str, k: int) -> DataFrame:
    """(doc_id, score) of the ``k`` best documents for a query's distinct terms; equal scores by doc_id. No term finds nothing."""
    asked = [r.t for r in spark.range(1).select(F.explode(F.array_distinct(terms_of(F.lit(query)))).alias("t")).collect()]
    hits = spark.read.parquet(f"{folder}/postings").where(F.col("t").isin(asked))
    known = F.broadcast(hits.groupBy("t").agg(F.count("*").alias("d")))  # a row a term of the query
    total = F.broadcast(spark.read.parquet(f"{folder}/totals"))  # one row
    rare = F.log(1 + (F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    gain = rare * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = hits.join(known, "t").crossJoin(total).groupBy("doc_id").agg(F.round(F.sum(gain), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents from an index in the shared folder, built where none fits the files of ``documents``."""
    path = f"{sf_dir}/documents.parquet"
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file:/tmp/checkpoints"
    root = f"{shared}/bm25-{hashlib.md5(path.encode()).hexdigest()}"
    sign = versions.signature(spark, path, FORMAT, "documents")
    return search(spark, versions.load_or_build(spark, root, sign, lambda: tables(spark.read.parquet(path))), QUERY, 10)
