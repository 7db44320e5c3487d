"""Questions matched with a bank of stems: an equi-join of 4-grams finds candidates, a text similarity decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.chunking import sequence_ratio


def normalised(text: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def match_stems(questions: DataFrame, stems: DataFrame, gram: int = 4, least: int = 12, candidates: int = 8, contain: float = 0.5, similar: float = 0.9) -> DataFrame:
    """(q_id, stem_id, similarity, how) for each of ``questions`` (q_id, text) against ``stems`` (stem_id, text).

    An equal stem counts 1 (``exact``), containment of at least ``contain`` of the longer text 0.99, else the share of matching
    blocks from ``similar`` on. The ``candidates`` with most shared grams, then nearest length, then smallest id are compared, and
    equal stems always. Texts with fewer than ``least`` characters and questions without a match have nulls.
    """
    q = questions.select("q_id", normalised(F.col("text")).alias("q"))
    s = stems.select("stem_id", normalised(F.col("text")).alias("s")).where(F.length("s") >= least)
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (gram - 1)), lambda i: F.substr(F.col(c), i, F.lit(gram)))))
    asked = q.where(F.length("q") >= least)
    votes = asked.select("q_id", F.length("q").alias("n"), grams("q").alias("g")).join(s.select("stem_id", F.length("s").alias("m"), grams("s").alias("g")), "g")
    votes = votes.groupBy("q_id", "stem_id").agg(F.count("*").alias("votes"), F.abs(F.first("n") - F.first("m")).alias("gap"))
    order = Window.partitionBy("q_id").orderBy(F.desc("votes"), "gap", "stem_id")
    top = votes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= candidates).select("q_id", "stem_id")
    equal = asked.join(s, F.col("q") == F.col("s")).groupBy("q_id").agg(F.min("stem_id").alias("stem_id"))
    pairs = top.unionByName(equal).distinct().join(asked, "q_id").join(s, "stem_id")
    lo, hi = F.least(F.length("q"), F.length("s")), F.greatest(F.length("q"), F.length("s"))
    within = (F.contains("q", F.col("s")) | F.contains("s", F.col("q"))) & (lo >= contain * hi)
    sure = pairs.withColumn("how", F.when(F.col("q") == F.col("s"), "exact").when(within, "contain"))
    # The ratio is at most 2 * lo / (lo + hi), so texts of other lengths never reach Python.
    unsure = sure.where(F.col("how").isNull() & (2 * lo >= similar * (lo + hi))).withColumn("ratio", sequence_ratio(F.col("q"), F.col("s"))).where(F.col("ratio") >= similar)
    sure = sure.where(F.col("how").isNotNull()).withColumn("ratio", F.when(F.col("how") == "exact", 1.0).otherwise(0.99))
    found = sure.unionByName(unsure.withColumn("how", F.lit("similar")))
    best = found.groupBy("q_id").agg(F.max(F.struct("ratio", (-F.col("stem_id")).alias("least"), "how")).alias("b"))
    return q.select("q_id").join(best, "q_id", "left").select("q_id", (-F.col("b.least")).alias("stem_id"), F.round("b.ratio", 4).alias("similarity"), F.col("b.how").alias("how"))


def stem_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations against the texts of the benchmark."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("q_id"), "text").distinct()
    return match_stems(turns, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("stem_id"), "text"))
