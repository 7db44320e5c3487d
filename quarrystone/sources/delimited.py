"""CSV and JSON-lines tables with the checks that their users rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    # A byte order mark before the first name is skipped by the reader.
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(paths)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files that match; there is one per table, so the driver lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().toString() for f in found)


def read_csvs(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """All CSV files of ``folder`` that have the ``columns``, as trimmed text, with their ``file``; others are left out."""
    out = None
    for p in _listed(spark, f"{folder}/*.csv"):
        one = _csv(spark, p)
        if set(columns) <= set(one.columns):
            one = one.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in columns], F.element_at(F.split(F.lit(p), "/"), -1).alias("file"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, "file"]))


def read_edges(spark: SparkSession, folder: str, view: str, required: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Edge files ``Ch*_{view}_{version}.csv``: ``required`` as text (null is empty), ``numbers`` as doubles or null, and view.

    Raises ValueError if there is no file, more than one version, or a file lacks a required column.
    """
    paths = _listed(spark, f"{folder}/Ch*_{view}_*.csv")
    versions = {p.rsplit("/", 1)[-1][:-4].rsplit("_", 1)[-1] for p in paths}
    if len(versions) != 1:
        raise ValueError(f"expected files of one version for {view}, found versions {sorted(versions)}")
    out = None
    for p in paths:
        one = _csv(spark, p)
        if lacking := set(required) - set(one.columns):
            raise ValueError(f"{p} lacks {sorted(lacking)}")
        given = [F.col(f"`{c}`").try_cast("double").alias(c) if c in one.columns else F.lit(None).cast("double").alias(c) for c in numbers]
        one = one.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in required], *given, F.lit(view).alias("view"))
        out = one if out is None else out.unionByName(one)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped and a line that isn't an object stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
