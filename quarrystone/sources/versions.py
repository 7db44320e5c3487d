"""Versioned groups of tables: written beside what readers still use, complete when their mark stands, kept for a number of versions.

A version is a folder ``v00000001-<signature>`` with a folder of Parquet files for each table. Its mark is written last, so a job that
dies leaves no half version to readers, on object stores too: nothing is renamed. One writer at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_COMPLETE"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if re.match(r"v\d{8}-", n))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions under ``root``, oldest first."""
    return [n for n in _folders(spark, root) if _exists(spark, f"{root}/{n}/{MARK}")]


def signature(spark: SparkSession, path: str, *parameters: object) -> str:
    """A name for the Parquet files of ``path`` (their paths, sizes and times) together with parameters. The files are listed
    and hashed by Spark; no column is read."""
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    files = m.agg(F.count("*"), F.sum("file_size"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
    return hashlib.md5(repr((tuple(files), parameters)).encode()).hexdigest()


def publish(tables: dict[str, DataFrame], root: str, sign: str, keep: int = 3) -> str:
    """Writes ``tables`` as the newest version and removes all but the ``keep`` newest ones. Its name is returned."""
    spark = next(iter(tables.values())).sparkSession
    name = f"v{max([int(n[1:9]) for n in _folders(spark, root)], default=0) + 1:08d}-{sign}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    fs, mark = _fs(spark, f"{root}/{name}/{MARK}")
    fs.create(mark).close()
    prune(spark, root, keep)
    return name


def prune(spark: SparkSession, root: str, keep: int) -> None:
    """Removes all complete versions but the ``keep`` newest ones, and incomplete ones that are older than the newest."""
    if keep < 1:
        raise ValueError("the newest version stays")
    complete = versions(spark, root)
    kept = set(complete[-keep:])
    for n in _folders(spark, root):
        if complete and n not in kept and n < complete[-1]:
            _delete(spark, f"{root}/{n}")


def roll_back(spark: SparkSession, root: str) -> str:
    """Removes the newest version, its mark first, and returns the name of the one before it."""
    complete = versions(spark, root)
    if len(complete) < 2:
        raise ValueError(f"no version to go back to under {root}")
    _delete(spark, f"{root}/{complete[-1]}/{MARK}")
    _delete(spark, f"{root}/{complete[-1]}")
    return complete[-2]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the newest complete version."""
    complete = versions(spark, root)
    if not complete:
        raise FileNotFoundError(f"no complete version under {root}")
    return spark.read.parquet(f"{root}/{complete[-1]}/{table}")


def load_or_build(spark: SparkSession, root: str, sign: str, build: Callable[[], dict[str, DataFrame]], keep: int = 3) -> str:
    """The folder of the newest version if it has this signature; else that of a new one from ``build``."""
    complete = versions(spark, root)
    name = complete[-1] if complete and complete[-1][10:] == sign else publish(build(), root, sign, keep)
    return f"{root}/{name}"
