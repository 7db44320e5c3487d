"""Sorted runs, bitmap filters, and joins that split hot keys: what the log-structured operators are made of."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, new_path, saved

#: A table that may go to all executors has at most so many rows. Of ``total`` rows, at most so many keys have more than
#: ``total / HEAVY`` each.
HEAVY = 50_000
#: Bits of a filter for each key, and the bitmaps (of 4 kB) that it has at most, so that it can go to all executors.
BITS, MOST_BITMAPS = 16, 1 << 13


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flush(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A run: ``rows``, already dealt by ``key`` (as aggregation by it leaves them), in buckets sorted by it, a file a bucket in the
    shared folder. Runs meet in merge joins without being shuffled or sorted again."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts_of(spark), key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.saved_path, out.saved_table = path, table
    return out


def drop_runs(*runs: DataFrame) -> None:
    for r in runs:
        r.sparkSession.sql(f"DROP TABLE IF EXISTS {r.saved_table}")
        delete(r.sparkSession, r.saved_path)


def merge(a: DataFrame, b: DataFrame, key: str, **how: Column) -> DataFrame:
    """Two runs as one, not yet flushed; ``how`` says what becomes of the columns of ``a`` and ``b`` (aliases)."""
    return a.alias("a").join(b.hint("merge").alias("b"), key, "full_outer").select(key, *(c.alias(n) for n, c in how.items()))


def missing(rows: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """Rows whose key the run doesn't have."""
    return rows.join(run.select(key).hint("merge"), key, "left_anti")


def present(rows: DataFrame, run: DataFrame, key: str) -> DataFrame:
    return rows.join(run.select(key).hint("merge"), key, "left_semi")


def _bit(key: str, bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bitmaps * 32768)) + 1


def build_filter(keys: DataFrame, key: str, name: str) -> DataFrame:
    """(bucket, bits): bitmaps over the hashes of the keys, ``BITS`` bits a key but ``MOST_BITMAPS`` bitmaps at most."""
    n = keys.count()
    bitmaps = min(MOST_BITMAPS, max(1, -(-n * BITS // 32768)))
    h = _bit(key, bitmaps)
    out = saved(keys.groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")), name)
    out.bitmaps = bitmaps
    return out


def let_through(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """Rows whose key the filter may hold. The filter has 32 MB at most, so it goes to all executors and no row is shuffled."""
    h = _bit(key, filter_.bitmaps)
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumns({"bucket_": F.bitmap_bucket_number(h), "bit_": F.bitmap_bit_position(h)})
    small = F.broadcast(filter_.select(F.col("bucket").alias("bucket_"), "bits"))
    return rows.join(small, "bucket_").where(F.getbit(byte, (F.col("bit_") % 8).cast("int")) == 1).drop("bucket_", "bit_", "bits")


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row a key and in ``weight`` the number of rows with that key,
    ``total`` together at most. Keys of more than ``total / HEAVY`` rows are no more than ``HEAVY``: they go to all executors, and
    their rows stay where they are. Other rows are shuffled, and no task gets many of one key."""
    hot = F.broadcast(table.where(F.col(weight) > total / HEAVY))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(weight) <= total / HEAVY), key, how)
    heavy = rows.join(hot, key)
    return heavy.unionByName(rest.select(*heavy.columns))
