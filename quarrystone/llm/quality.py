"""A quality classifier by importance resampling (data selection with hashed n-gram models).

Two generative models of hashed word and word-pair counts are fitted: one of all texts, one of a bounded sample of
texts that are labelled good. A text's log importance weight is the log of the ratio of the two, added up over its n-grams and
brought to ``LENGTH`` n-grams, so that long texts don't win by their length alone. Gumbel noise is added to the log weights and the
k largest sums stay, which draws k texts without replacement by importance.
``k`` is the number of texts whose log weight is above the cut that parts good from bad labelled texts best.

Counts are dense vectors of fixed length, added up in slices, so what is shuffled or sent grows with the number of tasks and
not with the vocabulary. Texts are never shuffled; the rows that stay are filtered where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import MIXED_CLASSES, flat, ngrams, small_batches, tokens
from .store import drop, saved
from .text import whole

BUCKETS, SLICES = 1 << 16, 32
#: n-grams of the text that log weights are stated for.
LENGTH = 100


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and pairs in the order of the rows, the row of each, and the number of n-grams a row."""
    h, first = tokens(*flat(column), MIXED_CLASSES)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = ngrams(h, 2)
    inner = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    bucket = np.r_[h, pair[inner]] & np.uint64(BUCKETS - 1)
    rows = np.r_[row, row[:-1][inner]] if len(row) else row
    return bucket.astype(np.int64), rows, np.bincount(rows, minlength=len(first) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        bucket, row, _ = _features(batch.column(0))
        raw += np.bincount(bucket, minlength=BUCKETS)
        good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        target += np.bincount(bucket[good[row]], minlength=BUCKETS)
    k = BUCKETS // SLICES
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), *(pa.array([v[i * k : (i + 1) * k].tobytes() for i in range(SLICES)], pa.binary()) for v in (raw, target))], names=["slice", "raw", "target"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for s, *vs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have = sums.setdefault(s, [0, 0])
            for i, v in enumerate(vs):
                have[i] = have[i] + np.frombuffer(v, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([v[i].tobytes() for v in sums.values()], pa.binary()) for i in range(2))], names=["slice", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> np.ndarray:
    """Log ratio of target to raw of each bucket. The target is at most ``max_labelled`` texts, by a hash of their ids,
    with quality 1 that aren't toxic; the raw model counts all texts. Unseen buckets lean on the raw model."""
    small_batches(docs.sparkSession)
    good = sample(labels, max_labelled).where("good").select("doc_id", "good")
    seen = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(good), "doc_id", "left").select("text", "good")
    schema = "slice long, raw binary, target binary"
    parts = seen.mapInArrow(_counted, schema).repartition(SLICES, "slice").mapInArrow(_added, schema).orderBy("slice").collect()
    raw, target = (np.concatenate([np.frombuffer(r[c], np.int64) for r in parts]).astype(float) if parts else np.zeros(BUCKETS) for c in ("raw", "target"))
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    mass = float(BUCKETS)
    return np.log((target + mass * p_raw) / (target.sum() + mass) / p_raw)


def sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, good, bad) of a bounded number of labelled ids; of several labels the worst counts. Toxic texts of quality 1
    are neither: they aren't what the target model is fitted on, and the cut is one of quality."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    one = one.select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("good"), (F.col("q") != 1).alias("bad"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def _seed() -> Column:
    """What the noise follows from: id and whole text."""
    return F.xxhash64(F.lit("gumbel"), "doc_id", whole("text"))


def _scores(ratio: np.ndarray, texts: pa.Array, seeds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, log weight, log weight with Gumbel noise)."""
    bucket, row, n = _features(texts)
    weight = LENGTH * np.bincount(row, ratio[bucket], minlength=len(n)) / np.maximum(n, 1)
    u = ((seeds.to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return n, weight, weight - np.log(-np.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_ngrams, log_weight, sample_key for every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _scores(sent.value, b.column(1), b.column(2)))], names=["doc_id", "n_ngrams", "log_weight", "sample_key"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _seed().alias("seed"))
    return rows.mapInArrow(run, "doc_id long, n_ngrams long, log_weight double, sample_key double")


def best_cut(scored: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> float | None:
    """The log weight that parts the bounded sample of labelled texts best; None without both kinds of labels."""
    both = F.broadcast(sample(labels, max_labelled)).join(scored.where("n_ngrams > 0"), "doc_id").select("good", "bad", F.col("log_weight").alias("m")).toPandas()
    good, bad = (np.sort(both["m"][both[c].astype(bool)]) for c in ("good", "bad"))
    if not len(good) or not len(bad):
        return None
    cuts = np.unique(np.r_[good, bad])
    loss = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = cuts[int(np.argmin(loss))]
    below = cuts[cuts < best]
    return float((best + below[-1]) / 2) if len(below) else float(best)


def kth_largest(scored: DataFrame, k: int, column: str = "sample_key", collected: int = 10_000) -> float:
    """The k-th largest value, exactly: counts in bins narrow it down until few rows are left to look at."""
    lo, hi, above = *scored.agg(F.min(column), F.max(column)).first(), 0
    while True:
        inside = scored.where(F.col(column).between(lo, hi))
        if lo == hi:
            return lo
        width = (hi - lo) / 4096
        bins = inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(4095)).alias("b")).agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in bins:
            if above + r.c >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.c
        if r.c <= collected:
            rest = sorted((x[0] for x in scored.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
            return rest[k - above - 1]


def _decided(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, DataFrame, float]:
    ratio = fit(docs, labels, max_labelled)
    scored = saved(weigh(docs, ratio), "importance")
    cut = best_cut(scored, labels, max_labelled)
    k = 0 if cut is None else scored.where(F.col("log_weight") >= cut).count()
    return ratio, scored, kth_largest(scored, k) if k else -np.inf


def importance_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """doc_id, n_ngrams, log_weight, sample_key and kept for every row of ``docs``.

    Null and empty texts have no n-grams and log weight 0. Equal rows get equal noise and share their fate; if they tie
    for the last place all of them stay. Labels without an id or a quality are ignored; without labels of both kinds everything stays.
    Other columns are ignored; empty tables are allowed on both sides.
    """
    _, scored, least = _decided(docs, labels, max_labelled)
    return scored.withColumn("kept", F.col("sample_key") >= float(least))


def select_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``importance_sample`` keeps, with all their columns, filtered in place."""
    ratio, scored, least = _decided(docs, labels, max_labelled)
    drop(scored)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    t, n = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(_scores(sent.value, b.column(t), b.column(n))[2] >= least))
            yield kept.select(list(range(n)))

    return docs.select(*docs.columns, _seed().alias("gumbel_seed_")).mapInArrow(run, docs.schema)
