"""Exact deduplication with a log-structured merge index over text digests.

The digests of a batch form a memtable, which is aggregated and flushed as a run sorted by digest, with a bitmap filter of its
digests. Before that, each older run is asked for the memtable's digests: the run's filter lets few others through, and
those that pass are merge-joined with the run, which gives the hits. Two runs of a level are compacted into one of the next, which
keeps for each digest the best row seen (most code points, then the smallest identifier) and the count.

Texts of hits, and of digests repeated inside a batch, are verified byte by byte: a filter of those digests decides which
texts are looked at, and each map task sends the smallest and the largest text of a digest, so copies collapse before the shuffle. Digests
that turn out to stand for several texts are grouped by the texts themselves.

Everything is DataFrame operations. Through the index travel a digest, a length and an identifier a row, added up on the map
side, so a group of copies that holds a third of all rows is one row a task; rows of hot digests get their answer by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import build_filter, drop_runs, flush, let_through, merge, present, split_join
from .store import drop, saved
from .text import BLANKS, whole

DECIMAL = "decimal(38,0)"
#: Rows of a batch at most; there are four batches at least.
BATCH = 500_000_000


def normalised(text: Column | str) -> Column:
    return F.translate(whole(text), BLANKS, "")


def _best() -> Column:
    """Most code points first, then the smallest identifier, null before all: one decimal, so that hash aggregation can keep it."""
    rest = F.coalesce(F.lit(str(10**19)).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)"), F.lit(str(5 * 10**19)).cast(DECIMAL))
    return F.max((F.col("n_chars").cast("decimal(17,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + rest).cast(DECIMAL))


def _entry(best: Column) -> tuple[Column, Column]:
    """The length and the identifier in a ``_best``."""
    length = F.floor(best / F.lit(str(10**20)).cast("decimal(21,0)")).cast("long")
    rest = best % F.lit(str(10**20)).cast("decimal(21,0)")
    return length, F.when(rest < F.lit(str(5 * 10**19)).cast(DECIMAL), (F.lit(str(10**19)).cast(DECIMAL) - rest).cast("long"))


class DigestIndex:
    """Levels of sorted runs (digest, group_size, best) with their filters. ``add`` takes a batch, ``merged`` compacts everything;
    ``hits`` are the digests that a batch found in an older run or has more than once itself."""

    def __init__(self) -> None:
        self.levels, self.hits, self.asked = {}, [], 0

    def runs(self) -> list[tuple[DataFrame, DataFrame]]:
        return [r for _, run in sorted(self.levels.items()) for r in run]

    def find(self, digests: DataFrame) -> DataFrame:
        """(digest) of ``digests`` that the index has: each run gets those that its filter lets through."""
        out = digests.select("digest").limit(0)
        for run, bits in self.runs():
            self.asked += 1
            out = out.unionByName(present(let_through(digests.select("digest"), "digest", bits), run, "digest"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (digest, n_chars, doc_id)."""
        run = flush(batch.groupBy("digest").agg(F.count("*").alias("group_size"), _best().alias("best")), "digest", "digest-run")
        self.hits.append(saved(self.find(run).unionByName(run.where("group_size > 1").select("digest")), "digest-hits"))
        self._put(run, build_filter(run, "digest", "digest-filter"))

    def _put(self, run: DataFrame, bits: DataFrame) -> None:
        level = 0
        while self.levels.get(level):
            run = self._compacted(*self.levels[level].pop(), run, bits)
            bits = build_filter(run, "digest", "digest-filter")
            level += 1
        self.levels.setdefault(level, []).append((run, bits))

    @staticmethod
    def _compacted(a: DataFrame, a_bits: DataFrame, b: DataFrame, b_bits: DataFrame) -> DataFrame:
        size = F.coalesce("a.group_size", F.lit(0)) + F.coalesce("b.group_size", F.lit(0))
        out = flush(merge(a, b, "digest", group_size=size, best=F.greatest("a.best", "b.best")), "digest", "digest-run")
        drop_runs(a, b)
        drop(a_bits, b_bits)
        return out

    def merged(self) -> DataFrame:
        """One run of everything; the index is that run afterwards."""
        runs = self.runs()
        run, bits = runs[0]
        for other, more in runs[1:]:
            run = self._compacted(run, bits, other, more)
            bits = build_filter(run, "digest", "digest-filter")
        self.levels = {len(self.levels): [(run, bits)]}
        return run

    def repeated(self) -> DataFrame:
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.unionByName(h)
        return out.distinct()

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Entries of the given digests (digest, group_size, keep_id, keep_chars), through the filters."""
        found = None
        for run, bits in self.runs():
            rows = run.join(let_through(digests.select("digest").distinct(), "digest", bits).hint("merge"), "digest")
            found = rows if found is None else found.unionByName(rows)
        found = found.groupBy("digest").agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
        length, keep = _entry(F.col("best"))
        return found.select("digest", "group_size", keep.alias("keep_id"), length.alias("keep_chars"))


def exact_dedup(docs: DataFrame, batches: int | None = None, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every ASCII blank is deleted; null counts as empty, so null, empty and
    blank texts are one group. The row with the most code points in its original text stays, then the one with the
    smallest doc_id (a null doc_id comes first). Repeated rows are members like others; if the row that stays is
    itself repeated, all its repetitions are ``kept``. An empty table gives an empty result; other columns are
    ignored. ``digest_bytes`` under 32 shortens the index key, which only makes byte verification work harder.
    """
    text = normalised("text")
    n = docs.count()
    batches = batches or max(4, -(-n // BATCH))
    rows = docs.select("doc_id", F.length(whole("text")).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
    rows = rows.withColumns({"digest": F.substring("text_sha256", 1, 2 * digest_bytes), "batch": F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")})
    rows = saved(rows, "digests", by="batch")
    index = DigestIndex()
    for b in range(batches):
        index.add(rows.where(F.col("batch") == b).select("digest", "n_chars", "doc_id"))
    hits = saved(index.repeated(), "digest-hits")
    drop(*index.hits)
    merged = index.merged()
    bits = build_filter(hits, "digest", "digest-filter")

    digest = F.substring(F.sha2(text, 256), 1, 2 * digest_bytes)
    compared = let_through(docs.select(digest.alias("digest"), text.alias("t")), "digest", bits)
    compared = compared.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).where(F.col("a") != F.col("b")).select("digest")
    unequal = saved(compared, "unequal-digests")
    repeated = merged.where("group_size > 1")
    if unequal.isEmpty():
        drop(unequal, hits, bits)
        return _result(rows, repeated, "digest", n)
    # Digests that stand for several texts: those rows are grouped by the whole digest and the text itself.
    split = (
        docs.select("doc_id", F.length(whole("text")).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"), digest.alias("digest"), text.alias("t"))
        .join(unequal, "digest", "left_semi")
    )
    best = split.groupBy("digest", "t").agg(F.count("*").alias("group_size"), _best().alias("best"))
    odd = _result(split.withColumn("key", F.struct("digest", "t")).drop("digest", "t"), best.select(F.struct("digest", "t").alias("key"), "group_size", "best"), "key", n)
    return _result(rows.join(unequal, "digest", "left_anti"), repeated, "digest", n).unionByName(odd)


def _result(rows: DataFrame, index: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with the answer of their group; those that ``index`` doesn't have are alone."""
    length, keep = _entry(F.col("best"))
    rows = split_join(rows, index, key, "group_size", total, "left").withColumns({"keep_id": keep, "keep_chars": length})
    alone = F.col("best").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
