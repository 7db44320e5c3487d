"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

A batch of documents yields the hashes of its line keys with the number of its documents that have them, sorted. It is
merge-anti-joined with the runs: keys that no run has become a run of their own, keys that some run has become a run of repeats.
So a key stands in one run only, and most keys, which occur once, are written once. Two runs of a level are merged
into one of the next. In the end repeats are merged and meet the runs once more, which gives the keys that reach the threshold.

Runs are bucketed by hash, so all of this is merge joins without a shuffle; only a batch's counts are shuffled, after they are
added up, so a line of a third of all documents is a row a task. Where documents meet the frequent keys, the hot ones are
broadcast. Texts are read twice and shuffled once, to meet the keys that each document loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import drop_runs, flush, merge, missing, split_join
from .store import drop, saved
from .text import ascii_lower, trimmed, whole

#: Documents of a batch at most; there are four batches at least.
BATCH = 200_000_000


def lines_of(text: Column | str) -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(trimmed(line))


class LineRuns:
    """Levels of sorted runs (hash, n) of new keys, no key in two of them, and of repeats of those keys."""

    def __init__(self) -> None:
        self.new, self.repeats = {}, {}

    def add(self, batch: DataFrame) -> None:
        """Adds the keys of a batch of (hash), a row for each document that has it."""
        memtable = flush(batch.groupBy("hash").agg(F.count("*").alias("n")), "hash", "line-batch")
        fresh = memtable
        for run in self.runs(self.new):
            fresh = missing(fresh, run, "hash")
        fresh = flush(fresh, "hash", "line-run")
        if self.new:
            self._put(self.repeats, flush(missing(memtable, fresh, "hash"), "hash", "line-repeats"))
        self._put(self.new, fresh)
        drop_runs(memtable)

    @staticmethod
    def runs(levels: dict) -> list[DataFrame]:
        return [r for _, run in sorted(levels.items()) for r in run]

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        out = flush(merge(a, b, "hash", n=F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))), "hash", "line-run")
        drop_runs(a, b)
        return out

    def _put(self, levels: dict, run: DataFrame) -> None:
        level = 0
        while levels.get(level):
            run = self.merged(levels[level].pop(), run)
            level += 1
        levels.setdefault(level, []).append(run)

    def frequent(self, min_docs: int) -> DataFrame:
        """(hash, n) of the keys of at least ``min_docs`` documents."""
        again = None
        for r in self.runs(self.repeats):
            again = r if again is None else self.merged(again, r)
        parts = []
        for run in self.runs(self.new):
            if again is not None:
                more = again.select("hash", F.col("n").alias("more")).hint("merge")
                run = run.join(more, "hash", "left").select("hash", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
            parts.append(run.where(F.col("n") >= min_docs))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = saved(out, "frequent-lines")
        drop_runs(*self.runs(self.new), *([again] if again is not None else []))
        return out


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None) -> DataFrame:
    """``docs`` with two more columns, ``n_lines_`` and ``n_dropped_``, and ``text`` without the lines that go.

    A text is split at line feeds; null and empty texts are one empty line. A line's key is the line without ASCII
    blanks at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs``
    rows lose all their lines everywhere; the rest is joined again. Rows count as documents, so repeated rows count
    as often as they stand there. A text that loses nothing comes back as it was (null as empty). An empty table
    gives an empty one; all other columns are passed on, and ones named like the new columns are replaced.
    """
    docs = docs.drop("n_lines_", "n_dropped_")
    batches = batches or max(4, -(-docs.count() // BATCH))
    keyed = docs.select("doc_id", F.xxhash64(whole("text")).alias("text_hash"), F.transform(lines_of("text"), line_key).alias("keys"))
    # A document's lines with one key are one entry.
    lines = keyed.select(
        "doc_id", "text_hash",
        F.explode(F.expr(f"array_distinct(filter(keys, k -> length(k) >= {int(min_chars)}))")).alias("key"),
    ).select("doc_id", "text_hash", F.unhex(F.md5("key")).alias("hash"), F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int").alias("batch"))
    lines = saved(lines, "line-hashes", by="batch")
    runs = LineRuns()
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("hash"))
    frequent = runs.frequent(min_docs)
    lost = split_join(lines.drop("batch"), frequent, "hash", "n", lines.count())
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("all"))
    # The keys that a document loses are laid out by hash, so that a line is looked for among few of them.
    laid = "transform(sequence(0, cast(sqrt(size(all)) AS int)), i -> filter(all, h -> pmod(xxhash64(h), cast(sqrt(size(all)) AS int) + 1) = i))"
    lost = saved(lost.select(F.col("doc_id").alias("lost_id_"), F.col("text_hash").alias("lost_hash_"), F.expr(laid).alias("lost_")), "lost-lines")
    drop(lines, frequent)
    out = docs.withColumn("text_hash_", F.xxhash64(whole("text"))).join(
        lost, F.col("doc_id").eqNullSafe(F.col("lost_id_")) & (F.col("text_hash_") == F.col("lost_hash_")), "left")
    here = lambda h: F.array_contains(F.element_at("lost_", F.pmod(F.xxhash64(h), F.size("lost_")).cast("int") + 1), h)
    kept = F.when(F.col("lost_").isNotNull(), F.filter(lines_of("text"), lambda x: ~here(F.unhex(F.md5(line_key(x)))))).otherwise(lines_of("text"))
    out = out.withColumn("kept_", kept).withColumn("n_lines_", F.size(lines_of("text")).cast("long"))
    out = out.withColumns({"n_dropped_": F.col("n_lines_") - F.size("kept_"), "text": F.array_join("kept_", "\n")})
    return out.select(*docs.columns, "n_lines_", "n_dropped_")
