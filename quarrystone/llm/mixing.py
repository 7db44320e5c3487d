"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix. The base measure is one copy of every document.
Among all rates that give each source its target number of words and stay within ``cap``, the entropy-balanced ones are those
nearest to the base measure in relative entropy: ``min(cap, exp(lambda_s * z))`` with one multiplier for each source and
``z = size / mean size of the source``, so rates are tilted exponentially by length. The multipliers maximise the convex
program's dual, one token constraint a source: Newton's method starts at 0; each iteration aggregates the dual's gradient and
curvature of all sources over their documents (already counted by source and size) at a few steps at once, keeps for each source the
step that leaves the least gradient, and narrows the bracket of the multiplier, which also bounds the next step. Sums are decimals, so
they don't depend on the order of rows. A dual that doesn't come within 1e-6 of a target raises an error.

Rates become copies by rounding down and dealing out one more copy to some documents of each size: sizes are walked through from
the largest down, what a size can't take or takes too much is carried to the next, so a source ends within about its
smallest documents of its target (within half of its largest one, where that is nearly all of it). Inside a size the documents with the smallest hashes get the copy. Sizes with many documents
are divided into bins by hash, so no task ranks more than a bounded share of a source. What is walked through in one task is a
source's table of sizes, not its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, saved
from .text import n_words, whole

#: Rows of a table of sources that may go to all executors (some 60 bytes each).
BROADCAST_ROWS = 200_000
#: Documents of one size and source that are ranked together; in large tables, more: see ``HOT``.
BIN = 256
#: Sizes that are divided, at most. They have more than one in so many of all documents, so there are no more of them.
HOT = 100_000
TOLERANCE, ITERATIONS = 1e-9, 200
CELL = ["key", "size", "times", "bin"]


def _key(source: Column) -> Column:
    """A source as a text that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with its rank by key from 0: ranks inside ranges of keys, and the number of rows in the ranges before."""
    dealt = saved(sizes.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "mix-sources")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition of the shuffle
    parts = dealt.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + inner).drop("part", "before")


def target_table(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(key, source_size, target) for (key, source_size): weights repeat over the keys in their order. Together the targets are
    ``share`` of all words, but none is over ``cap`` times its source's size; what is above is shared again by weight among
    the others until none is above. Each round is one aggregate over the sources."""
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    t = _ranked(sizes).select("key", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("limit"))
    level, n_full = 0.0, -1
    while True:
        full = F.col("limit") < level * F.col("weight")
        all_words, limits, free, n = t.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == n_full or not free:
            break
        level, n_full = (share * (all_words or 0) - limits) / free, n
    return t.select("key", "source_size", (F.least("limit", F.lit(level) * F.col("weight")) if free else F.col("limit")).alias("target"))


def _rate(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("z"), F.lit(math.log(cap)))))


def solve_dual(cells: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(key, lam, gap, moves) for ``sources`` (key, mean, target), whose targets are within reach, over ``cells`` (key, size, n):
    the multiplier, the part of the target that its rates miss, and the number of Newton iterations that moved it."""
    exact = lambda x: F.sum(x.cast("decimal(30,12)")).cast("double")
    state = saved(sources.select("key", "mean", (F.col("target") / F.col("mean")).alias("b"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                                 F.array(F.lit(0.0)).alias("tries"), F.lit(None).cast("double").alias("lam"), F.lit(1.0).alias("gap"), F.lit(-1).alias("moves")), "mix-dual")
    small = sources.count() <= BROADCAST_ROWS
    for _ in range(ITERATIONS):
        tries = state.select("key", "mean", "b", "lo", "hi", "moves", F.explode("tries").alias("lam"))
        rows = cells.join(F.broadcast(tries) if small else tries, "key").withColumn("z", F.col("size") / F.col("mean"))
        words, rate = F.col("z") * F.col("n"), _rate(cap)
        each = rows.groupBy("key", "mean", "b", "lo", "hi", "moves", "lam").agg(
            exact(words * rate).alias("have"), exact(F.when(rate < cap, words * F.col("z") * rate).otherwise(0.0)).alias("curve")).withColumn("gap", F.col("b") - F.col("have"))
        best = each.groupBy("key", "mean", "b", "moves").agg(
            F.min(F.struct(F.abs("gap").alias("left"), "lam", "gap", "curve")).alias("best"),
            F.max(F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("lo"))).alias("lo"), F.min(F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("hi"))).alias("hi"))
        lam, gap, lo, hi = F.col("best.lam"), F.col("best.gap"), F.col("lo"), F.col("hi")
        newton = lam + gap / F.when(F.col("best.curve") > 0, F.col("best.curve"))
        inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        wide = lambda x: 2 * F.greatest(F.lit(1.0), F.abs(x))
        middle = F.when(lo.isNull(), hi - wide(hi)).when(hi.isNull(), lo + wide(lo)).otherwise((lo + hi) / 2)
        steps = F.array_distinct(F.array_compact(F.array(F.when(inside, newton), F.when(inside, lam + (newton - lam) / 2), middle)))
        after = saved(best.select("key", "mean", "b", "lo", "hi", steps.alias("tries"), lam.alias("lam"), (F.col("best.left") / F.col("b")).alias("gap"), (F.col("moves") + 1).alias("moves")), "mix-dual")
        drop(state)
        state = after
        worst = state.agg(F.max("gap")).first()[0] or 0.0
        if worst <= TOLERANCE:
            break
    if worst > 1e-6:
        raise ArithmeticError(f"the dual of the mix misses a target by {worst:.1e} of it after {ITERATIONS} iterations")
    return state.select("key", "lam", "gap", "moves")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` with the columns size, source_size, target, rate, copies and taken (words, copies counted).

    Sizes are runs of characters that aren't ASCII blanks; null and empty texts have size 0 and get no copies. Null is a source
    of its own, last. Rows with the same doc_id, text and source are one document with the size of all, so they get the same number of
    copies, each. Columns of ``docs`` with the names of the new ones are replaced. An empty table gives an empty one. Reruns
    agree: order is by a hash of seed, doc_id and text. ``cap`` is a whole number of copies.
    """
    sized, plan, _ = _planned(docs, weights, share, cap, seed)
    drop(sized)
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    base = docs.drop(*new)
    out = base.withColumns({"h_": _hash(seed), "key_": _key(F.col("source"))}).join(plan, _same("h_", "key_"))
    return out.select(*base.columns, *new)


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The same decisions without the other columns: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized, plan, repeated = _planned(docs, weights, share, cap, seed)
    if repeated:
        plan = sized.drop("size").join(plan, _same("h", "key"))
    else:  # the plan has a row for each row already
        plan = plan.withColumnsRenamed({"k_id": "doc_id", "k_key": "key"})
    source = F.when(F.col("key") != "t", F.substr("key", F.lit(2)))
    return plan.select("doc_id", source.alias("source"), "size", "source_size", "target", "rate", "copies", "taken")


def _hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", whole("text"))


def _same(h: str, key: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col(key) == F.col("k_key")) & (F.col(h) == F.col("k_h"))


def balanced(cells: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(key, source_size, target, mean, lam) of every source, lam null where its target is all it may give, and the dual's report.
    ``cells`` has (key, size, n)."""
    if cap != int(cap) or cap < 1:
        raise ValueError("cap is a whole number of copies")
    sums = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_docs"))
    targets = target_table(sums.select("key", "source_size"), weights, share, cap)
    sources = saved(targets.join(sums.select("key", (F.col("source_size") / F.col("n_docs")).alias("mean")), "key"), "mix-targets")
    open_ = sources.where((F.col("target") > 0) & (F.col("target") < F.lit(cap * (1 - 1e-12)) * F.col("source_size")))
    dual = solve_dual(cells.where("size > 0"), open_, cap)
    return sources.join(dual.select("key", "lam"), "key", "left"), dual


#: Walks through the sizes of a source, largest first: (words, size, times, bin, n, f, less, more); what is carried on are words.
#: A size takes the number nearest to its due that the sizes after it can still make up for: together they can give up
#: ``less`` words and take ``more``. If none is (a document about as large as its source), it is the number nearest to the due. Blocks of 256 sizes are added up, so that a long table is not copied for every size.
_DUE = "(c.n * c.f + a.carry / c.words)"
_MOST, _LEAST = f"floor({_DUE} + c.less / c.words + 1e-9D)", f"ceil({_DUE} - c.more / c.words - 1e-9D)"
_TAKE = f"greatest(0L, least(c.n, cast(if({_LEAST} > {_MOST}, floor({_DUE} + 0.5D), greatest({_LEAST}, least({_MOST}, floor({_DUE} + 0.5D)))) AS bigint)))"
_WALK = f"""aggregate(sequence(0, (size(cs) - 1) div 256), struct(0D AS carry, cast(array() AS array<bigint>) AS m), (o, b) ->
    aggregate(slice(cs, b * 256 + 1, 256), struct(o.carry AS carry, cast(array() AS array<bigint>) AS m),
        (a, c) -> struct(a.carry + c.words * (c.n * c.f - {_TAKE}) AS carry, array_append(a.m, {_TAKE}) AS m), a -> struct(a.carry AS carry, concat(o.m, a.m) AS m)), o -> o.m)"""


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, cap: int, seed: str) -> tuple[DataFrame, DataFrame, bool]:
    """A row for each row of ``docs`` (doc_id, key, size, h), a plan row for each of the distinct ones, and whether there are fewer."""
    sized = saved(docs.select("doc_id", _key(F.col("source")).alias("key"), n_words("text").alias("size"), _hash(seed).alias("h")), "mix-sizes")
    rows = saved(sized.groupBy("doc_id", "key", "size", "h").agg(F.count("*").alias("times")), "mix-documents")
    counted = saved(rows.groupBy("key", "size", "times").agg(F.count("*").alias("n")), "mix-cells")
    cells = counted.groupBy("key", "size").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    sources, dual = balanced(cells, weights, share, cap)

    total, repeated = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("times"), F.lit(1))).first()
    most = max(BIN, -(-total // HOT))
    hot = counted.where(F.col("n") > most).select("key", "size", "times", F.ceil(F.col("n") / most).alias("bins"))
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    rows = rows.join(F.broadcast(hot), ["key", "size", "times"], "left").withColumn("bin", F.coalesce(F.floor(unit * F.col("bins")), F.lit(0)))
    parts = rows.groupBy(*CELL).agg(F.count("*").alias("n")).join(_small(sources), "key")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNotNull(), _rate(cap)).when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    parts = parts.withColumn("z", F.col("size") / F.col("mean")).withColumn("rate", F.round(rate, 9)).withColumn("low", F.floor("rate"))
    parts = saved(parts.select(*CELL, "n", "source_size", "target", "rate", "low", (F.col("size") * F.col("times")).alias("words"), F.round(F.col("rate") - F.col("low"), 9).alias("f")), "mix-parts")
    after = Window.partitionBy("key").orderBy(*[F.desc(c) for c in ("words", "size", "times", "bin")]).rowsBetween(1, Window.unboundedFollowing)
    rest = lambda x: F.coalesce(F.sum(F.col("words") * F.col("n") * x).over(after), F.lit(0.0))
    table = parts.where("f > 0").withColumns({"less": rest(F.col("f")), "more": rest(1 - F.col("f"))})
    table = table.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("words", "size", "times", "bin", "n", "f", "less", "more")), False).alias("cs"))
    more = table.select("key", F.explode(F.arrays_zip("cs", F.expr(_WALK).alias("m"))).alias("x")).select("key", "x.cs.size", "x.cs.times", "x.cs.bin", "x.m")
    plan = saved(parts.join(more, CELL, "left").select(*CELL, "source_size", "target", "rate", "low", F.coalesce("m", F.lit(0)).alias("m")), "mix-plan")
    # Both sides are dealt by the cell, and so is the window.
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy("h", "doc_id"))
    rows = rows.join(plan, CELL).withColumn("copies", F.col("low") + (rank <= F.col("m")).cast("long"))
    drop(parts)
    return sized, rows.select(
        F.col("doc_id").alias("k_id"), F.col("key").alias("k_key"), F.col("h").alias("k_h"),
        "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")), repeated > 1
