"""Operators over ordered units of documents: islands, bins, anchors, longest names, grouped splits, nearest texts."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NUMERALS, UNITS, article_number, squashed


def islands(units: DataFrame, by: str, order: str, block: str, kept: Column) -> DataFrame:
    """``units`` that are ``kept``, with ``island``: runs of equal ``block`` of a document, numbered from 1. A unit that isn't kept
    ends the run."""
    w = Window.partitionBy(by).orderBy(order)
    new = ~F.col(block).eqNullSafe(F.lag(block).over(w)) | ~F.coalesce(F.lag("kept_").over(w), F.lit(False))
    out = units.withColumn("kept_", kept).withColumn("new_", (F.col("kept_") & new).cast("long"))
    return out.withColumn("island", F.sum("new_").over(w)).where("kept_").drop("kept_", "new_")


def bins_by_budget(items: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """``items`` with ``bin`` from 0: bins of a group are filled in order, and an item that doesn't fit opens the next one; one that
    is larger than ``budget`` is alone. The fold holds the sizes of one group."""
    keys = F.sort_array(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("n_"))))
    step = (
        f"(a, x) -> if(a.b >= 0 and a.s + x.n_ <= {int(budget)}, struct(a.b AS b, a.s + x.n_ AS s, array_append(a.bins, a.b) AS bins), "
        "struct(a.b + 1 AS b, x.n_ AS s, array_append(a.bins, a.b + 1) AS bins))")
    fold = F.expr(f"aggregate(k_, struct(-1 AS b, 0L AS s, cast(array() AS array<int>) AS bins), {step}, a -> a.bins)")
    bins = items.groupBy(by).agg(keys.alias("k_")).select(by, F.explode(F.arrays_zip("k_", fold.alias("bin"))).alias("x"))
    bins = bins.select(by, *[F.col(f"x.k_.{c}").alias(c) for c in order], "x.bin")
    return items.join(bins, [by, *order])


def article_blocks(lines: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """(by, block, path, number, n_lines, body): a line that starts with an article's label opens a block, 0 is what stands before the
    first one; chapter lines aren't in blocks but are the ``path`` of what follows, and divide a block. Lines are joined by \\n; null
    lines belong to no block. ``order`` must be unique in a document, whose lines are sorted in one task."""
    w, signs = Window.partitionBy(by).orderBy(order), "".join([*NUMERALS, *UNITS])
    chapter, article = F.col(text).rlike(rf"^第\s*[{signs}0-9]+\s*章"), F.col(text).rlike(rf"^第\s*[{signs}0-9]+\s*条")
    out = lines.where(F.col(text).isNotNull()).withColumns({"chapter_": chapter, "article_": article})
    out = out.withColumns({"block": F.sum(F.col("article_").cast("long")).over(w), "path": F.last(F.when(F.col("chapter_"), F.col(text)), ignorenulls=True).over(w)})
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    blocks = out.where("not chapter_").groupBy(by, "block", "path").agg(F.count("*").alias("n_lines"), F.transform(rows, lambda x: x["t"]).alias("l_"))
    return blocks.select(by, "block", "path", article_number(F.get("l_", F.lit(0))).alias("number"), "n_lines", F.array_join("l_", "\n").alias("body"))


def without_contents(lines: DataFrame, by: str, order: str, text: str = "text", within: int = 40, reach: int = 300, most: int = 60) -> DataFrame:
    """``lines`` without a document's table of contents. It begins with a line 目录 among the first ``within`` ones, and ends where its
    first entry stands again in the next ``reach`` lines; if it doesn't, with the short lines (``most`` characters, no full stop
    at the end) that follow. Lines of a document are numbered from 0; null lines are short and equal to none. What is
    added up is a row a document, and nothing is sorted."""
    n, t = F.col(order), F.col(text)
    head = lines.where((n < within) & t.rlike(r"^\s*目\s*[录次]\s*$")).groupBy(by).agg(F.min(order).alias("k_"))
    after = lines.join(head, by).where(n > F.col("k_"))
    long = ~F.coalesce((F.length(t) <= most) & ~t.endswith("。"), F.lit(True))
    ends = after.groupBy(by).agg(F.min(F.when(long, n)).alias("end_"), (F.max(n) + 1).alias("all_"), F.max(F.when(n == F.col("k_") + 1, t)).alias("first_"))
    again = (n > F.col("k_") + 1) & (n < F.col("k_") + reach) & (t == F.col("first_")) & (F.coalesce("end_", "all_") > F.col("k_") + 1)
    back = after.join(ends, by).where(again).groupBy(by).agg(F.min(order).alias("back_"))
    cut = head.join(ends, by, "left").join(back, by, "left").select(by, "k_", F.coalesce("back_", "end_", "all_", F.col("k_") + 1).alias("j_"))
    gone = F.coalesce((n >= F.col("k_")) & (n < F.col("j_")), F.lit(False))
    return lines.join(cut, by, "left").where(~gone).select(lines.columns)


def outline(lines: DataFrame, by: str, order: str, level: str, text: str = "text", levels: int = 6) -> DataFrame:
    """``lines`` with ``path`` (the headings that a line stands under, its own among them, outermost first) and ``section``, the number of the
    heading in its document, 0 before the first. ``level`` is 1 to ``levels`` for headings and null for other lines; a heading closes those of
    its level and below. ``order`` is unique in a document, whose lines are sorted in one task."""
    w = Window.partitionBy(by).orderBy(order)
    last = lambda c: F.last(F.when(c, F.struct(F.col(order).alias("o"), F.col(text).alias("t"))), ignorenulls=True).over(w)
    rows = lines.withColumns({f"at{i}_": last(F.col(level) == i) for i in range(1, levels + 1)} | {f"up{i}_": last(F.col(level) < i)["o"] for i in range(2, levels + 1)})
    open_ = [F.when(F.lit(True) if i == 1 else F.coalesce(F.col(f"at{i}_.o") > F.col(f"up{i}_"), F.col(f"up{i}_").isNull()), F.col(f"at{i}_.t")) for i in range(1, levels + 1)]
    rows = rows.withColumns({"path": F.array_compact(F.array(*open_)), "section": F.count(level).over(w)})
    return rows.select(*lines.columns, "path", "section")


def anchor_join(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(anchor, quote, chunk_id) for asked (anchor, quote) and chunks (chunk_id, text, anchors, split_part): if all chunks of an
    anchor are pieces of a divided paragraph, only those with the quote count, unless none has it."""
    by_anchor = chunks.select("chunk_id", squashed(F.col("text")).alias("body"), "split_part", F.explode("anchors").alias("anchor"))
    rows = asked.join(by_anchor, "anchor").withColumn("key", squashed(F.col("quote")))
    w = Window.partitionBy("anchor", "quote")
    rows = rows.withColumns({"hit": (F.col("key") != "") & F.contains("body", "key"), "pieces": F.every(F.col("split_part").isNotNull()).over(w)})
    return rows.withColumn("any", F.some("hit").over(w)).where("hit or not any or not pieces").select("anchor", "quote", "chunk_id").distinct()


def concepts_of_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, concepts): the concepts whose edges' evidence recalls a chunk. Edges have (concept, anchor, quote)."""
    found = edges.join(anchor_join(edges.select("anchor", "quote").distinct(), chunks).withColumnRenamed("quote", "q"), "anchor")
    return found.where(F.col("quote").eqNullSafe(F.col("q"))).groupBy("chunk_id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _contained(texts: pd.Series, names: pd.Series) -> pd.Series:
    def of(text: str, pool) -> list[str]:
        taken, out = np.zeros(len(text), bool), []
        for name in sorted({n for n in pool if n}, key=lambda n: (-len(n), n)):
            at = text.find(name)
            while at >= 0 and taken[at : at + len(name)].any():
                at = text.find(name, at + 1)
            if at >= 0:
                taken[at : at + len(name)] = True
                out.append(name)
        return out

    return pd.Series([of(t or "", [] if p is None else p) for t, p in zip(texts, names, strict=True)])


def longest_names(docs: DataFrame, names: DataFrame, text: str = "text", max_names: int = 100_000) -> DataFrame:
    """``docs`` with ``found``: the names (name) in the text, longest first; a place that a longer name has taken is taken. The
    names are a dictionary of at most ``max_names`` entries, which goes to all executors; more raise an error."""
    if names.count() > max_names:
        raise ValueError(f"more than {max_names} names")
    pool = names.agg(F.collect_set("name").alias("names_"))
    return docs.crossJoin(F.broadcast(pool)).withColumn("found", _contained(text, "names_")).drop("names_")


# Fixed value: what divides a term into several.
DIVIDERS = r"[、，,/；;（）()]|和|与|及"


def _substrings(text: Column, least: int, most: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    sizes = lambda i: F.filter(F.sequence(F.lit(least), F.greatest(most, F.lit(least))), lambda m: i + m - 1 <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(sizes(i), lambda m: F.substring(text, i, m)))))


def link_terms(asked: DataFrame, concepts: DataFrame, least: int = 3) -> DataFrame:
    """(id, chapter, term, names, how) for each distinct row of asked (id, chapter, term): the concepts (name, chapter) that a term names.

    Names and terms are compared by letters and digits. Concepts of the same chapter come before all (``same``, ``cross``); among them the
    term itself (``exact``), its parts (``split``), names of ``least`` letters or more in it, longest first and not overlapping
    (``contains``), then the two shortest names that it stands in (``within``). Without any, names are empty and how is ``none``; a
    null chapter is no chapter, a null term has no name. Substrings meet names by equality, so nothing is compared pair by pair."""
    keyed = asked.select("id", "chapter", "term").distinct().withColumn("key", squashed(F.col("term")))
    names = concepts.select(squashed(F.col("name")).alias("name"), F.col("chapter").alias("of")).where("name <> ''").distinct()
    longest = F.lit(names.agg(F.max(F.length("name"))).first()[0] or 0)
    parts = F.filter(F.transform(F.split("term", DIVIDERS), squashed), lambda x: F.length(x) >= 2)
    looks = F.array(F.struct(F.lit(0).alias("way"), F.col("key").alias("look")))
    looks = F.concat(looks, F.when(F.size(parts) > 1, F.transform(parts, lambda x: F.struct(F.lit(1).alias("way"), x.alias("look")))).otherwise(F.slice(looks, 1, 0)))
    looks = F.concat(looks, F.transform(_substrings(F.col("key"), least, longest), lambda x: F.struct(F.lit(2).alias("way"), x.alias("look"))))
    inside = keyed.where("key <> ''").select("*", F.inline(looks)).join(names, F.col("look") == F.col("name"))
    around = names.select("*", F.explode(_substrings(F.col("name"), least, F.length("name"))).alias("look"))
    around = keyed.join(around, F.col("key") == F.col("look")).withColumn("way", F.lit(3))
    columns = ["id", "chapter", "term", "key", "way", "name", "of"]
    found = inside.select(columns).unionByName(around.select(columns))
    scopes = F.when(F.col("chapter") == F.col("of"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    group = ["id", "chapter", "term", "key", "scope", "way"]
    found = found.withColumn("scope", F.explode(scopes)).select(*group, "name").distinct()
    few = found.where("way = 3").withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.length("name"), "name"))).where("r <= 2").drop("r")
    sets = found.where("way < 3").unionByName(few).groupBy(group).agg(F.array_sort(F.collect_set("name")).alias("names"))
    best = sets.groupBy("id", "chapter", "term", "key").agg(F.min(F.struct("scope", "way", "names")).alias("x"))
    how = F.concat(F.element_at(F.array(*map(F.lit, ["exact", "split", "contains", "within"])), F.col("x.way") + 1), F.when(F.col("x.scope") == 0, ":same").otherwise(":cross"))
    best = best.withColumn("names", F.when(F.col("x.way") == 2, _contained("key", "x.names")).otherwise(F.col("x.names")))
    best = best.select(*[F.col(c).alias(f"{c}_") for c in ("id", "chapter", "term")], "names", how.alias("how"))
    same = [keyed[c].eqNullSafe(best[f"{c}_"]) for c in ("id", "chapter", "term")]
    out = keyed.join(best, same[0] & same[1] & same[2], "left")
    return out.select("id", "chapter", "term", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("how", F.lit("none")).alias("how"))


@F.pandas_udf(T.IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring; null texts are empty. Halves the length: substrings of one length are hashed."""
    def of(x: str, y: str) -> int:
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            have = {x[i : i + mid] for i in range(len(x) - mid + 1)}
            lo, hi = (mid, hi) if any(y[i : i + mid] in have for i in range(len(y) - mid + 1)) else (lo, mid - 1)
        return lo

    return pd.Series([of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def coverage(key: pd.Series, text: pd.Series) -> pd.Series:
    """Share of ``key`` in matching blocks of ``text`` (Ratcliff and Obershelp); 0 for an empty key."""
    def of(k: str, t: str) -> float:
        blocks = difflib.SequenceMatcher(None, k, t, autojunk=False).get_matching_blocks()
        return sum(b.size for b in blocks) / len(k) if k else 0.0

    return pd.Series([of(k or "", t or "") for k, t in zip(key, text, strict=True)])


def grouped_split(items: DataFrame, group: str, topic: str, test_size: float = 0.08, most: float = 0.10, max_share: float = 0.06) -> tuple[DataFrame, DataFrame]:
    """(train, test) of ``items``: whole groups, none of more than ``max_share`` of all rows, by quotas of the groups' main topics, then
    the largest that still fit until the test part has ``test_size`` of the rows; never more than ``most`` unless one group is all there is.

    Rows are counted in Spark; the choice is among groups, of which there are few (a row each on the driver). Null is a group."""
    n = F.count("*").alias("n")
    counts = items.groupBy(group, topic).agg(n).groupBy(group).agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col(topic).alias("t")))["t"].alias("topic"))
    rows = [(r[group], r.n, r.topic or "") for r in counts.collect()]
    total = sum(r[1] for r in rows)
    order = lambda r: (-r[1], str(r[0]))
    eligible = sorted([r for r in rows if r[1] <= max_share * total] or rows, key=order)
    lo, hi, chosen = total * test_size, total * most, []
    for t in sorted({r[2] for r in eligible}):
        mine = [r for r in eligible if r[2] == t]
        quota, have = sum(r[1] for r in mine) / total * lo, 0
        for r in mine:
            if have < quota and have + r[1] <= hi:
                chosen.append(r)
                have += r[1]
    size = sum(r[1] for r in chosen)
    for r in [*eligible, *reversed(eligible)]:
        if size < lo and r not in chosen and size + r[1] <= hi:
            chosen.append(r)
            size += r[1]
    for r in sorted(chosen, key=lambda r: (r[1], str(r[0]))):
        if size > hi and len(chosen) > 1:
            chosen.remove(r)
            size -= r[1]
    if not chosen and eligible:
        chosen = [min(eligible, key=lambda r: (r[1], str(r[0])))]
    picked = items.sparkSession.createDataFrame([(r[0],) for r in chosen], items.select(F.col(group).alias("g_")).schema)
    same = items[group].eqNullSafe(picked["g_"])
    return items.join(F.broadcast(picked), same, "left_anti"), items.join(F.broadcast(picked), same, "left_semi")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows by a hash of seed and key: the same ones in every run."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
