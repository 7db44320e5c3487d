"""URL filters: rules first, then the ratio of two character language models.

The models are variable-order Markov models of accepted and rejected URLs: counts of the characters that follow each
context of up to ``order`` characters, each order smoothed by the next shorter one. A URL's score is the
log-likelihood difference a character; the cut is the highest one below which at most ``max_false`` of held-out accepted URLs fall. Both models are learned from the
URLs that the rules decide, half of them for the counts and half for the cut, chosen by a hash.

All of it is DataFrame operations. Scores are computed once for every distinct window of ``order`` + 1 characters. A URL's windows
are rows of a 16-byte digest and the window, never of the URL itself, so work is linear in its length. While the scores of all windows are few they
go to all executors, and a URL's windows are added up where they are made; beyond that, windows that very many URLs have
(schemes, common hosts) still go to all executors and only the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import split_join
from .store import drop, saved
from .text import ascii_lower, whole

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
PAD, END = "\u0002", "\u0003"
#: Rows of a score table that may go to all executors (some 60 bytes each).
BROADCAST_ROWS = 500_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # longer ones are asked first, so they come last here
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(url: Column, order: int) -> Column:
    """The ``order`` + 1 characters that end at each character of the URL and at its end: one pass of a pattern."""
    padded = F.concat(F.lit(PAD * order), whole(url), F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), 1)


def score_windows(counts: DataFrame, windows: DataFrame, order: int, strength: float) -> DataFrame:
    """(w, n, llr) for every window (w, n): log P_accepted(last | before) - log P_rejected(last | before), smoothed down the orders.

    ``counts`` has (w, accepted, rejected), how often each window was seen. The shortest order leans on a uniform
    one over 256 characters.
    """
    out = windows.withColumns({"p_a": F.lit(1 / 256), "p_r": F.lit(1 / 256)})
    for k in range(order + 1):
        gram = F.expr(f"substring(w, {order + 1 - k}, {k + 1})")
        grams = counts.groupBy(gram.alias("g")).agg(F.sum("accepted").alias("ga"), F.sum("rejected").alias("gr"))
        contexts = grams.groupBy(F.expr(f"substring(g, 1, {k})").alias("c")).agg(F.sum("ga").alias("ca"), F.sum("gr").alias("cr"))
        # Of grams of one character there are no more than there are characters; many windows share them.
        grams, contexts = F.broadcast(grams) if k == 0 else grams, F.broadcast(contexts) if k <= 1 else contexts
        out = out.withColumns({"g": gram, "c": F.expr(f"substring(w, {order + 1 - k}, {k})")}).join(grams, "g", "left").join(contexts, "c", "left")
        p = lambda n, total, lower: (F.coalesce(n, F.lit(0)) + strength * F.col(lower)) / (F.coalesce(total, F.lit(0)) + strength)
        out = out.select("w", "n", p(F.col("ga"), F.col("ca"), "p_a").alias("p_a"), p(F.col("gr"), F.col("cr"), "p_r").alias("p_r"))
    return out.select("w", "n", F.log(F.col("p_a") / F.col("p_r")).alias("llr"))


def score_urls(urls: DataFrame, order: int = 4, strength: float = 2.0, max_false: float = 0.01) -> tuple[DataFrame, float | None]:
    """``urls`` has (id, url, verdict), the verdict null where no rule fits. Returns (id, score) and the cut.

    Without URLs of both verdicts there is no cut.
    """
    windows = saved(
        urls.select("verdict", (F.pmod(F.xxhash64("url"), F.lit(2)) == 0).alias("fit"), F.explode(_windows(F.col("url"), order)).alias("w"))
        .groupBy("w").agg(F.count("*").alias("n"), *(F.count(F.when((F.col("verdict") == v) & F.col("fit"), 1)).alias(c) for v, c in (("allow", "accepted"), ("block", "rejected")))), "url-windows")
    counts = windows.where("accepted + rejected > 0")
    table = saved(score_windows(counts, windows.select("w", "n"), order, strength), "url-scores")
    n_windows, total = windows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = urls.select("id", F.explode(_windows(F.col("url"), order)).alias("w"))
    each = each.join(F.broadcast(table), "w") if n_windows <= BROADCAST_ROWS else split_join(each, table, "w", "n", total)
    scores = saved(each.groupBy("id").agg(F.round(F.avg("llr"), 9).alias("score")), "url-sums")
    drop(windows, table)
    held = scores.join(urls.where("verdict is not null").select("id", "verdict", (F.pmod(F.xxhash64("url"), F.lit(2)) == 1).alias("held")), "id")
    # Accepted URLs below every cut, from counts by thousandths of a nat: rows are the bins, not the URLs.
    bins = held.where("held").groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(*(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")))
    everything = Window.partitionBy()
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"lost": F.coalesce(F.sum("allow").over(before), F.lit(0)) / F.sum("allow").over(everything), "blocked": F.sum("block").over(everything)})
    best = bins.where((F.col("lost") <= max_false) & (F.col("blocked") > 0)).orderBy(F.desc("bin")).first()
    return scores, None if best is None else best.bin / 1000


def judge_urls(pages: DataFrame, rules=RULES, order: int = 4, strength: float = 2.0, max_false: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, score, verdict for every row of ``pages``.

    A URL without ``://`` and a null one have empty host and path. The longest rule that fits decides; else the URL is
    allowed if its score reaches the cut, or if there is no cut. Equal URLs are scored once and repeated rows stay. Other columns are
    ignored; an empty table gives an empty result.
    """
    url = whole("url")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "r.rule", "r.verdict")
    urls = saved(rows.groupBy("url").agg(F.first("verdict").alias("verdict"), F.count("*").alias("n")).withColumn("id", F.unhex(F.md5("url"))), "urls")
    scores, cut = score_urls(urls, order, strength, max_false)
    judged = F.when(F.col("score") >= cut, "allow").otherwise("block") if cut is not None else F.lit("allow")
    rows = rows.withColumn("id", F.unhex(F.md5("url"))).drop("url")
    return split_join(rows, scores.join(urls.select("id", "n"), "id"), "id", "n", pages.count()).select("page_id", "host", "path", "rule", "score", F.coalesce("verdict", judged).alias("verdict"))
