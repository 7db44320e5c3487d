"""Personal data: patterns, and information-theoretic sanitisation of the terms that give it away.

Patterns find the protected entities (addresses, numbers). What other terms reveal about an entity is estimated from the
corpus: pointwise mutual information ln(p(entity | term) / p(entity)) of a term and an entity of the same document, against the
entity's own information ln(1 / p(entity)), with p(entity) = n_entity / n and p(entity | term) smoothed by ``PRIOR`` documents
of the corpus's own rate: (n_both + PRIOR * p(entity)) / (n_term + PRIOR). Counts are of documents, n_term of all documents. A
term whose share reaches ``remove`` goes, one that reaches ``generalise`` is replaced by its kind, wherever it stands in
documents with the entity.

All of it is DataFrame operations. Texts are read three times and never shuffled, except in ``sanitised``, whose texts meet
their spans; mentions, the terms of documents that have any and counts are shuffled after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved
from .text import whole

#: Fixed patterns by kind, in the order of the kinds. Possessive loops and guards at the front only spare the search for
#: starts that can't match; what matches is as without them.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain to be searched.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[\p{L}][\p{L}\p{N}'-]*+"
#: Documents of the corpus's own rate that an estimate starts from.
PRIOR = 1.0
#: Terms of more than this share of all documents stay out of shuffles where their count alone rules them out.
COMMON = 1e-3
BROADCAST_ROWS = 200_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    return F.length(_digits(value)).between(10, 15) if kind == "phone" else F.lit(True)


def _placed(m: str, gaps: str) -> Column:
    """(start, end, value) of each of the matches ``m``, from what stands between them.

    Positions are code points. Blocks of matches are added up, so that a long text is not copied for every match.
    """
    kind = "cast(array() AS array<struct<start:int,end:int,value:string>>)"
    block = (
        f"aggregate(sequence(b * 256, least(b * 256 + 255, size({m}) - 1)), struct(o.at AS at, {kind} AS s), (acc, i) -> struct(acc.at + {gaps}[i] + length({m}[i]) AS at, "
        f"array_append(acc.s, named_struct('start', acc.at + {gaps}[i], 'end', acc.at + {gaps}[i] + length({m}[i]), 'value', {m}[i])) AS s), acc -> struct(acc.at AS at, concat(o.s, acc.s) AS s))")
    return F.expr(f"if(size({m}) = 0, {kind}, aggregate(sequence(0, (size({m}) - 1) div 256), struct(0 AS at, {kind} AS s), (o, b) -> {block}, o -> o.s))")


def _matches(name: str, pattern: str, when: Column) -> dict[str, Column]:
    found, gaps = F.regexp_extract_all("text", F.lit(pattern), 0), F.transform(F.split("text", pattern, -1), F.length)
    return {f"m_{name}": F.when(when, found).otherwise(F.expr("cast(array() AS array<string>)")), f"g_{name}": F.when(when, gaps).otherwise(F.expr("cast(array() AS array<int>)"))}


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, h, own, terms) of each distinct (doc_id, h) in ``docs`` (doc_id, h, text) whose text has valid matches: these
    as an array of (start, rank, end, value), and all terms of the text as an array of (start, end, value)."""
    hinted = F.lit(False)
    for kind in KINDS:
        hinted = hinted | F.col("text").rlike(HINTS[kind])
    found, own = docs.where(hinted), []
    for rank, kind in enumerate(KINDS):
        found = found.withColumns(_matches(kind, PATTERNS[kind], F.col("text").rlike(HINTS[kind])))
        valid = F.filter(_placed(f"m_{kind}", f"g_{kind}"), lambda x: _valid(kind, x["value"]))  # noqa: B023
        own.append(F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value"))))  # noqa: B023
    # Rows without a match leave in the explosion, so nothing is searched twice for a filter.
    found = found.select("doc_id", "h", "text", F.explode(F.filter(F.array(F.concat(*own)), lambda a: F.size(a) > 0)).alias("own"))
    found = found.withColumns(_matches("term", TERM, F.lit(True))).select("doc_id", "h", "own", _placed("m_term", "g_term").alias("terms"))
    return found.dropDuplicates(["doc_id", "h"])


def disclosures(docs: DataFrame, found: DataFrame, n: int, generalise: float) -> DataFrame:
    """(doc_id, h, term, share): terms that reveal at least ``generalise`` of the information of an entity in the same
    document, and the most that they reveal of any."""
    held = found.select("doc_id", "h", F.explode(F.array_distinct(F.transform("own", lambda s: F.struct(s["rank"].alias("rank"), s["value"].alias("value"))))).alias("e"))
    held = held.select(F.col("doc_id").alias("e_id"), F.col("h").alias("e_h"), "e.rank", "e.value")
    entities = saved(held.groupBy("rank", "value").agg(F.count("*").alias("n_e")).where(F.col("n_e") < n), "entities")
    n_entities, top = entities.agg(F.count("*"), F.coalesce(F.max("n_e"), F.lit(0))).first()
    words = docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), 0)), F.lower))).alias("term"))
    counts = saved(words.groupBy("term").agg(F.count("*").alias("n_t")), "term-counts")
    # In more documents than this a term can't reveal enough of an entity, even if it stands with each of its mentions.
    most = lambda n_e: 1 + n_e**generalise * max(n, 1) ** (1 - generalise) * (1 + PRIOR / max(n, 1))
    common = counts.where(F.col("n_t") > max(most(top), COMMON * n)).select("term")
    terms = found.select("doc_id", "h", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t["value"])))).alias("term"))
    terms = terms.join(F.broadcast(common), "term", "left_anti").join(counts.where(F.col("n_t") <= most(top)), "term")
    held = held.join(F.broadcast(entities) if n_entities <= BROADCAST_ROWS else entities, ["rank", "value"])
    here = F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("h") == F.col("e_h"))
    pairs = saved(terms.join(held, here & (F.col("n_t") <= most(F.col("n_e")))).select("doc_id", "h", "rank", "value", "term", "n_t", "n_e"), "entity-terms")
    rate = F.col("n_e") / n
    share = F.log((F.col("n_b") + PRIOR * rate) / (F.col("n_t") + PRIOR) / rate) / F.log(1 / rate)
    told = pairs.groupBy("rank", "value", "term", "n_t", "n_e").agg(F.count("*").alias("n_b")).withColumn("share", F.round(share, 9))
    told = saved(told.where(F.col("share") >= generalise).select("rank", "value", "term", "share"), "disclosing-terms")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    return pairs.join(told, ["rank", "value", "term"]).groupBy("doc_id", "h", "term").agg(F.max("share").alias("share"))


def find_spans(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """doc_id, h and spans for every distinct (doc_id, text) of ``docs``: an array of (start, rank, end, kind), sorted.

    Kinds of the base are email, ip, card and phone; the method adds ``generalised`` and ``removed`` terms, which never
    overlap a base span. Null texts are empty and have none; a null doc_id is an id like others here.
    """
    docs = docs.select("doc_id", F.xxhash64(whole("text")).alias("h"), whole("text").alias("text"))
    found = saved(mentions(docs), "mentions")
    told = disclosures(docs, found, docs.count(), generalise).withColumnsRenamed({"doc_id": "t_id", "h": "t_h", "term": "t_term"})
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.rank") + 1)
    base = found.select("doc_id", "h", F.explode("own").alias("s")).select("doc_id", "h", "s.start", "s.rank", "s.end", name.alias("kind"))
    kind = F.when(F.col("share") >= remove, F.lit("removed")).otherwise(F.lit("generalised"))
    terms = found.select("doc_id", "h", F.explode("terms").alias("t")).select("doc_id", "h", "t.start", "t.end", F.lower("t.value").alias("term"))
    terms = terms.join(told, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")) & (F.col("term") == F.col("t_term")))
    terms = terms.select("doc_id", "h", "start", F.lit(len(KINDS)).alias("rank"), "end", kind.alias("kind"))
    spans = base.unionByName(terms)
    spans = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("all"))
    own = F.expr(f"filter(all, s -> s.rank < {len(KINDS)})")
    free = F.expr(f"filter(all, s -> s.rank < {len(KINDS)} or not exists(own, b -> b.start < s.end and s.start < b.end))")
    return spans.withColumn("own", own).select("doc_id", "h", free.alias("spans"))


def with_spans(docs: DataFrame, **how) -> DataFrame:
    """A row for each row of ``docs``: doc_id, h and spans (empty where there are none)."""
    rows = docs.select("doc_id", F.xxhash64(whole("text")).alias("h"))
    spans = find_spans(docs, **how).withColumnsRenamed({"doc_id": "s_id", "h": "s_h"})
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    return out.select("doc_id", F.coalesce("spans", F.expr("cast(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")).alias("spans"))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every span of its texts replaced: base spans and generalised terms by their kind in brackets, removed
    terms by nothing. Of overlapping spans the first counts. Other columns are passed on; null texts stay null."""
    spans = find_spans(docs, **how).withColumnsRenamed({"doc_id": "s_id", "h": "s_h", "spans": "spans_"})
    rows = docs.withColumn("h_", F.xxhash64(whole("text"))).join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h_") == F.col("s_h")), "left")
    fold = (
        "aggregate(spans_, struct(0 AS at, cast(array() AS array<string>) AS s), (acc, x) -> if(x.start < acc.at, acc, struct(x.end AS at, "
        "concat(acc.s, array(substring(text, acc.at + 1, x.start - acc.at), case x.kind when 'removed' then '' when 'generalised' then '[word]' else concat('[', x.kind, ']') end)) AS s)), "
        "acc -> concat(array_join(acc.s, ''), substring(text, acc.at + 1)))")
    return rows.withColumn("text", F.when(F.col("spans_").isNull(), F.col("text")).otherwise(F.expr(fold))).select(*docs.columns)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
