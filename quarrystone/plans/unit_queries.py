"""Queries that apply the library's functions and unit operators to whole tables, each with its SQL where DuckDB can say it.

The tables hold no Han texts, so labels, options, keys and dates are spelled out of columns first (the same SQL for both engines) and
read back by the functions; the SQL of such a query states what must come back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import bm25_index, chunking, units
from . import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _query(table: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function of a whole table as a query of its name, with its SQL if there is any."""
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _digit(n: str) -> str:
    return f"substr('一二三四五六七八九', CAST({n} AS INT), 1)"


_H, _T, _O = "floor((p_partkey % 999 + 1) / 100)", "floor((p_partkey % 999 + 1) % 100 / 10)", "((p_partkey % 999 + 1) % 10)"
LABEL = (
    f"concat('第', CASE WHEN {_H} > 0 THEN concat({_digit(_H)}, '百') ELSE '' END, CASE WHEN {_T} > 0 THEN concat({_digit(_T)}, '十') WHEN {_H} > 0 AND {_O} > 0 THEN '零' ELSE '' END, "
    f"CASE WHEN {_O} > 0 THEN {_digit(_O)} ELSE '' END, '条')"
)
DATED = "concat('（', CAST(year(o_orderdate) AS STRING), '年', CAST(month(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE 0 END AS STRING), ' 月', CAST(day(o_orderdate) AS STRING), '日通过）')"


@_query("documents", f"""
WITH r AS (SELECT doc_id, regexp_extract_all(lower(translate(coalesce(text, ''), '{WIDE}', '{NARROW.replace("'", "''")}')), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+') AS runs FROM documents),
t AS (SELECT doc_id, flatten(list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '^[a-z0-9]') OR len(x) = 1 THEN [x] ELSE list_transform(range(1, len(x)), lambda i: substr(x, i, 2)) END)) AS terms FROM r)
SELECT doc_id, len(terms) AS n_terms, md5(array_to_string(terms, ' ')) AS digest FROM t""")
def search_terms(documents: DataFrame) -> DataFrame:
    terms = documents.select("doc_id", sc.words(F.col("text")).alias("t"))
    return terms.select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@_query("part", f"SELECT p_partkey, {LABEL} AS label, p_partkey % 999 + 1 AS number FROM part")
def article_numbers(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_partkey", f"{LABEL} AS label").withColumn("number", sc.article_number(F.col("label")))


@_query("part", "SELECT p_partkey, 3 AS n, p_name AS a, p_brand AS b, p_type AS c FROM part")
def option_maps(part: DataFrame) -> DataFrame:
    read = part.select("p_partkey", sc.options(F.concat(F.lit("A. "), "p_name", F.lit(" B．"), "p_brand", F.lit(" C. "), "p_type")).alias("m"))
    return read.select("p_partkey", F.size("m").alias("n"), *[F.element_at("m", x).alias(x.lower()) for x in "ABC"])


@_query("part", """
SELECT p_partkey, p_name AS point, p_size AS weight FROM part UNION ALL
SELECT p_partkey, concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN '。' ELSE '' END), 100 - p_size FROM part""")
def scoring_points(part: DataFrame) -> DataFrame:
    """Keys in the older form for even ids and in the newer one for odd ids."""
    older = F.format_string("（1）（占%d%%）%s；（2）（占%d%%）%s。", "p_size", "p_name", 100 - F.col("p_size"), "p_type")
    newer = F.format_string("（1）%s（%d%%）；（2）%s（%d%%）。", "p_name", "p_size", "p_type", 100 - F.col("p_size"))
    key = F.when(F.col("p_partkey") % 2 == 0, older).otherwise(newer)
    return part.select("p_partkey", F.inline(sc.scoring(key)))


@_query("part", "SELECT p_partkey, concat(p_name, '？|', p_type, '？“', p_brand, '”') AS parts, p_brand AS terms FROM part")
def question_parts(part: DataFrame) -> DataFrame:
    text = F.concat(F.lit("（0）“ "), "p_brand", F.lit(" ”【分析问题】（1）"), "p_name", F.lit("？（2） "), "p_type", F.lit("？“"), "p_brand", F.lit("”"))
    return part.select("p_partkey", F.array_join(sc.sub_questions(text), "|").alias("parts"), F.array_join(sc.quoted_terms(text), "|").alias("terms"))


def _marks(x: str) -> str:
    out = f"translate({x}, '［］【】〔〕', '[][][]')"
    for k in "SCQP":
        out = f"regexp_replace({out}, '\\[\\s*[{k}{k.lower()}]\\s*(\\d+)\\s*\\]', '[{k}\\1]', 'g')"
    return out


@_query("documents", f"SELECT doc_id, md5({_marks('''concat('见［ s ', CAST(doc_id AS STRING), ' ］和【q', CAST(length(text) AS STRING), '】：', text)''')}) AS digest FROM documents")
def marker_forms(documents: DataFrame) -> DataFrame:
    marked = F.concat(F.lit("见［ s "), F.col("doc_id").cast("string"), F.lit(" ］和【q"), F.length("text").cast("string"), F.lit("】："), "text")
    return documents.select("doc_id", F.md5(sc.markers(marked)).alias("digest"))


@_query("benchmark", "SELECT item_id, concat('见“', replace(substr(text, 1, 40), chr(10), ' '), '”。又见。') AS answer FROM benchmark")
def made_up_quotes(benchmark: DataFrame) -> DataFrame:
    """An answer quotes the beginning of an item, and the same letters backwards, which are in no item."""
    quote = F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" "))
    answer = F.concat(F.lit("见“"), quote, F.lit("”。又见“"), F.reverse(quote), F.lit("”。"))
    return benchmark.select("item_id", sc.without_made_up_quotes(answer, F.array("text")).alias("answer"))


@_query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def prose_dates(orders: DataFrame) -> DataFrame:
    return orders.selectExpr("o_orderkey", f"{DATED} AS t").select("o_orderkey", sc.prose_date(F.col("t")).cast("string").alias("day"))


@_query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 8 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def opening_dates(orders: DataFrame) -> DataFrame:
    """The note stands behind 0 to 7 other lines; only the first six lines count."""
    others = F.array_repeat(F.lit("标题"), (F.col("o_orderkey") % 8).cast("int"))
    lines = orders.selectExpr("o_orderkey", f"{DATED} AS t").select("o_orderkey", F.concat(others, F.array("t")).alias("x"))
    return lines.select("o_orderkey", sc.opening_date(F.col("x")).cast("string").alias("day"))


@_query("events", """
SELECT event_type, NOT (hour(ts + INTERVAL 8 HOUR) BETWEEN 9 AND 11 OR hour(ts + INTERVAL 8 HOUR) BETWEEN 14 AND 17) AS off_peak, count(*) AS n FROM events GROUP BY 1, 2""")
def off_peak_events(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", sc.off_peak(F.col("ts")).alias("off_peak")).agg(F.count("*").alias("n"))


@_query("events", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'k' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_type = 'error' THEN CAST(user_id AS STRING) END AS error,
CASE WHEN event_type = 'signup' THEN CAST(user_id AS STRING) END AS signup FROM events""")
def stage_maps(events: DataFrame) -> DataFrame:
    """Keys without a value are null, a later layer wins."""
    layers = [F.from_json("props", "map<string,string>"), F.create_map("event_type", F.col("user_id").cast("string")), F.when(F.col("event_type") == "click", F.create_map(F.lit("k"), F.lit("k")))]
    keys = ["k", "error", "signup"]
    return events.select("event_id", sc.merged(keys, *layers).alias("m")).select("event_id", *[F.element_at("m", k).alias(k) for k in keys])


@_query("conversations", """
WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS x FROM conversations), d AS (SELECT conv_id, turn, x, list_filter(x, lambda v, i: list_position(x, v) = i) AS u FROM w)
SELECT conv_id, turn, len(x) AS n, len(u) AS n_distinct, array_to_string(u[1:3], ' ') AS first_three, list_contains(x, 'the') AS has_the FROM d""")
def ordered_distinct(conversations: DataFrame) -> DataFrame:
    x = conversations.select("conv_id", "turn", F.split(F.lower("text"), " ").alias("x")).withColumn("u", F.array_distinct("x"))
    return x.select("conv_id", "turn", F.size("x").alias("n"), F.size("u").alias("n_distinct"), F.array_join(F.slice("u", 1, 3), " ").alias("first_three"), F.array_contains("x", "the").alias("has_the"))


@_query("conversations", """
WITH l AS (SELECT conv_id, turn, length(text) > 200 AS kept, lag(length(text) > 200) OVER w AS before, role, lag(role) OVER w AS other FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(CASE WHEN kept AND (other IS DISTINCT FROM role OR NOT coalesce(before, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM l)
SELECT conv_id, turn, CAST(island AS BIGINT) AS island FROM s WHERE kept""")
def turn_islands(conversations: DataFrame) -> DataFrame:
    return units.islands(conversations, "conv_id", "turn", "role", F.length("text") > 200).select("conv_id", "turn", "island")


@_query("conversations", """
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, 0 AS bin, n AS s FROM t WHERE k = 1 UNION ALL
SELECT t.conv_id, t.turn, t.k, CASE WHEN r.s + t.n <= 600 THEN r.bin ELSE r.bin + 1 END, CASE WHEN r.s + t.n <= 600 THEN r.s + t.n ELSE t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, turn, bin FROM r""")
def turn_bins(conversations: DataFrame) -> DataFrame:
    sized = conversations.select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return units.bins_by_budget(sized, "conv_id", ["turn"], "n", 600).select("conv_id", "turn", "bin")


def _chunks(part: DataFrame) -> DataFrame:
    pieces = F.when(F.col("p_brand") > "Brand#2", F.col("p_partkey"))
    return part.select(F.col("p_partkey").alias("chunk_id"), F.concat_ws(", ", "p_name", "p_type").alias("text"), F.array("p_brand", F.concat(F.lit("s"), "p_size")).alias("anchors"), pieces.alias("split_part"))


_FOUND = """
c AS (SELECT p_partkey AS chunk_id, regexp_replace(lower(concat(p_name, p_type)), '[^a-z0-9]+', '', 'g') AS body, p_brand > 'Brand#2' AS piece, unnest([p_brand, concat('s', p_size)]) AS anchor FROM part),
j AS (SELECT anchor, quote, chunk_id, contains(body, regexp_replace(lower(quote), '[^a-z0-9]+', '', 'g')) AS hit, piece FROM a JOIN c USING (anchor)),
f AS (SELECT DISTINCT anchor, quote, chunk_id FROM (SELECT *, bool_or(hit) OVER w AS found, bool_and(piece) OVER w AS pieces FROM j WINDOW w AS (PARTITION BY anchor, quote)) WHERE hit OR NOT found OR NOT pieces)"""


@_query("part", f"WITH a AS (SELECT DISTINCT p_brand AS anchor, unnest(['Small RING', 'none of these']) AS quote FROM part), {_FOUND} SELECT anchor, quote, chunk_id FROM f")
def anchor_chunks(part: DataFrame) -> DataFrame:
    asked = part.select(F.col("p_brand").alias("anchor"), F.explode(F.array(F.lit("Small RING"), F.lit("none of these"))).alias("quote")).distinct()
    return units.anchor_join(asked, _chunks(part))


@_query("part", f"""
WITH e AS (SELECT DISTINCT p_type AS concept, concat('s', p_size) AS anchor, p_name AS quote FROM part WHERE p_brand > 'Brand#2'), a AS (SELECT DISTINCT anchor, quote FROM e), {_FOUND}
SELECT chunk_id, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM e JOIN f USING (anchor, quote) GROUP BY chunk_id""")
def evidence_concepts(part: DataFrame) -> DataFrame:
    edges = part.where("p_brand > 'Brand#2'").select(F.col("p_type").alias("concept"), F.concat(F.lit("s"), "p_size").alias("anchor"), F.col("p_name").alias("quote")).distinct()
    return units.concepts_of_chunks(edges, _chunks(part)).select("chunk_id", F.array_join("concepts", ",").alias("concepts"))


_LINES = """concat(CASE WHEN p_partkey % 31 = 0 THEN concat('第', CAST(p_partkey AS STRING), '章 ') WHEN p_size % 4 = 0 THEN concat('第', CAST(p_size AS STRING), '条 ') ELSE '' END, p_name)"""


@_query("part", f"""
WITH l AS (SELECT p_brand AS doc, p_partkey AS k, p_size AS n, p_partkey % 31 = 0 AS chapter, p_partkey % 31 <> 0 AND p_size % 4 = 0 AS article, {_LINES} AS line FROM part),
b AS (SELECT *, CAST(sum(CASE WHEN article THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block, last_value(CASE WHEN chapter THEN line END IGNORE NULLS) OVER w AS path FROM l WINDOW w AS (PARTITION BY doc ORDER BY k))
SELECT doc, block, path, CAST(max(CASE WHEN article THEN n END) AS BIGINT) AS number, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM b WHERE NOT chapter GROUP BY doc, block, path""")
def article_blocks(part: DataFrame) -> DataFrame:
    lines = part.selectExpr("p_brand AS doc", "p_partkey AS k", f"{_LINES} AS line")
    return units.article_blocks(lines, "doc", "k", "line").select("doc", "block", "path", "number", "n_lines", F.md5("body").alias("digest"))


_NUMBERED = """SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_partkey, p_size, concat(CASE WHEN p_size % 8 < 1 THEN '。' ELSE '' END, p_name, CASE WHEN p_size % 8 = 1 THEN '。' ELSE '' END) AS name FROM part"""
_CONTENTS = f"SELECT doc, k, p_partkey, CASE WHEN k = length(doc) - 6 THEN '目 录' ELSE name END AS line FROM ({_NUMBERED}) WHERE doc <> 'Brand#3'"


@_query("part")
def term_links(part: DataFrame) -> DataFrame:
    """Types and brands of all parts, looked up among the parts' names and their words."""
    shown = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("、", "p_type", "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.col("p_type"))
    asked = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("chapter"), shown.alias("term"))
    words = part.select(F.explode(F.concat(F.array("p_name", "p_type"), F.split("p_name", " "))).alias("name"), (F.col("p_partkey") % 4).alias("chapter")).distinct()
    return units.link_terms(asked, words).select("id", "chapter", "term", F.array_join("names", "|").alias("names"), "how")


@_query("part", f"""
WITH l AS ({_CONTENTS}), h AS (SELECT doc, k AS mark FROM l WHERE line = '目 录'),
e AS (SELECT doc, mark, (SELECT min(k) FROM l WHERE l.doc = h.doc AND k > mark AND line LIKE '%。') AS stop, (SELECT max(k) + 1 FROM l WHERE l.doc = h.doc) AS total,
(SELECT line FROM l WHERE l.doc = h.doc AND k = mark + 1) AS entry FROM h),
c AS (SELECT doc, mark, coalesce((SELECT min(k) FROM l WHERE l.doc = e.doc AND l.line = entry AND k > mark + 1 AND k < mark + 300 AND coalesce(stop, total) > mark + 1), stop, total) AS upto FROM e)
SELECT doc, p_partkey, line FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = l.doc AND k >= mark AND k < upto)""")
def without_contents(part: DataFrame) -> DataFrame:
    part.createOrReplaceTempView("part")
    return units.without_contents(part.sparkSession.sql(_CONTENTS), "doc", "k", "line").select("doc", "p_partkey", "line")


@_query("part", """
WITH l AS (SELECT p_brand AS doc, p_partkey AS k, CASE WHEN p_size % 5 < 3 THEN p_size % 5 + 1 END AS level, p_name AS line FROM part),
a AS (SELECT *, max(CASE WHEN level = 1 THEN k END) OVER w AS k1, max(CASE WHEN level = 2 THEN k END) OVER w AS k2, max(CASE WHEN level = 3 THEN k END) OVER w AS k3,
count(level) OVER w AS section FROM l WINDOW w AS (PARTITION BY doc ORDER BY k)),
o AS (SELECT doc, k, section, k1, CASE WHEN k2 > coalesce(k1, -1) THEN k2 END AS k2, CASE WHEN k3 > greatest(coalesce(k1, -1), coalesce(k2, -1)) THEN k3 END AS k3 FROM a)
SELECT o.doc, o.k, section, concat_ws('/', x.line, y.line, z.line) AS path FROM o LEFT JOIN l x ON x.doc = o.doc AND x.k = k1 LEFT JOIN l y ON y.doc = o.doc AND y.k = k2 LEFT JOIN l z ON z.doc = o.doc AND z.k = k3""")
def outline_paths(part: DataFrame) -> DataFrame:
    lines = part.selectExpr("p_brand AS doc", "p_partkey AS k", "CASE WHEN p_size % 5 < 3 THEN p_size % 5 + 1 END AS level", "p_name AS line")
    return units.outline(lines, "doc", "k", "level", "line", levels=3).select("doc", "k", "section", F.array_join("path", "/").alias("path"))


@_query("pages", "SELECT page_id, page_id % 7 < 2 AS broken FROM pages")
def broken_names(pages: DataFrame) -> DataFrame:
    mark = F.when(F.col("page_id") % 7 == 0, "\ufffd").when(F.col("page_id") % 7 == 1, "\ue001").otherwise("é")
    return pages.select("page_id", sc.broken_name(F.concat(F.coalesce("url", F.lit("")), mark)).alias("broken"))


@_query("orders", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5(concat('7', CAST(o_orderkey AS STRING))), o_orderkey LIMIT 50")
def seeded_orders(orders: DataFrame) -> DataFrame:
    return units.seeded_sample(orders, "o_orderkey", 50, "7").select("o_orderkey", "o_orderpriority")


@_query("documents")
def sentence_chunks(documents: DataFrame) -> DataFrame:
    return chunking.pack_sentences(documents, 400)


@_query("documents")
def parent_child_chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_parent_child(documents).select("parent_id", "doc_id", "seq", "offset", "length", F.md5("chunk").alias("digest"))


@_query("benchmark")
def text_overlaps(benchmark: DataFrame) -> DataFrame:
    """Each item beside the next one: longest common subsequence and substring, matching blocks."""
    pair = benchmark.alias("a").join(benchmark.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    a, b = F.col("a.text"), F.col("b.text")
    return pair.select("a.item_id", F.round(chunking.rouge_l(a, b), 6).alias("rouge_l"), units.longest_common(a, b).alias("longest"), F.round(units.coverage(a, b), 6).alias("coverage"))


@_query("orders")
def holdout_split(orders: DataFrame) -> DataFrame:
    train, test = units.grouped_split(orders, "o_custkey", "o_orderpriority")
    return train.select("o_orderkey", F.lit("train").alias("part")).unionAll(test.select("o_orderkey", F.lit("test").alias("part")))


QUERIES["bm25_saved_index"] = bm25_index.bm25_saved_index
ORACLES["bm25_saved_index"] = catalog.ORACLES["bm25_topk"]
