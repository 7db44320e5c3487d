"""The declarative operators as SQL: one statement a query, written once and put in words for Spark and for DuckDB.

Only spelling differs between the engines (``SPELLINGS``); the plan is Catalyst's on the one side. Every float is rounded and
every limit has a unique tie-breaker, so results compare by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.near_pairs import near_pairs
from ..operators.nearest import nearest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERY = "'the and with for that thing'"

#: (our spelling, Spark's, DuckDB's)
SPELLINGS = [
    (r"TOKENS\(([^()]*)\)", r"regexp_extract_all(lower(\1), '[a-z0-9]+', 0)", r"regexp_extract_all(lower(\1), '[a-z0-9]+')"),
    (r"ALL_OF\(([^()]*), ('[^']*')\)", r"regexp_extract_all(\1, \2, 0)", r"regexp_extract_all(\1, \2)"),
    (r"LINES\(([^()]*)\)", r"split(\1, '\\n', -1)", r"string_split(\1, chr(10))"),
    (r"GRAMS\(([^(),]*), (\d)\)", r"transform(sequence(1, greatest(1, length(\1) - \2 + 1)), i -> substr(\1, i, \2))", r"list_transform(range(1, greatest(1, len(\1) - \2 + 1) + 1), lambda i: substr(\1, i, \2))"),
    (r"EXPLODE\(", "explode(", "unnest("),
    (r"SIZE\(", "size(", "len("),
    (r"PCTL\(", "percentile(", "quantile_cont("),
    (r"SHA256\(([^()]*)\)", r"sha2(\1, 256)", r"sha256(\1)"),
    (r"MONTH\(([^()]*)\)", r"date_format(\1, 'yyyy-MM')", r"strftime(\1, '%Y-%m')"),
    (r"DAY\(([^()]*)\)", r"date_format(\1, 'yyyy-MM-dd')", r"strftime(\1, '%Y-%m-%d')"),
    (r"JSON\(([^(),]*), ('[^']*')\)", r"get_json_object(\1, \2)", r"json_extract_string(\1, \2)"),
    (r"LIST\((.*?) BY (.*?) SEP ('[^']*')\)", r"listagg(\1, \3) WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, \3 ORDER BY \2)"),
    (r"HALF_EVEN\(([^()]*)\)", r"CAST(bround(\1) AS BIGINT)", r"CAST(round_even(\1, 0) AS BIGINT)"),
    (r"SPLIT\(", "split(", "string_split("),
    (r"IDIV\(([^(),]*), (\d+)\)", r"(\1 div \2)", r"(\1 // \2)"),
    (r"MATCHES\(([^(),]*), ('[^']*')\)", r"(\1 rlike \2)", r"regexp_matches(\1, \2)"),
    (r"DOT\((\w+\.\w+), (\w+\.\w+)\)", r"aggregate(zip_with(\1, \2, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x)", r"list_sum(list_transform(list_zip(\1, \2), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"),
]

#: Only the query's words leave the rows they stand in: lengths are counted in the row, and what is shuffled are their counts.
BM25 = """
    q AS (SELECT DISTINCT t FROM (SELECT EXPLODE(TOKENS({query})) AS t)),
    dl AS (SELECT doc_id, n FROM (SELECT doc_id, SIZE(TOKENS(text)) AS n FROM documents) WHERE n > 0),
    st AS (SELECT count(*) AS docs, avg(n) AS mean FROM dl),
    tf AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, EXPLODE(TOKENS(text)) AS t FROM documents) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
    df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
    scored AS (
        SELECT tf.doc_id, round(sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score
        FROM tf JOIN df ON df.t = tf.t JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY tf.doc_id)"""

_bm25 = lambda query=QUERY: BM25.replace("{query}", query)
_VOCAB = _bm25("'large widget'").replace("FROM documents", "FROM vocab")
_COS = "a.vec_id AS q, b.vec_id, round(1 - DOT(a.embedding, b.embedding) / (sqrt(DOT(a.embedding, a.embedding)) * sqrt(DOT(b.embedding, b.embedding))), 6) + 0.0 AS dist"
_PS = "SELECT l_partkey AS s, l_suppkey AS o, count(*) AS n, max(l_discount) AS w, max(l_tax) AS c FROM lineitem GROUP BY l_partkey, l_suppkey"

def _metrics(k: int) -> str:
    """recall, MRR and nDCG at ``k``; without gold they are 0."""
    gain = lambda rank: f"sum(CASE WHEN {rank} THEN 1 / (ln(rk + 1) / ln(2.0)) ELSE 0 END)"
    return (
        f"coalesce(round(sum(CASE WHEN la = lb AND rk <= {k} THEN 1 ELSE 0 END) / nullif(max(gold), 0), 6), 0) AS recall{k}, "
        f"round(coalesce(1 / min(CASE WHEN la = lb AND rk <= {k} THEN rk END), 0), 6) AS mrr{k}, "
        f"coalesce(round({gain(f'la = lb AND rk <= {k}')} / nullif({gain(f'rk <= least({k}, gold)')}, 0), 6), 0) AS ndcg{k}")


#: name: SQL. Rows of the inventory that each stands for are in the README.
SQL: dict[str, str] = {
    # retrieval
    "bm25_topk": f"WITH {_bm25()} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_topk_lang_postfilter": f"WITH {_bm25()} SELECT doc_id, lang, score FROM (SELECT s.doc_id, lang, score FROM scored s JOIN documents d ON s.doc_id = d.doc_id ORDER BY score DESC, s.doc_id LIMIT 80) WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_positive_only": f"WITH {_bm25()} SELECT doc_id, score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20) WHERE score > 0",
    "bm25_case_max": f"WITH {_bm25()}, own AS (SELECT source, max(score) AS best, max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS own FROM scored s JOIN documents d ON s.doc_id = d.doc_id GROUP BY source) SELECT source, best, own FROM own ORDER BY own DESC, best DESC, source LIMIT 12",
    "bm25_relative_floor": f"WITH {_bm25()} SELECT doc_id, score FROM (SELECT *, max(score) OVER () AS top FROM scored) WHERE score >= greatest(4.0, 0.6 * top)",
    "bm25_stopwords": f"WITH {_bm25()}, left_ AS (SELECT tf.doc_id, count(*) AS hits FROM tf JOIN q ON tf.t = q.t WHERE q.t NOT IN ('the', 'and', 'for') GROUP BY tf.doc_id) SELECT doc_id, hits FROM left_ ORDER BY hits DESC, doc_id LIMIT 10",
    "okapi_variant": "WITH tok AS (SELECT doc_id, EXPLODE(TOKENS(text)) AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS f FROM tok GROUP BY doc_id, t), dl AS (SELECT doc_id, sum(f) AS n FROM tf GROUP BY doc_id), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM dl), df AS (SELECT t, count(*) AS d FROM tf GROUP BY t), q AS (SELECT EXPLODE(TOKENS('with that with for')) AS t) SELECT tf.doc_id, round(sum(ln((docs - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN tf ON q.t = tf.t JOIN df ON df.t = q.t JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY tf.doc_id ORDER BY score DESC, doc_id LIMIT 10",
    "paragraph_candidates": "WITH p AS (SELECT doc_id, EXPLODE(LINES(text)) AS par FROM documents), s AS (SELECT doc_id, par, SIZE(ALL_OF(par, '(?:that|with) ')) AS hits FROM p) SELECT doc_id, par, hits FROM (SELECT DISTINCT * FROM s) ORDER BY hits DESC, doc_id, par LIMIT 12",
    "cosine_topk": f"SELECT vec_id, dist FROM (SELECT {_COS} FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0) ORDER BY dist, vec_id LIMIT 10",
    "cosine_threshold_keep_one": f"SELECT vec_id, dist FROM (SELECT *, sum(CASE WHEN dist <= 0.3 THEN 1 ELSE 0 END) OVER () AS n FROM (SELECT {_COS} FROM embeddings a JOIN embeddings b ON a.vec_id = 1 AND b.vec_id <> 1 ORDER BY dist, b.vec_id LIMIT 20)) WHERE n = 0 OR dist <= 0.3",
    "hybrid_rrf": f"WITH {_bm25()}, v AS (SELECT {_COS} FROM (SELECT * FROM embeddings WHERE vec_id = 0) a CROSS JOIN embeddings b WHERE b.vec_id <> 0), t1 AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 50), t2 AS (SELECT vec_id AS doc_id, dist FROM v ORDER BY dist, vec_id LIMIT 50), u AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM t1 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY dist, doc_id) AS r FROM t2) SELECT u.doc_id, max(d.lang) AS lang, round(sum(1 / (60 + r)), 6) AS score FROM u LEFT JOIN documents d ON d.doc_id = u.doc_id GROUP BY u.doc_id ORDER BY score DESC, doc_id LIMIT 10",
    "rerank_pool_then_cut": f"WITH {_bm25()}, pool AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20) SELECT p.doc_id, round(score / ln(2 + n_chars), 6) AS rescored FROM pool p JOIN documents d ON d.doc_id = p.doc_id ORDER BY rescored DESC, doc_id LIMIT 4",
    "parent_expand_first": f"WITH {_bm25()}, r AS (SELECT doc_id, score, IDIV(doc_id, 5) AS parent, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM scored) SELECT parent, doc_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY rk) AS k FROM r) WHERE k = 1 ORDER BY rk LIMIT 20",
    "retrieval_metrics_at_k": f"WITH d AS (SELECT {_COS}, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rk, sum(CASE WHEN la = lb THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS gold FROM d) SELECT q, {', '.join(map(_metrics, (1, 3, 5, 10)))} FROM r GROUP BY q",
    "gold_containment": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "hit_rate_by_source": "WITH h AS (SELECT d.source, item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT source, count(*) AS hits, count(DISTINCT item_id) AS items FROM h GROUP BY source",
    # evaluation
    "confusion_matrix": "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic",
    "char_bigram_f1": "WITH g AS (SELECT item_id, EXPLODE(GRAMS(text, 2)) AS g FROM benchmark), c AS (SELECT item_id, g, count(*) AS n FROM g GROUP BY item_id, g), s AS (SELECT item_id, sum(n) AS t FROM c GROUP BY item_id), p AS (SELECT a.item_id AS x, b.item_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2) SELECT x, y, round(2 * m / (sx.t + sy.t), 6) AS f1, round(1 + 4 * 2 * m / (sx.t + sy.t), 3) AS score, 2 * m / (sx.t + sy.t) >= 0.5 AS correct FROM p JOIN s sx ON sx.item_id = x JOIN s sy ON sy.item_id = y",
    "jaccard_near_dups": "WITH s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, EXPLODE(GRAMS(text, 4)) AS g FROM documents)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) SELECT x, y, round(c / (a.n + b.n - c), 6) AS jaccard FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)",
    "duplicate_keep_best": "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS keep_id, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS dropped FROM documents",
    "exact_dups": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS k FROM documents WHERE n_chars >= 20) WHERE k = 1",
    # text
    "content_ids": "SELECT doc_id, substr(md5(text), 1, 10) AS uid, substr(sha1(text), 1, 8) AS sha8, substr(SHA256(text), 1, 8) AS caller FROM documents",
    "name_paren_split": "SELECT p_partkey, trim(regexp_replace(x, '\\(.*', '')) AS base, regexp_extract(x, '\\(([^)]*)\\)', 1) AS inner_ FROM (SELECT p_partkey, concat(p_name, ' (', p_brand, ')') AS x FROM part)",
    "contextual_text": "SELECT doc_id, concat_ws(chr(10), concat_ws(' > ', nullif(source, ''), nullif(lang, '')), text) AS ctx FROM documents",
    "sentence_split_stats": "SELECT lang, count(*) AS n, min(length(s)) AS lo, max(length(s)) AS hi FROM (SELECT lang, EXPLODE(ALL_OF(text, '[^.!?;]+[.!?;]?')) AS s FROM documents) GROUP BY lang",
    "fixed_stride_chunks": "SELECT doc_id, 1 + 500 * k AS p, substr(text, CAST(1 + 500 * k AS INT), 600) AS chunk FROM (SELECT doc_id, text, EXPLODE({seq}) AS k FROM documents)",
    "heading_class": "SELECT page_id, MATCHES(url, '/[0-9]+(/|$)') AND length(url) <= 60 AS is_heading FROM pages",
    "node_class": "SELECT page_id, CASE WHEN MATCHES(url, '^https://blog') THEN 'blog' WHEN MATCHES(url, '\\.org/') THEN 'org' WHEN MATCHES(url, '\\.html') THEN 'file' ELSE 'other' END AS kind FROM pages",
    "path_guard": "SELECT page_id, url FROM pages WHERE MATCHES(url, 'utm_|spam')",
    "paragraph_listagg": "SELECT conv_id, LIST(concat('[', CAST(turn AS STRING), '] ', text) BY turn, role, text SEP ' ') AS body FROM conversations GROUP BY conv_id",
    "doc_window": "SELECT item_id, doc_id, substr(d.text, CAST(greatest(1, strpos_ - 50) AS INT), 200) AS win FROM (SELECT b.item_id, d.doc_id, d.text, instr(d.text, b.text) AS strpos_ FROM benchmark b JOIN documents d ON contains(d.text, b.text)) d",
    "answer_clean": "SELECT doc_id, regexp_replace(regexp_replace(text, '^[. ]+', ''), '[. ]+$', '') AS clean FROM documents",
    "short_title": "SELECT p_partkey, substr(trim(p_name), 1, 12) AS title, coalesce(nullif(trim(p_name), ''), 'untitled') AS full_ FROM part",
    "squash_norm": "SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ''{g})) AS k FROM documents",
    "citation_strip": "SELECT doc_id, length(regexp_replace(text, '[0-9]+', ''{g})) AS n, SIZE(ALL_OF(text, '[0-9]+')) AS refs FROM documents",
    "id_sanitise": "SELECT s_suppkey, CASE WHEN MATCHES(s_name, '^[A-Za-z0-9_#-]{1,64}$') THEN s_name ELSE '' END AS id FROM supplier",
    "figure_fragments": "WITH p AS (SELECT doc_id, k, par, CASE WHEN length(par) <= 40 THEN 1 ELSE 0 END AS f FROM {par}), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM p), c AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, g) AS n FROM i) SELECT doc_id, k FROM c WHERE f = 1 AND n >= 3",
    "hard_wraps": "WITH p AS (SELECT doc_id, k, par, length(par) >= 20 AND NOT MATCHES(par, '[.!?:;]$') AS open_ FROM {par}), r AS (SELECT *, avg(CASE WHEN length(par) >= 20 THEN CASE WHEN open_ THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY doc_id) AS share, lag(open_) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM p), g AS (SELECT *, sum(CASE WHEN share > 0.3 AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS line FROM r) SELECT doc_id, line, LIST(par BY k SEP ' ') AS joined FROM g GROUP BY doc_id, line",
    # linking
    "quote_window_check": "WITH p AS (SELECT doc_id, k, regexp_replace(lower(par), '[^\\p{L}\\p{N}]', ''{g}) AS par FROM {par}), w AS (SELECT doc_id, k, concat(par, coalesce(lead(par, 1) OVER (PARTITION BY doc_id ORDER BY k), ''), coalesce(lead(par, 2) OVER (PARTITION BY doc_id ORDER BY k), '')) AS win FROM p), f AS (SELECT DISTINCT item_id, frag FROM (SELECT item_id, regexp_replace(lower(piece), '[^\\p{L}\\p{N}]', ''{g}) AS frag FROM (SELECT item_id, EXPLODE(SPLIT(regexp_replace(replace(text, '¶', ' '), '…+|⋯+|\\.{3,}|。{3,}|\\[\\.\\.\\.\\]|\\(\\.\\.\\.\\)', '¶'{g}), '¶')) AS piece FROM benchmark)) WHERE length(frag) >= 4), n AS (SELECT item_id, count(*) AS n FROM f GROUP BY item_id), h AS (SELECT item_id, doc_id, k, count(*) AS hits FROM w JOIN f ON contains(win, frag) GROUP BY item_id, doc_id, k) SELECT h.item_id, doc_id, min(k) AS first_k FROM h JOIN n ON n.item_id = h.item_id AND hits = n GROUP BY h.item_id, doc_id",
    "substring_mentions": "SELECT doc_id, n_name, CAST((length(lower(text)) - length(replace(lower(text), lower(n_name), ''))) / length(n_name) AS BIGINT) AS n FROM documents JOIN nation ON contains(lower(text), lower(n_name))",
    "named_lookup": "SELECT doc_id, n_name, pos FROM (SELECT doc_id, n_name, instr(lower(text), lower(n_name)) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY instr(lower(text), lower(n_name)), length(n_name) DESC, n_name) AS k FROM documents JOIN nation ON contains(lower(text), lower(n_name))) WHERE k = 1",
    "alias_unique_owner": "SELECT alias, min(p_brand) AS owner FROM (SELECT SPLIT(p_name, ' ')[{first}] AS alias, p_brand FROM part) GROUP BY alias HAVING count(DISTINCT p_brand) = 1",
    "zero_mention": "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), lower(n_name)))",
    "edge_double_sided": "SELECT l_partkey AS node, 'out' AS dir, count(*) AS n FROM lineitem GROUP BY l_partkey UNION ALL SELECT l_suppkey, 'in', count(*) FROM lineitem GROUP BY l_suppkey",
    "neighbors_topk": f"SELECT s, o, n FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, o) AS k FROM ({_PS})) WHERE k <= 3",
    "relations_among": f"SELECT s, o, n FROM ({_PS}) WHERE s IN (SELECT p_partkey FROM part WHERE p_size < 10) AND o IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)",
    "candidate_pairs": f"SELECT s, o, n FROM ({_PS}) WHERE s <> o",
    "degree_histogram": f"SELECT least(deg, 4) AS bucket, count(*) AS n FROM (SELECT s, count(*) AS deg FROM ({_PS}) GROUP BY s) GROUP BY least(deg, 4)",
    "reciprocal_pairs": "WITH e AS (SELECT DISTINCT c_nationkey AS s, CAST(c_custkey % 25 AS INT) AS o FROM customer) SELECT count(*) AS n FROM e a JOIN e b ON a.s = b.o AND a.o = b.s WHERE a.s < a.o",
    "scheme_rank_top3": f"SELECT s, o, k FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY w DESC, c DESC, n DESC, o) AS k FROM ({_PS})) WHERE k <= 3",
    "scheme_registry": f"SELECT s, o FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY round(0.5 * w + 0.3 * c + 0.2 * least(n, 5) / 5, 9) DESC, o) AS k FROM ({_PS})) WHERE k = 1",
    "scheme_overlap": f"WITH r AS (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY w DESC, o) AS a, row_number() OVER (PARTITION BY s ORDER BY c DESC, o) AS b FROM ({_PS})) SELECT s, count(*) AS both_ FROM r WHERE a <= 3 AND b <= 3 GROUP BY s",
    "tie_at_cutoff": f"SELECT s, w = nxt AS tied FROM (SELECT s, w, lead(w) OVER (PARTITION BY s ORDER BY w DESC, o) AS nxt, row_number() OVER (PARTITION BY s ORDER BY w DESC, o) AS k FROM ({_PS})) WHERE k = 3",
    "group_cap_reveal": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER w AS k, least(70, count(*) OVER (PARTITION BY p_brand)) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) WHERE k <= greatest(1, HALF_EVEN(n * 0.3))",
    "cross_group_names": "SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1",
    "reference_checks": "SELECT 'unknown part' AS what, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) UNION ALL SELECT 'repeated line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'out of range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1",
    "version_diff": "WITH a AS (SELECT p_size AS k, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size), b AS (SELECT p_size AS k, count(*) AS n FROM part WHERE p_partkey % 2 = 1 AND p_size < 45 GROUP BY p_size) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'old' WHEN a.k IS NULL THEN 'new' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS what FROM a FULL OUTER JOIN b ON a.k = b.k",
    "as_of_next": "SELECT event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events",
    "id_reconcile": "SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'matched' END AS what, count(*) AS n FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "title_map": "SELECT s_suppkey, n.n_nationkey FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND n.n_regionkey < 3",
    "correlated_backfill": "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, c.c_custkey, -1) AS owner FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 0",
    # aggregates
    "monthly_conditional": "SELECT MONTH(ts) AS month, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS mean FROM events GROUP BY MONTH(ts)",
    "usage_summary": "SELECT event_type, count(*) AS n, round(PCTL(value, 0.5), 6) AS p50, round(PCTL(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "floor_percentile": "SELECT lang, n_chars AS p90 FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) ",
    "nearest_rank": "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = CAST(ceil(n * 0.95) AS BIGINT)",
    "corpus_stats": "SELECT lang, count(*) AS n, min(n_chars) AS lo, round(PCTL(n_chars, 0.5), 3) AS med, max(n_chars) AS hi, count(*) - count(DISTINCT text) AS repeats FROM documents GROUP BY lang",
    "score_histogram": "SELECT least(CAST(floor(value / 10) AS INT), 9) AS bin, count(*) AS n FROM events GROUP BY 1",
    "mode_tiebreak": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1",
    "followup_rate": "SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 0), 6) AS rate FROM events GROUP BY user_id",
    "peak_in_flight": "WITH e AS (SELECT event_id AS tick, 1 AS d FROM events UNION ALL SELECT event_id + 1 + CAST(floor(value) AS BIGINT), -1 FROM events), s AS (SELECT tick, sum(d) AS d FROM e GROUP BY tick) SELECT max(r) AS peak FROM (SELECT sum(d) OVER (ORDER BY tick) AS r FROM s)",
    "status_crosstab": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "step_totals": "SELECT event_type, sum(CAST(JSON(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY event_type",
    "distinct_counts": "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents",
    "lock_sums": "SELECT event_type, round(sum(value), 3) AS total, count(*) AS n FROM events GROUP BY event_type",
    # conversations and logs
    "history_budget": "WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM conversations WHERE role <> 'system'), p AS (SELECT conv_id, pair, sum(length(text)) AS n FROM t GROUP BY conv_id, pair), r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS run FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pair DESC)) SELECT conv_id, pair, run FROM r WHERE k <= 6 AND (k = 1 OR run <= 800)",
    "older_turns": "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') WHERE k > 2 AND turn >= 1",
    "history_normalise": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant')), f AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM l WHERE k <= 6) SELECT conv_id, turn, role, substr(text, 1, 500) AS text FROM f WHERE seen = 1",
    "history_merge": "WITH client AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE conv_id % 3 <> 0 AND turn > 0), won AS (SELECT conv_id, turn, text FROM client WHERE c > 1), merged AS (SELECT conv_id, turn, text FROM won UNION ALL SELECT conv_id, turn, text FROM conversations s WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.conv_id = s.conv_id)), recent AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM merged) SELECT conv_id, turn FROM recent WHERE k <= 8 AND (used <= 1200 OR k = 1)",
    "seq_assign": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations",
    "insert_or_ignore": "SELECT md5(text) AS hash, min(conv_id) AS first_conv, count(*) AS n FROM conversations GROUP BY md5(text)",
    "meta_predicates": "SELECT conv_id, turn, MATCHES(text, '^(The|And|Is) ') AS opening, MATCHES(text, '[?]$') AS asks, length(text) <= 20 AS brief FROM conversations",
    "keyset_page": "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate < TIMESTAMP '1996-01-01 00:00:00' OR (o_orderdate = TIMESTAMP '1996-01-01 00:00:00' AND o_orderkey < 5000)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21",
    "incremental_pull": "SELECT conv_id, turn FROM conversations WHERE turn > 2 ORDER BY conv_id, turn LIMIT 50",
    "recent_distinct": "SELECT user_id, max(event_id) AS last_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) GROUP BY user_id",
    "owner_tristate": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE CAST(o_custkey AS STRING) END AS owner FROM orders) SELECT 'all' AS what, count(*) AS n FROM o UNION ALL SELECT 'none', count(*) FROM o WHERE coalesce(owner, '') = '' UNION ALL SELECT 'one', count(*) FROM o WHERE owner = '370'",
    "trim_latest_n": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 8",
    "upsert_counter": "SELECT user_id, event_type, count(*) AS hits, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id, event_type",
    "last_write_wins": "SELECT user_id, max_by(event_type, event_id) AS last_type, max_by(CASE WHEN value > 50 THEN value END, CASE WHEN value > 50 THEN event_id END) AS last_high FROM events GROUP BY user_id",
    "retention_cut": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 HOURS",
    "day_partition_scan": "SELECT DAY(ts) AS day, count(*) AS n FROM events WHERE value >= 0 GROUP BY DAY(ts)",
    "range_export": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-03-31' + INTERVAL 1 DAY",
    "json_props": "SELECT CAST(JSON(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
    "ms_convert": "SELECT event_id, round(value * 1000, 1) AS ms FROM events",
    "soft_delete": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at, coalesce(nullif(o_orderpriority, ''), 'none') AS name FROM orders WHERE o_orderstatus <> 'P'",
    "weak_points": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS k FROM events WHERE value < 20 GROUP BY user_id, event_type) WHERE k <= 3",
    "first_occurrence_number": "WITH f AS (SELECT user_id, event_type, event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first_id) AS num FROM f WHERE prev IS NULL OR prev <> event_type",
    # ranking and selection
    "round_robin": "SELECT p_partkey, k FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) ORDER BY k, p_type, p_partkey LIMIT 40",
    "relevance_cap": "WITH d AS (SELECT d.doc_id, n_chars, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 1 THEN 2 ELSE 3 END AS tier FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN tier > 2 THEN 1 ELSE 0 END, n_chars DESC, doc_id) AS k FROM d) SELECT doc_id, tier, row_number() OVER (ORDER BY doc_id) AS pos FROM r WHERE k <= 40",
    "tier_order": "SELECT d.doc_id, min(CASE WHEN quality = 1 THEN 1 ELSE 2 END) AS tier FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id",
    "keyword_router": "WITH k AS (SELECT * FROM (VALUES ('policy', 'der', 1), ('policy', 'die', 1), ('course', 'the', 2), ('course', 'and', 2), ('thesis', 'que', 3), ('thesis', 'les', 3)) AS v(route, word, tie)), h AS (SELECT doc_id, route, min(tie) AS tie, count(*) AS hits FROM documents JOIN k ON contains(lower(text), concat(' ', word, ' ')) GROUP BY doc_id, route) SELECT doc_id, route, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, tie) AS k FROM h) WHERE k = 1",
    "structured_search": "SELECT p_brand, LIST(CAST(p_partkey AS STRING) BY k SEP ',') AS items FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part WHERE p_size BETWEEN 1 AND 20 AND p_type LIKE '%' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) WHERE k <= 5 GROUP BY p_brand",
    "relaxed_prefilter": f"WITH {_bm25()} SELECT doc_id, prio FROM (SELECT s.doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS prio, score FROM scored s JOIN documents d ON d.doc_id = s.doc_id) ORDER BY prio, score DESC, doc_id LIMIT 15",
    "allowed_ids": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'not allowed' WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN 'duplicate' WHEN row_number() OVER (ORDER BY p_partkey) > 500 THEN 'over cap' END AS reason FROM part",
    "alias_block": "SELECT p_partkey, CASE WHEN p_name = '' THEN 'empty' WHEN length(p_name) < 2 THEN 'single' WHEN length(p_name) <= 10 THEN 'short' END AS blocked FROM part",
    "view_shape": "SELECT o_orderkey, concat(o_orderstatus, ':', o_orderpriority) AS brief FROM orders",
    "point_lookup": "SELECT p.p_partkey, p.p_name, s.n FROM part p LEFT JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) s ON s.p_name = p.p_name WHERE p.p_partkey = 42",
    "two_members": "SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 2",
    "best_bodies": f"WITH {_bm25()} SELECT source, doc_id FROM (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY coalesce(score, 0) DESC, d.doc_id) AS k FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id) WHERE k <= 2",
    "tiered_vocab_search": f"WITH vocab AS (SELECT p_partkey AS doc_id, lower(concat(p_name, ' ', p_type)) AS text FROM part), {_VOCAB}, names AS (SELECT p_partkey, lower(p_name) AS alias FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part UNION ALL SELECT p_partkey, lower(concat(p_name, ' ', p_type)) FROM part), found AS (SELECT p_partkey, CASE WHEN alias = 'large widget' THEN 1000 WHEN contains('large widget', alias) THEN 500 + length(alias) WHEN contains(alias, 'large widget') THEN 300 + length(alias) ELSE 0 END AS score FROM names), u AS (SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM found WHERE score > 0 UNION ALL SELECT doc_id, score FROM scored) SELECT p_partkey, max(score) AS score FROM u GROUP BY p_partkey ORDER BY score DESC, p_partkey LIMIT 500",
    "render_rows": "SELECT LIST(concat(CAST(k AS STRING), '. ', p_name) BY k SEP ' | ') AS listing FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS k FROM part WHERE p_size = 7)",
    "ordered_union_cap": "WITH u AS (SELECT doc_id, 1 AS l, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY n_chars, doc_id) FROM documents WHERE lang = 'en'), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, r) AS k FROM u WHERE r <= 30) SELECT doc_id, l, r FROM f WHERE k = 1 ORDER BY l, r LIMIT 40",
    "key_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_difference": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "graph_export": "WITH e AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag AS rel, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3) SELECT a, b, rel FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, rel) AS k FROM e) WHERE k = 1",
    "graph_importance": f"WITH e AS ({_PS}) SELECT s, round(count(*) + 25e-2 * sum(n) + 5e-1 * (count(DISTINCT o) - 1), 3) AS importance FROM e GROUP BY s",
    "concept_triples": f"SELECT s, o, n FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN o < 10 THEN 0 ELSE 1 END, n DESC, o) AS k FROM ({_PS})) WHERE k <= 2",
    "origin_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND value >= 10",
    "best_of": f"SELECT s, max(coalesce(w, 0)) AS best_w, max(coalesce(c, 0)) AS best_c, sum(n) AS n FROM ({_PS}) GROUP BY s",
    "clamp_values": "SELECT p_partkey, greatest(1, least(5, p_size)) AS count_, CASE WHEN p_size BETWEEN 1 AND 10 THEN p_size END AS chapter FROM part",
    "chapter_rollup": "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name",
}


def _spelled(name: str, engine: int) -> str:
    text = SQL[name]
    for a, b in (
        ("{g}", ("", ", 'g'")[engine]), ("{first}", ("0", "1")[engine]),
        ("{seq}", ("sequence(0L, greatest(0L, (n_chars - 101) div 500))", "range(0, greatest(0, (n_chars - 101) // 500) + 1)")[engine]),
        ("{par}", ("(SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (k, par) FROM documents)", "(SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS par FROM documents)")[engine]),
    ):
        text = text.replace(a, b)
    for ours, *theirs in SPELLINGS:
        text = re.sub(ours, theirs[engine], text)
    return re.sub(r"'([^']*\\[^']*)'", r"r'\1'", text) if engine == 0 else text


def _runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = _spelled(name, 0)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    return run


def _jaccard_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _retrieval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0", 10).selectExpr("q", "rk", "gold", "1 AS la", "int(same) AS lb")
    return spark.sql(f"SELECT q, {', '.join(map(_metrics, (1, 3, 5, 10)))} FROM {{r}} GROUP BY q", r=r)


#: Too slow as plain joins of all grams, or of all vectors: operators of their own, held against the same SQL.
QUERIES = {name: _runner(name) for name in SQL} | {"jaccard_near_dups": _jaccard_near_dups, "retrieval_metrics_at_k": _retrieval_metrics_at_k}
ORACLES = {name: _spelled(name, 1) for name in SQL}
