"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .jaccard_join import similar_components
from .line_dedup import line_dedup
from .mixing import mix_counts
from .pii import KINDS, listed, with_spans
from .quality import importance_sample
from .token_files import token_counts
from .url_filter import judge_urls
from .warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents, and those that the sample keeps."""
    out = importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_ngrams", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"), "kept")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 and 150 % of all words."""
    return mix_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    out = with_spans(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return out.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, then by two character models."""
    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from flat token files by a scan for separators."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more, removed from every document."""
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of the benchmark."""
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files and read back through the two-level index."""
    return archived(_table(spark, sf_dir, "pages")).drop("url")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles are at least 75 % alike."""
    return similar_components(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for blanks, with the row that stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_mix_sources": op2_mix_sources,
    "op3_sanitise": op3_sanitise,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc_index": op8_warc_index,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents),
        k AS (SELECT *, translate(regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id""",
    "op7_decontaminate": """
        WITH w AS (
            SELECT doc_id AS id, 0 AS kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
            UNION ALL
            SELECT item_id, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        iw AS (
            SELECT DISTINCT id AS item_id, k AS size, array_to_string(words[p:p + k - 1], ' ') AS win
            FROM (SELECT *, least(10, len(words)) AS k, unnest(range(1, greatest(len(words) - 8, 2))) AS p FROM w WHERE kind = 1 AND len(words) > 0)),
        sizes AS (SELECT DISTINCT size FROM iw),
        dw AS (
            SELECT id AS doc_id, size, p, array_to_string(words[p:p + size - 1], ' ') AS win
            FROM (SELECT id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM w, sizes WHERE kind = 0 AND len(words) >= size)),
        hits AS (SELECT doc_id, item_id, p, dw.size FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
        SELECT id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered ON id = covered.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 0""",
    "op8_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (
            SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(concat('0b', substr(bits, i, 5)) AS INTEGER), 1), '' ORDER BY i) AS digest
            FROM (SELECT h, i, (SELECT string_agg(CAST(CAST(concat('0x', substr(h, k, 1)) AS INTEGER)::BIT AS VARCHAR)[29:32], '' ORDER BY k) FROM range(1, 41) t(k)) AS bits
                  FROM (SELECT DISTINCT h FROM p), range(1, 157, 5) s(i)) GROUP BY h)
        SELECT page_id, strlen(t) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER (PARTITION BY t) THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < max(page_id) OVER (PARTITION BY t) THEN max(page_id) OVER (PARTITION BY t) END AS refers_to
        FROM p JOIN d ON d.h = p.h""",
    "op9_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS sh
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
        reach AS (SELECT doc_id AS doc, doc_id AS root FROM w UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc, min(root) AS component_id FROM reach GROUP BY doc) m ON m.doc = w.doc_id""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS norm FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
              FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}
