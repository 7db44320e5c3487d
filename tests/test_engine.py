import difflib
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import verify
from quarrystone.operators import chunking, near_pairs, nearest, units
from quarrystone.plans import catalog, unit_queries
from quarrystone.streaming import sessions


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in verify.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES | unit_queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    queries, oracles = catalog.QUERIES | unit_queries.QUERIES, catalog.ORACLES | unit_queries.ORACLES
    got, want = queries[name](spark, "/root/testdata/sf0.001").toArrow(), duck.sql(oracles[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert verify.rows_of(got) == verify.rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_are_bounded_and_lose_nothing(spark):
    rng = random.Random(4)
    texts = ["\n".join("".join(rng.choice("abc ") for _ in range(rng.randint(0, 900))) for _ in range(6)) for _ in range(20)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((600, 100), (50, 0)):
        rows = chunking.chunk_text(docs, size, overlap).collect()
        assert all(0 < len(r.chunk) <= size for r in rows)
        if not overlap:
            for i, t in enumerate(texts):
                squash = lambda s: "".join(s.split())
                assert squash("".join(r.chunk for r in sorted(rows) if r.doc_id == i)) == squash(t or "")
    assert all(r.length == len(r.chunk) for r in chunking.chunk_parent_child(docs).collect())


def test_sentences_are_packed(spark):
    """Held against packing by single characters."""
    rng, size = random.Random(7), 30
    texts = ["".join(rng.choice("ab 。！?;\n" if i % 3 else "abcdef ghi。") for _ in range(rng.randint(0, 400))) for i in range(60)] + ["", None, "x" * 95, "。", "  "]

    def slow(text):
        out, now, sentence = [], "", ""
        for i, c in enumerate(text):
            sentence += c
            if c not in "。！？；!?;" and i + 1 < len(text):
                continue
            if len(now + sentence) > size:
                out, now = [*out, now], ""
                while len(sentence) > size:
                    out, sentence = [*out, sentence[:size]], sentence[size:]
            now, sentence = now + sentence, ""
        return [x.strip() for x in [*out, now] if x.strip()]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.pack_sentences(docs, size).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {i: c for i, t in enumerate(texts) if (c := slow(t or ""))}


def test_article_blocks_of_odd_lines(spark):
    lines = [("d", 1, "前言"), ("d", 2, "第一章 总则"), ("d", 3, "第一条 甲"), ("d", 4, None), ("d", 5, ""), ("d", 6, "第 二 章 附则"), ("d", 7, "仍属第一条"), ("d", 8, "第十二条"), (None, 1, "x")]
    rows = units.article_blocks(spark.createDataFrame(lines, "doc string, k int, text string"), "doc", "k").collect()
    assert sorted(((r.doc or ""), r.block, r.path or "", r.number, r.n_lines, r.body) for r in rows) == [
        ("", 0, "", None, 1, "x"), ("d", 0, "", None, 1, "前言"), ("d", 1, "第 二 章 附则", None, 1, "仍属第一条"), ("d", 1, "第一章 总则", 1, 2, "第一条 甲\n"), ("d", 2, "第 二 章 附则", 12, 1, "第十二条")]
    assert not units.article_blocks(spark.createDataFrame([], "doc string, k int, text string"), "doc", "k").count()


def test_similarities(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", "a"), (None, "a"), ("same", "s am\ne")], "a string, b string")
    rows = df.select(chunking.rouge_l(F.col("a"), F.col("b")).alias("r"), chunking.sequence_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.r for r in rows] == [0.75, 0.0, 0.0, 1.0]
    assert rows[0].s == difflib.SequenceMatcher(None, "abcd", "abxd", autojunk=False).ratio()


def test_sessions_and_day_files(spark, tmp_path):
    events = sessions.event_stream(spark, "/root/testdata/sf0.001")
    q = sessions.session_counts(events).writeStream.format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sessions").count() > 0
    sessions.write_by_day(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_near_pairs_of_whole_texts_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé 𝔸") for _ in range(rng.choice((3, 40, 700, 3000)))) for _ in range(40)]
    for t in texts[:30]:
        w = list(t)
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts += ["".join(w), t] if rng.random() < 0.5 else ["".join(w)]
    texts += ["", "", None, "ab", "ab"]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sets = [t is not None and {t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in texts]
    want = {(i, j, round(len(a & b) / len(a | b), 6)) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 5 * len(a & b) >= 4 * len(a | b)}
    got = [tuple(r) for r in catalog.QUERIES["jaccard_near_dups"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(len(texts[i]) > 600 and c < 1 for i, _, c in want)


@pytest.mark.parametrize("broadcast", [-1, 1_000_000])
def test_bits_rule_out_unlike_texts_and_lose_no_pair(spark, tmp_path, monkeypatch, broadcast):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 300))) for _ in range(150)]
    for t in texts[:60]:
        w = t.split()
        for k in range(rng.randint(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = f"new{k}"
        texts += [" ".join(w), " ".join(w)]
    texts += [" ".join([*texts[0].split(), f"tail{i}"]) for i in range(40)]
    met = []
    saved = near_pairs.saved
    monkeypatch.setattr(near_pairs, "saved", lambda df, name: met.append((name, saved(df, name))) or met[-1][1])
    monkeypatch.setattr(near_pairs, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_pairs, "BITS", (16, 1 << 14))
    monkeypatch.setattr(near_pairs, "TEXTS", (8, 1 << 12))
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} for t in texts]
    want = {(i, j, round(len(a & b) / len(a | b), 6)) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 5 * len(a & b) >= 4 * len(a | b)}
    got = [tuple(r) for r in catalog.QUERIES["jaccard_near_dups"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 800
    tables = dict(met)
    # the join of single grams wrote rows for a fifth of all grams and candidates for most pairs
    assert "gram-index" not in tables and tables["gram-pairs"].count() < 1.5 * tables["gram-links"].count() + 50


def test_metrics_and_f1_over_all_rows(spark, tmp_path):
    rng = random.Random(8)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)], 99 if i == 40 else rng.randrange(3)) for i in range(70)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    items = [(i, "".join(rng.choice("abcde") for _ in range(30))) for i in range(16)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.q: r for r in catalog.QUERIES["retrieval_metrics_at_k"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 20, 40, 60}
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q, r in got.items():
        ranked = sorted((i for i in rows if i != q), key=lambda i: (round(1 - cos(rows[q], rows[i]), 6), i))
        gold = {i for i, _, c in vecs if c == vecs[q][2] and i != q}
        for k in (1, 3, 5, 10):
            hits = [p for p, i in enumerate(ranked[:k], 1) if i in gold]
            ideal = sum(1 / math.log2(p + 1) for p in range(1, min(len(gold), k) + 1))
            want = (len(hits) / len(gold), 1 / hits[0] if hits else 0, sum(1 / math.log2(p + 1) for p in hits) / ideal) if gold else (0, 0, 0)
            assert [float(r[f"{m}{k}"]) for m in ("recall", "mrr", "ndcg")] == pytest.approx(want, abs=2e-6)
    grams = [Counter(t[i : i + 2] for i in range(29)) for _, t in items]
    want = {(x, y): (grams[x] & grams[y]).total() / 29 for x in range(16) for y in range(x + 1, 16) if grams[x] & grams[y]}
    f1 = {(r.x, r.y): float(r.f1) for r in catalog.QUERIES["char_bigram_f1"](spark, str(tmp_path)).collect()}
    assert f1 == pytest.approx(want, abs=2e-6) and any(y >= 12 for _, y in want)


def test_metrics_of_odd_vectors_and_many_equal_ones(spark, tmp_path):
    rng = random.Random(9)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(130)]
    vecs += [(i, [1.0, 2.0, 0.5, 1.0], i % 2) for i in range(130, 200)] + [(i, [float(i % 3), 0.0, 1.0, 0.0], None if i % 7 == 0 else 2) for i in range(200, 250)]
    odd = [[0.0] * 4, None, [1.0, None, 2.0, 0.0], [1.0, 2.0], [], [1.0, 0.0, 0.0, 0.0, 3.0], [None] * 4, [None, 1.0]]
    vecs += [(i, v, 1) for i, v in enumerate(odd, 251)] + [(20 * i, v, 1) for i, v in enumerate(odd, 13)] + [(None, [1.0, 2.0, 0.5, 1.0], 1)]
    rng.shuffle(vecs)
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = verify.rows_of(con.sql(catalog.ORACLES["retrieval_metrics_at_k"]).to_arrow_table())
    was, nearest.BLOCK = nearest.BLOCK, (5, 16)
    try:
        got = verify.rows_of(catalog.QUERIES["retrieval_metrics_at_k"](spark, str(tmp_path)).toArrow())
    finally:
        nearest.BLOCK = was
    assert len(want) == 21 and got == want


def test_mentions_of_whole_names_in_all_texts(spark, tmp_path):
    names = ["INDIA", "INDONESIA", "IRAN", "IRAQ"]
    texts = ["India, indonesia and INDIA; independent", "irrelevant " * 300 + "Iraq iraq", "individual iris", None, "IRAN" * 3]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(names)), "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    got = {(r.doc_id, r.n_name): r.n for r in catalog.QUERIES["substring_mentions"](spark, str(tmp_path)).collect()}
    assert got == {(i, n): c for i, t in enumerate(texts) for n in names if (c := (t or "").lower().count(n.lower()))}
    assert got == {(0, "INDIA"): 2, (0, "INDONESIA"): 1, (1, "IRAQ"): 2, (4, "IRAN"): 3}
    first = {(r.doc_id, r.n_name, r.pos) for r in catalog.QUERIES["named_lookup"](spark, str(tmp_path)).collect()}
    assert first == {(0, "INDIA", 1), (1, "IRAQ", 3301), (4, "IRAN", 1)}


def test_whole_texts_of_all_languages(spark, tmp_path):
    long = "Wort " * 40
    texts = [f"..Äpfel, {long}Ende. .", f"ÄPFEL {long}ende", f"Опыт; {long}...", f"x\nAlpha beta\ngamma, {long}delta\nend", f"Alpha beta gamma {long} other"]
    rows = [(i, t, ("de", "en")[i % 2], ("web", "")[i // 2 % 2], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, f"Alpha BETA gamma {long}delta"), (2, f"alpha beta… {long}Delta"), (3, "Alpha beta … missing part"), (4, "... a …"), (5, f"beta gamma {long}other")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    of = lambda name, *c: {r.doc_id: tuple(r[x] for x in c) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    squash = lambda t: re.sub(r"[\W_]+", "", t.lower())
    assert of("squash_norm", "k") == {i: (hashlib.md5(squash(t).encode()).hexdigest(),) for i, t in enumerate(texts)}
    assert of("answer_clean", "clean") == {i: (t.strip(". "),) for i, t in enumerate(texts)}
    assert of("contextual_text", "ctx") == {i: (" > ".join(x for x in (s, g) if x) + "\n" + t,) for i, t, g, s, _ in rows}
    found = {(r.item_id, r.doc_id, r.first_k) for r in catalog.QUERIES["quote_window_check"](spark, str(tmp_path)).collect()}
    assert found == {(1, 3, 0), (2, 3, 0), (5, 4, 0)}
