import math
import random
import re
from collections import Counter

import __spark_entry__ as entry
from quarrystone.llm import decontamination as dc
from quarrystone.llm import jaccard_join as jj
from quarrystone.llm import pii, quality, token_files, url_filter, warc

SCHEMA = "doc_id long, text string, bucket string, h string, sig string"


def _docs(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Äx", "ÑO"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(f"P{i}" for i in range(30))
    texts += [f"{t} {passage}" for t in texts[:20]]
    for i in range(25):  # a group of near copies
        w = texts[0].split() + texts[1].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", None, " \t\n", "one", "One", "long " * 30_000]
    return [(i, t, "b", None, "x") for i, t in enumerate(texts)] + [(3, texts[3], "b", None, "x"), (None, "no id", None, None, None)]


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "SHORT", 3)
    monkeypatch.setattr(jj, "SHARE", 4)
    rows = _docs()
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))
    got = Counter(map(tuple, jj.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == want
    assert jj.similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    rows = _docs(2)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    items = [(1, "p3 P4 p5 p6 p7 p8 p9 p10 p11 p12 p13"), (2, "P1, p2"), (3, None), (4, "zz yy"), (10, rows[5][1]), (1, "P20 p21")]
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            b = words(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(name)
        want[(i, len(w), len(hit), tuple(sorted(found)), bool(hit))] += 1
    for segment in (1 << 20, 50):
        monkeypatch.setattr(dc, "SEGMENT", segment)
        out = dc.decontaminate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in out.collect()) == want
    near = dc.find_near(dc.build_index(spark.createDataFrame([(1, "a x b y c"), (2, "a b")], "doc_id long, text string")), [(7, "c a b")], 2).collect()
    assert [tuple(r) for r in near] == [(1, 7, 0, 4)]


def test_token_counts_round_trip(spark):
    rows = _docs(3)
    encode, _ = token_files.tokenizer(token_files.TOKENIZER)
    want = Counter((r[0], len(encode([r[1] or ""])[0])) for r in rows)
    for block in (1 << 21, 100, 7):
        if block == 7:
            rows = rows[:40]
            want = Counter((r[0], len(encode([r[1] or ""])[0])) for r in rows)
        assert Counter(map(tuple, token_files.token_counts(spark.createDataFrame(rows, SCHEMA), block_tokens=block).collect())) == want


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)  # many blocks, and keys that go over several
    rows = [(i, f"http://a{i % 3}.example.org/x{i % 5}?q", f"<p>{i % 7}é</p>" * 50) for i in range(40)] + [(50, None, None), (51, "x\r\ny", ""), (None, "http://u/", "<p>1é</p>" * 50)]
    rows += [(60 + i, "http://hot.org/", "hot") for i in range(20)] + [(5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    got = warc.archived(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    got = {r.page_id: r for r in got}
    for i, _, t in rows:
        body, r = (t or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.base32_sha1(body))
        assert (r.record_type, r.refers_to) == (("response", None) if last[t or ""] == i else ("revisit", last[t or ""]))
    _, index, at = warc.archive(pages)
    found = warc.find_records(spark.createDataFrame([("http://A1.example.org/x1?q",), ("http://no.org/",), ("http://hot.org/",)], "url string"), index, at, payload=True).collect()
    assert sorted(x["page_id"] for x in found) == sorted([i for i in range(40) if i % 3 == 1 and i % 5 == 1] + list(range(60, 80)))
    assert {x["payload"] for x in found if x["record_type"] == "response" and x["page_id"] >= 60} == {b"hot"}
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_directories_are_searched_by_halving(tmp_path):
    import json
    import zlib

    names = []
    for f, keys in enumerate((["a", "b", "b"], ["b", "b", "c"], ["d", "e", "e"])):
        blocks = [(k, k, 100 * i, 10) for i, k in enumerate(keys)]
        body = zlib.compress("\n".join(map(json.dumps, blocks)).encode())
        (tmp_path / f"{f}").write_bytes(body + len(body).to_bytes(8, "big"))
        names.append((keys[0], keys[-1], str(tmp_path / f"{f}")))
    directory = warc.Directory(names, str(tmp_path))
    places = lambda key: [(n[-1], at) for n, at, _ in directory.find(key)]
    assert places("b") == [("0", 100), ("0", 200), ("1", 0), ("1", 100)] and places("e") == [("2", 100), ("2", 200)]
    assert places("cc") == places("0") == places("z") == [] and places("a") == [("0", 0)]


def test_tokens_do_not_depend_on_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quarrystone.llm import kernel

    texts = pa.array(["a bb ccc", "", None, "x" * 300, "x" * 300, "yy", "é!é!! " * 40, " ", "tail" * 9])
    whole = kernel.tokens(*kernel.flat(texts), kernel.MIXED_CLASSES)
    for block in (1, 7, 64):
        monkeypatch.setattr(kernel, "BLOCK", block)
        got = kernel.tokens(*kernel.flat(texts), kernel.MIXED_CLASSES)
        assert all((x == y).all() for x, y in zip(whole, got, strict=True))
    assert np.unique(whole[0][whole[1][3] : whole[1][5]]).size == 1


def test_quality_keeps_good_and_drops_bad(spark):
    rng = random.Random(5)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}!!" for i in range(200)]
    rows = [(i, " ".join(rng.choice(good if i % 5 else bad) for _ in range(80))) for i in range(500)] + [(600, None), (601, "")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in quality.importance_sample(docs, labels).where("kept").collect()}
    held = [i for i in range(250, 500)]
    assert sum((i in kept) == (i % 5 > 0) for i in held) >= 0.98 * len(held)
    assert {r.doc_id for r in quality.select_quality(docs, labels).collect()} == kept
    assert quality.importance_sample(docs, labels.limit(0)).where("kept").count() == len(rows)
    assert quality.importance_sample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    values = [random.Random(1).choice([1.0, 2.5, 7.0]) * (i % 50) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "sample_key double")
    for k in (1, 17, 1500, 3000):
        assert quality.kth_largest(df, k, collected=5) == sorted(values, reverse=True)[k - 1]


def test_personal_data_against_brute_force(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = lambda: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(), "phone": 10 <= len(d) <= 15}[kind]

    rng = random.Random(9)
    texts = ["".join(rng.choice("0123456789@..+- ab_é𝔸\n(") for _ in range(300)) for _ in range(150)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 0300.1.1.1 256.1.1.1", "4111 1111-1111 1111", "+1 (706) 555-3138", "9" * 30_000, None, "", "é a@x.yz 𝔸 10.0.0.1"]
    texts += [f"Zorblax writes from zz@yy.org about thing {i}" for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.spans] for r in pii.with_spans(docs).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end(), n) for k, n in enumerate(kinds) for m in re.finditer(kinds[n], t or "") if valid(n, m[0]))
        assert [s for s in got[i] if s[1] < 4] == want
    assert any(s[3] == "removed" and texts[len(texts) - 1][s[0] : s[2]] == "Zorblax" for s in got[len(texts) - 1])
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "zz@yy.org" not in clean[len(texts) - 1] and "[email]" in clean[len(texts) - 1] and "Zorblax" not in clean[len(texts) - 1]
    assert clean[texts.index("")] == "" and pii.with_spans(docs.limit(0)).count() == 0


def test_url_rules_and_models(spark):
    rows = [(i, f"https://{h}/{p}/{i}") for i in range(60) for h, p in (("a.Example.org", "en/x"), ("b.example.org", "es"), ("shop.com", "fr"), ("shop.com", "de"), ("casino.net", "de"), ("site.net", "fr"))]
    rows += [(900, None), (901, "no scheme"), (902, "http://x.org"), (903, "HTTP://EXAMPLE.ORG/en/1?x#y")]
    got = {(r.page_id, r.host, r.path): r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[(900, "", "")].rule is None and got[(901, "", "")].rule is None and got[(902, "x.org", "")].rule is None
    assert (got[(903, "example.org", "/en/1")].rule, got[(903, "example.org", "/en/1")].verdict) == ("example.org/en/1", "block")
    assert got[(5, "b.example.org", "/es/5")].verdict == "block" and got[(5, "shop.com", "/fr/5")].rule == "com/fr/"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_slices_never_rule_out_a_link():
    import numpy as np
    import pyarrow as pa

    from quarrystone.llm import jaccard_join as j

    rng = np.random.default_rng(5)
    rows = []
    for n in [1, 3, 4, 50, 900, 30000, 90000]:  # the last has no class counts
        for kept in (1.0, 0.9, 0.8, 0.5, 0.0):
            a = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
            b = np.unique(np.r_[a[: int(len(a) * kept)], rng.integers(0, 1 << 56, max(1, n // 20), dtype=np.uint64)])
            rows.append((a, b))
    pack = lambda u: j._slice(u).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    columns = [range(len(rows)), range(len(rows))]
    columns += [[len(r[k]) for r in rows] for k in (0, 1)] + [[j._histogram(r[k]) for r in rows] for k in (0, 1)] + [[pack(r[k]) for r in rows] for k in (0, 1)]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=list("abcdefgh"))
    left = set(next(j._within_slices(75)(iter([batch]))).column(0).to_pylist())
    links = {i for i, (a, b) in enumerate(rows) if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
    assert links and links <= left
    assert not left & {i for i, (a, b) in enumerate(rows) if 800 < len(a) < 40000 and len(np.intersect1d(a, b)) == 0}


def test_disclosing_terms_of_the_whole_document(spark):
    n, far = 2000, "common words " * 40
    texts = [f"{far} word{i % 50}" for i in range(n)]
    texts[7] = f"Quibble Xo {far} mail solo@x.org {far} quibble's friend, again Quibble; xo. {far} word7"
    texts[8] = texts[9] = f"Zorblax {far} pair@x.org {far} zorblax {far}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(texts[r.doc_id][s.start : s.end], s.kind) for s in r.spans] for r in pii.with_spans(docs).collect()}
    df = Counter(t for text in texts for t in set(re.findall(r"[^\W\d_][^\W_'-]*(?:['-][^\W_]*)*", text.lower())))
    for i, email in ((7, "solo@x.org"), (8, "pair@x.org"), (9, "pair@x.org")):
        n_e = n_b = 1 if i == 7 else 2
        want = []
        for m in re.finditer(r"\S+@\S+|[^\W\d_][^\W_'-]*(?:['-][^\W_]*)*", texts[i]):
            share = 0 if m[0] == email else math.log((n_b + n_e / n) / (df[m[0].lower()] + 1) * n / n_e) / math.log(n / n_e)
            if m[0] == email or share >= 0.8:
                want.append((m[0], "email" if m[0] == email else "removed" if share >= 0.95 else "generalised"))
        assert got[i] == want and len(want) >= 3
    assert [t for t, k in got[7] if k != "email"] == ["Quibble", "Xo", "mail", "quibble's", "friend", "again", "Quibble", "xo"]
    assert not any(s for i, s in got.items() if i not in (7, 8, 9))


def test_long_lists_keep_pairs_of_sets_without_class_counts():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 56, 80_000, dtype=np.uint64))
    sets = [np.unique(np.r_[base[200 * k :], rng.integers(0, 1 << 56, 100, dtype=np.uint64)]) for k in range(7)]
    sets.sort(key=len)
    hists = [jj._histogram(u) for u in sets]
    assert hists == [None] * 7
    columns = [[1] * 7, range(7), [len(u) for u in sets], [0] * 7, range(7), hists]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=list("abcdef"))
    pairs = {p for b in jj._across(75, False)(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert {(i, j) for j in range(7) for i in range(j)} == pairs
    small = [rng.integers(0, 1 << 56, 1000, dtype=np.uint64) for _ in range(2)]  # nothing in common: class counts tell
    columns = [[1] * 2, range(2), [1000] * 2, [0] * 2, range(2), [jj._histogram(u) for u in small]]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=list("abcdef"))
    assert not list(jj._across(75, False)(iter([batch])))


def test_blocks_of_items_do_not_join_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x y z w"), (None, "a b q q"), (None, "c d q q"), (None, "q q q q"), (2, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, "a b"), (11, "b c"), (12, "c d"), (13, "y z"), (None, "x y"), (14, "no")], "item_id long, text string")
    counted = lambda **how: Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in dc.decontaminate(docs, items, **how).collect())
    want = Counter({(1, 4, 4, (10, 11, 12), True): 2, (1, 4, 3, (13,), True): 1, (None, 4, 2, (10,), True): 1, (None, 4, 2, (12,), True): 1, (None, 4, 0, (), False): 1, (2, 0, 0, (), False): 2})
    assert counted() == want and counted(block_chars=6) == want


def test_url_scores_against_brute_force(spark, monkeypatch):
    rows = [(i % 130, f"https://{h}.net/{p}{i % 90}") for i in range(200) for h, p in (("good", "a"), ("bad", "zz-é𝔸"))]
    urls = sorted({u for _, u in rows}) + ["x" * 100_000]
    verdict = lambda u: "allow" if "good" in u else "block" if "bad" in u else None
    table = spark.createDataFrame([(u, verdict(u)) for u in urls], "url string, verdict string").selectExpr("*", "unhex(md5(url)) AS id")
    fit = {r.url for r in table.selectExpr("url", "pmod(xxhash64(url), 2) = 0 AS fit").collect() if r.fit}
    windows = lambda u: [("\x02" * 2 + u + "\x03")[i : i + 3] for i in range(len(u) + 1)]
    counts = {v: [Counter(w[2 - k :] for u in urls if u in fit and verdict(u) == v for w in windows(u)) for k in range(3)] for v in ("allow", "block")}

    def p(w, v):
        out = 1 / 256
        for k in range(3):
            g = w[2 - k :]
            total = sum(c for x, c in counts[v][k].items() if x[:k] == g[:k])
            out = (counts[v][k][g] + 2 * out) / (total + 2)
        return out

    for bound in (500_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", bound)
        scores, cut = url_filter.score_urls(table, order=2)
        got = {r.url: r.score for r in scores.join(table, "id").collect()}
        assert set(got) == set(urls) and cut is not None
        for u in urls[:5] + urls[-3:]:
            ws = Counter(windows(u))
            want = sum(n * math.log(p(w, "allow") / p(w, "block")) for w, n in ws.items()) / (len(u) + 1)
            assert abs(got[u] - want) < 1e-6
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[0][1], "x", 2)], "page_id long, url string, id string, n int")
    assert Counter(r.page_id for r in url_filter.judge_urls(pages).collect()) == Counter([r[0] for r in rows] + [None])
