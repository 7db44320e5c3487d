"""The stages of the pipeline against brute force, on rows with null and repeated ids, empty and long texts and more columns."""

import random
import re
from collections import Counter

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, copies string"


def _row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), "x", None, "y")


def _rows():
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [_row(i, some(rng.randint(30, 90)), f"s{i % 3}" if i % 7 else None) for i in range(80)]
    near = rows[1][1].split()
    rows += [_row(100 + i, " ".join([*near[:-1], f"edit{i}"])) for i in range(4)]
    rows += [_row(None, rows[5][1]), _row(None, "no id " + some(40)), rows[6], rows[6], _row(7, some(50)), _row(None, None), _row(None, None), _row(200, ""), _row(201, " \n")]
    rows += [_row(300, "long " * 20_000 + some(9)), _row(None, "short text")]
    return rows


def _write(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def _rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_near_duplicates_keep_one_of_each_group(spark, tmp_path):
    rows = _rows()
    docs = _write(spark, tmp_path, rows, [])
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][0], rows[i][1] or "") == (rows[j][0], rows[j][1] or "")
            if same or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = {}
    for i, r in enumerate(rows):
        if group[i] not in kept or (r[0] is None, r[0] or 0) < (kept[group[i]][0] is None, kept[group[i]][0] or 0):
            kept[group[i]] = r
    assert _rows_of(cp.near_duplicates(spark, docs, str(tmp_path))) == Counter(kept.values())


def test_decontamination_looks_at_every_row_by_itself(spark, tmp_path):
    rows = _rows()
    items = [(1, rows[5][1]), (2, rows[87][1]), (3, None), (4, "zz yy")]
    docs = _write(spark, tmp_path, rows, items)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = set()
    for _, t in items:
        b = words(t)
        n = min(10, len(b))
        windows |= {tuple(b[k : k + n]) for k in range(len(b) - n + 1 if n else 0)}
    hit = lambda t: any(tuple(w[p : p + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for p in range(len(w) - n + 1))
    want = Counter(r for r in rows if not hit(r[1]))
    assert 0 < sum(want.values()) < len(rows)
    assert _rows_of(cp.benchmark(spark, docs, str(tmp_path))) == want


def test_lines_and_quality_pass_rows_on(spark, tmp_path):
    rows = [*_rows(), *[_row(500 + i, f"Shared line\nown {i}") for i in range(10)]]
    docs = _write(spark, tmp_path, rows, [])
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    df = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    want = Counter()
    for r in rows:
        text = "\n".join(x for x in (r[1] or "").split("\n") if not key(x) or df[key(x)] < 10)
        want[(r[0], text, r[2], r[3], len(text), *r[5:])] += 1
    assert _rows_of(cp.lines(spark, docs, str(tmp_path))) == want
    assert _rows_of(cp.quality(spark, docs, str(tmp_path))) == Counter(rows)  # without labels everything stays


def test_mixture_gives_whole_copies(spark, tmp_path):
    docs = _write(spark, tmp_path, _rows(), [])
    out = cp.mixture(spark, docs, str(tmp_path))
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and {r.copy for r in rows} == {1, 2}
    times = Counter((r.doc_id, r.text) for r in rows)
    plan = Counter()
    for r in _rows():
        plan[(r[0], r[1])] += 1
    assert all(n <= 2 * plan[k] for k, n in times.items()) and not any(not (t or "").strip() for _, t in times)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r["size"] for r in mine) - mine[0].target) <= max(60, max(r["size"] for r in mine) / 2)


def test_stages_of_empty_tables(spark, tmp_path):
    docs = _write(spark, tmp_path, [], [])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_run_keeps_what_the_stages_keep(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = cp.saved(stage(spark, docs, sf), "stage")
        assert out.columns == docs.columns
        docs = out
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    mix = cp.run(spark, sf).select("doc_id", "copy").collect()
    assert {r.doc_id for r in mix} <= ids and len(mix) == len({tuple(r) for r in mix})
