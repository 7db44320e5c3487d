import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import exact_dedup as ed
from quarrystone.llm import line_dedup as ld
from quarrystone.llm import mixing as mx
from quarrystone.llm import runs as rn

DOCS = "doc_id long, text string, source string, size string, keep_id string"
ROWS = [
    (1, "a b\nc", "s1", "x", "y"), (2, "ab c", "s1", "x", "y"), (3, "abc", None, "x", "y"), (4, None, "s2", None, None),
    (5, "", "s2", "x", "y"), (6, " \t", None, "x", "y"), (7, "word " * 4000, "s1", "x", "y"), (7, "word " * 4000, "s1", "x", "y"),
    (8, "Äb\nÄB \n\n end", "s3", "x", "y"), (None, "lost id", "s3", "x", "y"),
]


def test_exact_dedup_against_brute_force(spark):
    for digest_bytes in (32, 0):  # 0: every digest collides, so bytes decide
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(spark.createDataFrame(ROWS, DOCS), 3, digest_bytes).collect()}
        groups = defaultdict(list)
        for i, t, *_ in ROWS:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i or 0, i))
        want = set()
        for norm, members in groups.items():
            best = min(members)
            for m in members:
                want.add((m[3], best[3], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()))
        assert got == want


def test_digest_index_asks_filters_and_compacts(spark):
    index = ed.DigestIndex()
    for b in range(5):
        index.add(spark.createDataFrame([(f"d{b % 3}", 10 + b, b), (f"own{b}", 1, b)], "digest string, n_chars long, doc_id long"))
    assert len(index.runs()) == 2 and index.asked == 1 + 1 + 2 + 1  # after 1, 2, 3 and 4 batches: 1, 1, 2 and 1 runs
    assert {r.digest for r in index.repeated().collect()} == {"d0", "d1"}
    found = {r.digest: (r.group_size, r.keep_id) for r in index.lookup(spark.createDataFrame([("d1",), ("no",)], "digest string")).collect()}
    assert found == {"d1": (2, 4)}
    assert {(r.digest, r.group_size) for r in index.merged().collect()} == {("d0", 2), ("d1", 2), ("d2", 1), *((f"own{b}", 1) for b in range(5))}


def test_filters_let_all_of_their_keys_through(spark):
    keys = spark.range(5000).selectExpr("cast(id * 7 AS string) AS k")
    bits = rn.build_filter(keys, "k", "test-filter")
    assert rn.let_through(keys, "k", bits).count() == 5000
    assert rn.let_through(spark.range(5000).selectExpr("concat('x', id) AS k"), "k", bits).count() < 600


def test_runs_merge_without_shuffle_or_sort(spark):
    of = lambda a, b: rn.flush(spark.range(a, b).selectExpr("id % 100 AS k").groupBy("k").count(), "k", "test-run")
    x, y = of(0, 60), of(40, 90)
    plan = rn.missing(x, y, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert sorted(r.k for r in rn.missing(x, y, "k").collect()) == list(range(40)) and rn.present(x, y, "k").count() == 20


def test_split_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(rn, "HEAVY", 3)
    rows = spark.range(300).selectExpr("id", "if(id < 150, 'hot', concat('k', id % 40)) AS k")
    table = rows.where("k not in ('k3', 'k4')").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, rows.join(table, "k", how).select("k", "id", "n").collect()))
        assert Counter(map(tuple, rn.split_join(rows, table, "k", "n", 300, how).select("k", "id", "n").collect())) == want


def test_line_dedup_against_brute_force(spark):
    rows = [*ROWS, *[(100 + i, f"Shared line\n own {i}\n\nshared LINE ", "s", "x", "y") for i in range(6)]]
    for least, chars in ((3, 1), (2, 0), (100, 1)):
        got = Counter((r.doc_id, r.n_lines_, r.n_dropped_, r.text, r.keep_id) for r in ld.line_dedup(spark.createDataFrame(rows, DOCS), least, chars, 3).collect())
        key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
        df = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
        want = Counter()
        for i, t, _, _, k in rows:
            lines = (t or "").split("\n")
            left = [x for x in lines if len(key(x)) < chars or df[key(x)] < least]
            want[(i, len(lines), len(lines) - len(left), "\n".join(left), k)] += 1
        assert got == want


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(500, None, "s1"), (501, "", "empty")]
    rows += [(600 + i, "w " * 400, "s3") for i in range(3)] + [(700, "again " * 9, "s0")] * 3 + [(None, "no id", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mix_counts(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mx.mix_counts(docs.repartition(3)).collect())) and len(got) == len(rows)
    assert sorted(map(repr, ((r.doc_id, r.copies) for r in got))) == sorted(map(repr, ((r.doc_id, r.copies) for r in mx.mix(docs).collect())))
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        room = left - sum(2 * sizes[s] for s in full)
        want = {s: room * weight[s] / sum(weight[x] for x in rest) for s in rest} | {s: 2 * sizes[s] for s in full}
        over = {s for s in rest if want[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    some = 0
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 25
        mine = [r for r in got if r.source == s and r.size]
        if not mine or want[s] >= 2 * sizes[s]:
            assert all(r.rate == 2 for r in mine)
            continue
        # The dual by halving.
        mean, lo, hi = sizes[s] / len(mine), -1e6, 1e6
        for _ in range(300):
            lam = (lo + hi) / 2
            have = sum(r.size * min(2, math.exp(min(1, lam * r.size / mean))) for r in mine)
            lo, hi = (lam, hi) if have < want[s] else (lo, lam)
        assert all(abs(r.rate - min(2, math.exp(min(1, lo * r.size / mean)))) < 1e-6 for r in mine)
        assert abs(sum(r.size * r.rate for r in mine) - want[s]) <= 1e-6 * want[s]
        some += len({r.rate for r in mine}) > 3
    assert some > 1


def test_dual_moves_and_says_when_it_fails(spark, monkeypatch):
    cells = spark.createDataFrame([(k, n, 1 + n % 3) for k in ("sa", "sb") for n in (1, 5, 60, 900, 20000)], "key string, size long, n long")
    sources, dual = mx.balanced(cells, (3, 1, 2), 1.4, 2)
    assert sources.count() == 2 and all(r.moves > 1 and r.gap < 1e-9 for r in dual.collect())
    monkeypatch.setattr(mx, "ITERATIONS", 2)
    with pytest.raises(ArithmeticError):
        mx.balanced(cells, (3, 1, 2), 1.4, 2)


def test_mix_divides_large_sizes(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id AS doc_id", "'same size here' AS text", "if(id < 600, 'a', 'b') AS source")
    rates = lambda: Counter((r.source, r.copies, r.rate) for r in mx.mix_counts(docs, (1, 3), 1.3).collect())
    whole = rates()
    monkeypatch.setattr(mx, "BIN", 7)
    assert rates() == whole and sum(whole.values()) == 900


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ed.exact_dedup(none).count() == ld.line_dedup(none).count() == mx.mix(none).count() == 0
    assert mx.mix(spark.createDataFrame(ROWS, DOCS)).count() == len(ROWS)
