"""Versions of tables, the saved index, lines of documents and linking, against brute force and on empty and null rows."""

import re

import pytest

from quarrystone.operators import bm25_index, units
from quarrystone.sources import versions


def test_versions(spark, tmp_path):
    root = f"file:{tmp_path}/lib"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "t")
    built = []

    def build(n):
        def run():
            built.append(n)
            return {"t": spark.range(n), "parents": spark.range(1)}
        return run

    first = versions.load_or_build(spark, root, "a", build(1))
    assert versions.load_or_build(spark, root, "a", build(9)) == first and built == [1]
    versions.load_or_build(spark, root, "b", build(2))
    spark.range(7).write.parquet(f"{root}/v00000003-c/t")  # a job that died before its mark
    assert versions.read(spark, root, "t").count() == 2
    assert versions.publish({"t": spark.range(4)}, root, "d", keep=2).startswith("v00000004")
    assert [n[10:] for n in versions.versions(spark, root)] == ["b", "d"]
    assert sorted(p.name[10:] for p in (tmp_path / "lib").iterdir()) == ["b", "d"]
    assert versions.roll_back(spark, root).endswith("b") and versions.read(spark, root, "t").count() == 2
    with pytest.raises(ValueError):
        versions.roll_back(spark, root)


def test_signature_follows_files(spark, tmp_path):
    path = f"file:{tmp_path}/d"
    spark.range(3).write.parquet(path)
    one = versions.signature(spark, path, 1)
    assert one == versions.signature(spark, path, 1) != versions.signature(spark, path, 2)
    spark.range(1).write.mode("append").parquet(path)
    assert one != versions.signature(spark, path, 1)


def test_index_of_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "B c"), (5, "... "), (6, "c b")], "doc_id long, text string")
    folder = f"file:{tmp_path}/i"
    for t, df in bm25_index.tables(docs).items():
        df.write.parquet(f"{folder}/{t}")
    assert [r.doc_id for r in bm25_index.search(spark, folder, "a A!", 5).collect()] == [1]
    assert [r.doc_id for r in bm25_index.search(spark, folder, "c", 5).collect()] == [4, 6]  # a tie
    assert bm25_index.search(spark, folder, "?", 5).isEmpty() and bm25_index.search(spark, folder, "zz", 5).isEmpty()


def test_contents_and_outline(spark):
    texts = {"a": ["title", "目录", "one", "two", "one", "body。"], "b": ["目 次", "x", None, "long。", "x"], "c": ["x", "y"], "d": ["目录"], "e": ["目录", "no。", "no。"]}
    lines = spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc string, k int, text string")
    kept = {}
    for r in units.without_contents(lines, "doc", "k").orderBy("doc", "k").collect():
        kept.setdefault(r.doc, []).append(r.k)
    assert kept == {"a": [0, 4, 5], "b": [4], "c": [0, 1], "e": [1, 2]}
    heads = spark.createDataFrame([("a", i, lv, str(i)) for i, lv in enumerate([None, 1, 3, 2, 3, None, 1, 2])], "doc string, k int, level int, text string")
    out = units.outline(heads, "doc", "k", "level").orderBy("k").collect()
    assert [(r.section, r.path) for r in out] == [(0, []), (1, ["1"]), (2, ["1", "2"]), (3, ["1", "3"]), (4, ["1", "3", "4"]), (4, ["1", "3", "4"]), (5, ["6"]), (6, ["6", "7"])]


def _linked(term, chapter, concepts, least=3):
    flat = lambda x: re.sub(r"[\W_]+", "", x or "").lower()
    key = flat(term)
    for scope in ([chapter] if chapter is not None else []) + [None]:
        pool = {flat(n) for n, c in concepts if scope is None or c == scope} - {""}
        parts = [p for p in map(flat, re.split(units.DIVIDERS, term or "")) if len(p) >= 2]
        inside = sorted((n for n in pool if len(n) >= least and n in key), key=lambda n: (-len(n), n))
        free, taken = [], [False] * len(key)
        for n in inside:
            at = [i for i in range(len(key) - len(n) + 1) if key.startswith(n, i) and not any(taken[i : i + len(n)])]
            if at:
                taken[at[0] : at[0] + len(n)] = [True] * len(n)
                free.append(n)
        around = sorted((n for n in pool if len(key) >= least and key in n), key=lambda n: (len(n), n))[:2]
        ways = [("exact", [key] if key in pool else []), ("split", [p for p in sorted(set(parts)) if p in pool] if len(parts) > 1 else []), ("contains", free), ("within", around)]
        for how, names in ways:
            if names:
                return names, f"{how}:{'cross' if scope is None else 'same'}"
    return [], "none"


def test_links_against_brute_force(spark):
    concepts = [("数据要素", 1), ("数据", 1), ("要素市场", 2), ("数据要素市场化", 2), ("Data Space", 3), ("", 1), ("数字经济", 3), ("平台治理", None)]
    terms = ["数据要素", "数据要素市场", "要素市场、数字经济", "数字经济和数据", "data  space!", "经济", "字经济", "研究数据要素与平台治理", "", None, "、", "市场化"]
    rows = [(i, c, t) for i, t in enumerate(terms) for c in (1, 2, 3, None)]
    asked = spark.createDataFrame(rows + rows[:3], "id int, chapter int, term string")
    got = {(r.id, r.chapter, r.term): (r.names, r.how) for r in units.link_terms(asked, spark.createDataFrame(concepts, "name string, chapter int")).collect()}
    assert got == {k: _linked(k[2], k[1], concepts) for k in rows}
    none = spark.createDataFrame([], "name string, chapter int")
    assert {r.how for r in units.link_terms(asked, none).collect()} == {"none"}


def test_registered_links_against_brute_force(spark):
    from quarrystone.plans import unit_queries

    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet").collect()
    concepts = {(n, p.p_partkey % 4) for p in part for n in [p.p_name, p.p_type, *p.p_name.split(" ")]}
    got = unit_queries.QUERIES["term_links"](spark, sf).collect()
    assert len(got) == len(part)
    assert all((r.names.split("|") if r.names else [], r.how) == _linked(r.term, r.chapter, concepts) for r in got)
