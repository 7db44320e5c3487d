import pytest
from pyspark.sql import functions as F

from quarrystone.functions import scalars as sc
from quarrystone.operators import units as un


def _of(spark, f, values, kind="string"):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numerals(spark):
    assert _of(spark, sc.numeral, ["21", "二十一", "十", "一百零五", "三百二十", "x", "", None, "九"]) == [21, 21, 10, 105, 320, None, None, None, 9]
    assert _of(spark, sc.article_number, ["第二十一条 内容", "第 7 条", "第一章"]) == [21, 7, None]


def test_words_and_names(spark):
    assert _of(spark, sc.words, ["ABC 数据要素 x1、新", "", None, "ＡＢ１　研究"]) == [["abc", "数据", "据要", "要素", "x1", "新"], [], [], ["ab1", "研究"]]
    assert _of(spark, sc.broken_name, ["a/b.txt", "a/�.txt", ""]) == [False, True, True]


def test_exam_texts(spark):
    assert _of(spark, sc.quoted_terms, ["说“甲乙”和“ 丙 ”及“甲乙”", "none"]) == [["甲乙", "丙"], []]
    assert _of(spark, sc.sub_questions, ["案例【分析问题】（1）何谓甲？（2）为何？", "no"]) == [["何谓甲？", "为何？"], []]
    assert _of(spark, sc.options, ["A. one B．two TB. x C. three", "only"]) == [{"A": "one", "B": "two TB. x", "C": "three"}, {"A": "only"}]
    old, new = "（1）（占40%）甲；（2）（占60%）乙。", "（1）甲（50%）；（2）乙（50%）。允许"
    assert [[tuple(p) for p in x] for x in _of(spark, sc.scoring, [old, new, "none"])] == [[("甲", 40), ("乙。", 60)], [("甲", 50), ("乙", 50)], []]


def test_answer_texts(spark):
    assert _of(spark, sc.markers, ["见［ s 1 ］和【C2】【x】"]) == ["见[S1]和[C2][x]"]
    out = _of(spark, lambda x: sc.without_made_up_quotes(x, F.array(F.lit("他说：数据是新的生产要素，很重要。"))), ["指出：“数据是新的生产要素”。又说：“从来没有人说过这样的话”。“短”"])
    assert out == ["指出：“数据是新的生产要素”。又说。“短”"]


def test_dates_and_maps(spark):
    assert [str(d) for d in _of(spark, sc.prose_date, ["于2021年 6月10日通过", "2021年13月1日", "x"])] == ["2021-06-10", "None", "None"]
    assert [str(d) for d in _of(spark, sc.opening_date, [["标题", "（2020年5月28日通过）"], ["2020年5月28日"], []], "array<string>")] == ["2020-05-28", "None", "None"]
    hours = [f"2024-01-01 {h:02d}:30:00" for h in (0, 1, 3, 4, 6, 9, 10, 23)]
    assert _of(spark, lambda x: sc.off_peak(x.cast("timestamp")), hours) == [True, False, False, True, False, False, True, True]
    got = _of(spark, lambda x: sc.merged(["a", "b", "c"], x, F.create_map(F.lit("b"), F.lit("2"))), [{"a": "1", "b": "0"}, None], "map<string,string>")
    assert got == [{"a": "1", "b": "2", "c": None}, {"a": None, "b": "2", "c": None}]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert rows.where(sc.predicate(["a=1", " b = x "])).count() == 1 and rows.where(sc.predicate([])).count() == 2
    with pytest.raises(ValueError):
        sc.predicate(["=x"])


def test_islands_and_bins(spark):
    rows = [(1, i, b, k) for i, (b, k) in enumerate([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("b", 1), (None, 1), (None, 1)])] + [(2, 0, "b", 1)]
    got = un.islands(spark.createDataFrame(rows, "d int, i int, b string, k int"), "d", "i", "b", F.col("k") == 1).orderBy("d", "i").collect()
    assert [r.island for r in got] == [1, 1, 2, 3, 4, 4, 1]
    items = spark.createDataFrame([("g", i, n) for i, n in enumerate([4, 3, 5, 20, 1, 9, 1])], "g string, i int, n int")
    assert [r.bin for r in un.bins_by_budget(items, "g", ["i"], "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_anchors(spark):
    chunks = spark.createDataFrame([("c1", "Alpha, beta", ["p1"], 0), ("c2", "gamma", ["p1"], 1), ("c3", "x", ["p2"], None), ("c4", "y", ["p2"], 0)], "chunk_id string, text string, anchors array<string>, split_part int")
    asked = spark.createDataFrame([("p1", "alpha BETA"), ("p1", "zeta"), ("p2", "x"), ("p3", "x"), ("p1", None)], "anchor string, quote string")
    got = {(r.anchor, r.quote, r.chunk_id) for r in un.anchor_join(asked, chunks).collect()}
    both = {("p1", q, c) for q in ("zeta", None) for c in ("c1", "c2")}
    assert got == {("p1", "alpha BETA", "c1"), ("p2", "x", "c3"), ("p2", "x", "c4")} | both
    edges = asked.withColumn("concept", F.concat(F.lit("k"), "anchor"))
    assert {r.chunk_id: r.concepts for r in un.concepts_of_chunks(edges, chunks).collect()}["c3"] == ["kp2"]


def test_similar_texts(spark):
    rows = spark.createDataFrame([("abcdef", "xxbcdeyy"), ("", "a"), (None, None), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in rows.select(un.longest_common("a", "b")).collect()] == [4, 0, 0, 3]
    assert [round(r[0], 3) for r in rows.select(un.coverage("a", "b")).collect()] == [0.667, 0, 0, 1]
    docs = spark.createDataFrame([("数据要素市场与数据",), (None,)], "text string")
    names = spark.createDataFrame([("数据要素",), ("数据",), ("要素市场",), ("",)], "name string")
    assert [r.found for r in un.longest_names(docs, names).collect()] == [["数据要素", "数据"], []]


def test_grouped_split(spark):
    rows = [(f"u{i:02d}", f"t{i % 3}", k) for i in range(40) for k in range(1 + i % 5)] + [("big", "t0", k) for k in range(40)] + [(None, "t1", 0)]
    items = spark.createDataFrame(rows, "who string, topic string, k int")
    train, test = un.grouped_split(items, "who", "topic")
    a, b = {r.who for r in train.collect()}, {r.who for r in test.collect()}
    assert not a & b and train.count() + test.count() == len(rows) and "big" in a
    assert 0.08 * len(rows) <= test.count() <= 0.10 * len(rows)
    assert un.seeded_sample(items, "k", 5, "s").count() == 5
