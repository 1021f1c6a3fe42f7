"""Exact values of the label, id and response rules."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("label,ok", [("加法", True), ("一元二次方程", True), ("小结", False), ("  ", False), (None, False), ("复习题1", False), ("例3 面积", False), ("第二章", False), ("12", False), ("1.1", False), ("1.2.3", False), ("123", False), ("①", False), ("1.1 正数", True), ("3.", True), ("复习题一", False), ("阅读与思考　圆", False)])
def test_valid_points(spark, label, ok):
    assert one(spark, label, T.is_valid_point) is ok


@pytest.mark.parametrize("raw,label,order", [("3.1-5的认识和加减法", "5的认识和加减法", "3.1"), ("18.1.1-平行四边形", "平行四边形", "18.1.1"), ("8-圆", "圆", "8"), ("测量：", "测量", None), ("a  b", "ab", None), (" １２ ", "12", None), ("", "", None), (None, None, None)])
def test_sections(spark, raw, label, order):
    got = one(spark, raw, T.clean_section)
    assert (got.label, got.order_in_book) == (label, order)


@pytest.mark.parametrize("label,grade,want", [("方程的应用", "七年级", 4), ("初步认识", "一年级", 1), ("综合推理证明分析", "必修第三册", 5), ("圆", None, 3), ("圆", "学前", 3)])
def test_difficulty(spark, label, grade, want):
    df = spark.createDataFrame([(label, grade)], "a string, b string")
    assert df.select(T.difficulty(F.col("a"), F.col("b")).alias("y")).first().y == want


def test_importance_takes_the_first_group(spark):
    assert one(spark, "运算法则", lambda c: T.first_keyword(c, rules.IMPORTANCE, "重要")) == "核心"
    assert one(spark, "圆", lambda c: T.first_keyword(c, rules.IMPORTANCE, "重要")) == "重要"
    assert one(spark, None, lambda c: T.first_keyword(c, rules.IMPORTANCE, "重要")) == "重要"


@pytest.mark.parametrize("uri,want", [("http://kg.example/instance/biology#x", "biology"), ("http://kg.example/instance/math/x", "math"), ("http://kg.example/class/x", "unknown"), ("", "unknown"), (None, "unknown")])
def test_subjects(spark, uri, want):
    assert one(spark, uri, T.subject_of_uri) == want


@pytest.mark.parametrize("name,want", [("高中数学必修第一册", "math"), ("索引", "unknown"), ("生物学", "biology")])
def test_subject_names(spark, name, want):
    groups = {}
    for word, code in rules.SUBJECT_NAMES.items():
        groups.setdefault(code, []).append(word)
    assert one(spark, name, lambda c: T.first_keyword(c, groups, "unknown")) == want


def test_ids(spark):
    df = spark.createDataFrame([("人教版", "一年级", "上册"), ("X", "必修第一册", None)], "p string, g string, s string")
    assert [r.y for r in df.select(T.textbook_id(F.col("p"), F.col("g"), F.col("s")).alias("y")).collect()] == ["renjiao-g1s", "X-bixiu1"]
    assert tuple(one(spark, "renjiao-g1s", T.parse_textbook_id)) == ("renjiao", "g1", "s")
    assert one(spark, 7, lambda c: T.point_uri("urn:math", F.lit("primary"), c), "int") == "urn:math#textbook-primary-00007"


@pytest.mark.parametrize("content", ['{"a": 1}', 'Answer {"a": 1} end', '```json\n{"a": 1}\n```', "{'a': 1}", '  {"a": 1} '])
def test_json_ladder(spark, content):
    assert one(spark, content, lambda c: T.tolerant_json(c, "a int")).a == 1


@pytest.mark.parametrize("content", ["no json", "", None])
def test_json_ladder_gives_null(spark, content):
    assert one(spark, content, lambda c: T.tolerant_json(c, "a int")) is None


@pytest.mark.parametrize("value,want", [("0.7", 0.7), ("High", 0.9), ("low", 0.3), ("?", 0.5), (None, 0.5)])
def test_confidence(spark, value, want):
    assert one(spark, value, T.confidence) == want


@pytest.mark.parametrize("title,want", [("小学数学", "primary"), ("八年级上册", "middle"), ("必修 第一册", "high"), ("三年级", "primary"), ("目录", None)])
def test_stages(spark, title, want):
    assert one(spark, title, T.school_stage) == want


@pytest.mark.parametrize("text,kind,name", [("第一章 有理数", "chapter", "有理数"), ("1.准备课", "chapter", "准备课"), ("1.1 正数和负数", "subsection", "1 正数和负数"), ("位置", "other", "位置"), ("1　数据收集整理", "chapter", "数据收集整理")])
def test_headings(spark, text, kind, name):
    assert one(spark, text, T.heading_kind) == kind
    assert one(spark, text, T.heading_name) == name


def test_urls(spark):
    assert tuple(one(spark, "http://x/20.html", T.grade_of_url)) == ("primary", "1年级", "下册")
    assert tuple(one(spark, "http://x/33.html", T.grade_of_url)) == ("middle", "8年级", "上册")
    assert tuple(one(spark, "http://x/a.html", T.grade_of_url)) == (None, None, None)


def test_small_rules(spark):
    assert one(spark, " A（b）【c】 d　", T.normal_label) == "a(b)[c]d"
    assert one(spark, None, T.normal_label) == ""
    assert one(spark, " a (b)：c/d ", T.uri_safe) == "a_b_c_d"
    assert one(spark, "a。b，c.\n\n d ", T.spans) == ["a", "b", "c", "d"]
    assert one(spark, "你好，a.b!", T.without_punctuation) == "你好ab"
    assert one(spark, "图案设计", T.is_core_concept) is False
    assert one(spark, "圆", T.is_core_concept) is True
    assert one(spark, "全　角  x ", T.quality_issues) == ["full_width", "extra_space", "trailing_space"]
    df = spark.createDataFrame([("abc", "xbcb")], "a string, b string")
    assert df.select(T.char_overlap(F.col("a"), F.col("b")).alias("y")).first().y == pytest.approx(2 / 3)
