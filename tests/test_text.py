import pytest
from pyspark.sql import functions as F

from lectern.functions import question as Q
from lectern.functions import text as T
from lectern.operators import validate as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.half_width, "ＡＢＣ１２３（", "ABC123（"),
        (T.bracket_label, "【答案】A", "答案：A"),
        (T.bracket_label, "（参考答案）：B", "参考答案：B"),
        (T.bracket_label, "[解析] x", "解析：x"),
        (T.one_line, " a\n\n b  c ", "a b c"),
        (T.normalize, "正确答案 : A", "答案： A"),
        (T.compact, "A, b（c）。", "abc"),
        (T.strip_tags, "<p>x</p>", "x"),
        (T.xml_entities, "&amp;#65;&lt;&#x42;", "A<B"),
        (T.safe_name, 'a/b:c*"', "a_b_c__"),
        (T.safe_name, "", "题库"),
        (T.option_signature, "Ａ – ｂ。", "a-b"),
        (T.repair_mojibake, "ä¸­æ\x96\x87", "中文"),
        (T.nfkc, "①ﬁ", "1fi"),
        (Q.difficulty, "容易", "简单"),
        (Q.difficulty, "无关的很长的一段文字不是难度", ""),
        (Q.header_class, "备选项A", "option:A"),
        (Q.header_class, "题 干", "question"),
        (Q.header_class, "其他", None),
        (Q.issue_kind, "答案不符（C）", "answerMismatch"),
        (Q.issue_kind, "什么", "other"),
    ],
)
def test_values(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_anomalies(spark):
    assert one(spark, "a�b", T.encoding_anomaly)
    assert not one(spark, "面积为 5m²，误差±0.5%", T.encoding_anomaly)


def test_join_modes(spark):
    lines = ["第一行，", "续写", "1. 要点", "abc", "def"]
    assert one(spark, lines, lambda c: T.smart_join(c, "question"), "array<string>") == "第一行，续写1. 要点abc def"
    assert one(spark, lines, lambda c: T.smart_join(c, "answer"), "array<string>") == "第一行，续写\n1. 要点\nabc\ndef"


OPTIONS = "array<struct<key:string,text:string,images:array<string>>>"
SCHEMA = f"id int, question string, type string, options {OPTIONS}, answer array<string>, answer_text string, inferred_boundary boolean, duplicate_of string, raw_texts array<string>"


@pytest.mark.parametrize(
    ("row", "issues", "confidence", "status"),
    [
        (("四个字的题干", "single", [("A", "甲", []), ("B", "乙", [])], ["A"], "", False, None, []), [], 100, "normal"),
        (("题", "single", [("A", "甲", []), ("B", "乙", [])], ["C"], "", False, None, []), ["题干缺失或过短", "答案不符（C）"], 15, "error"),
        (("四个字的题干", "single", [], [], "", False, None, []), ["选项不足", "无答案"], 25, "error"),
        (("四个字的题干", "short", [], [], " ", False, None, []), ["无答案"], 65, "warning"),
        (("四个字的题干", "multiple", [("A", "甲", []), ("B", "乙", [])], ["A"], "", True, "q1", []), ["多选仅一项", "边界待查", "重复题"], 62, "warning"),
        (("四个字的题干", "judge", [("A", "正确", []), ("B", "错误", [])], ["A"], "", False, None, []), [], 100, "normal"),
        (("四个字的题干", "single", [("A", "甲", []), ("B", "甲。", [])], ["A"], "", False, None, []), ["疑似重复（A、B）"], 82, "warning"),
        (("四个字的题干", "single", [("A", "甲", []), ("B", "甲", [])], ["A"], "", False, None, ["A. 甲\nB. 甲"]), ["导入片段重复（A、B）"], 92, "warning"),
        (("四个字的题干", "single", [("A", "甲", []), ("B", "甲", [])], ["A"], "", False, None, ["A. 甲\nB. 乙"]), ["解析重复（A、B）"], 82, "warning"),
        (("四个字的题干", "single", [("A", "图形", []), ("B", "图", [])], ["A"], "", False, None, []), ["图片选项缺少图像"], 80, "warning"),
    ],
)
def test_validation(spark, row, issues, confidence, status):
    got = V.validate(spark.createDataFrame([(1, *row)], SCHEMA)).first()
    assert (got["issues"], got["confidence_x100"], got["status"]) == (issues, confidence, status)
