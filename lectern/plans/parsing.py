"""The parser (survey sections 2.4, 2.5, 2.8.2 and 2.11): documents made of each supplier's name, read to questions.

A case gives a document's lines and the questions that must come of it, as templates in which ``{n}``
is the supplier's name, ``{k}`` its number and ``{c}`` its nation's: Spark builds the lines from
the table and parses them, SQL builds the questions from the same table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.operators import parser
from lectern.operators import sequence as W
from lectern.plans import views as v
from lectern.plans.registry import QUERIES, SQL, query

_SPARK = {"n": "name", "k": "k", "c": "nation"}
_DUCK = {"n": "s_name", "k": "s_suppkey::VARCHAR", "c": "('N' || s_nationkey)"}


def suppliers(spark, d) -> DataFrame:
    s = v.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation"))


def spark_text(template: str) -> Column:
    return F.concat(F.lit(""), *(F.col(_SPARK[part[1]]) if re.fullmatch(r"\{[nkc]\}", part) else F.lit(part) for part in re.split(r"(\{[nkc]\})", template) if part))


def sql_text(template: str | None) -> str:
    if template is None:
        return "NULL"
    if not template:
        return "''"
    parts = [_DUCK[part[1]] if re.fullmatch(r"\{[nkc]\}", part) else "'" + part.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for part in re.split(r"(\{[nkc]\})", template) if part]
    return "(" + (" || ".join(parts) or "''") + ")"


@dataclass
class Q:
    """A question that must come out; ``more`` is what the case's own column says of it."""

    number: str
    type: str
    question: str
    options: str = ""
    answer: str = ""
    text: str = ""
    more: str = ""
    label: str = ""


@dataclass
class Case:
    lines: list
    questions: list[Q]
    kind: str = ""
    more: Callable[[], Column] | None = None
    source: str = ""


def paragraphs(spark, d, lines: list, kind: str = "", source: str = "") -> DataFrame:
    """Lines of one document for each supplier; a line is a template, or one with its style, list place or pictures."""
    made = []
    for k, line in enumerate(lines):
        text, more = line if isinstance(line, tuple) else (line, {})
        made.append(F.struct(
            F.lit(k).alias("index"), spark_text(text).alias("text"), F.array(*map(spark_text, more.get("strong", ()))).cast("array<string>").alias("strong"), F.array(*map(spark_text, more.get("images", ()))).cast("array<string>").alias("images"),
            F.lit(more.get("style")).cast("string").alias("style"), F.lit(more.get("num_id")).cast("string").alias("num_id"), F.lit(more.get("level")).cast("int").alias("level"), F.lit(more.get("ordinal")).cast("int").alias("list_ordinal"),
        ))
    rows = suppliers(spark, d).select("path", F.explode(F.array(*made)).alias("p"), spark_text(source).alias("source_name"))
    return rows.select("path", "p.*", F.lit(kind).alias("kind"), "source_name")


def shown(q: DataFrame, more: Column | None) -> DataFrame:
    options = F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["key"], o["text"])), "|")
    return q.select("doc_id", "ord", "number", "type", F.col("display_label").alias("label"), "question", options.alias("options"), F.array_join("answer", "").alias("answer"), F.col("answer_text").alias("text"), (F.lit("") if more is None else F.coalesce(more.cast("string"), F.lit(""))).alias("more"))


def _sql(case: Case) -> str:
    rows = []
    for k, q in enumerate(case.questions, 1):
        options = "" if q.options == "none" else q.options or ("A:正确|B:错误" if q.type == "judge" else "")
        label = q.label or L.CORE_LABELS[q.type]
        fields = (q.number, q.type, label, q.question, options, q.answer, q.text, q.more)
        rows.append(f"SELECT s_suppkey::VARCHAR AS doc_id, {k} AS ord, " + ", ".join(f"{sql_text(x)} AS {name}" for x, name in zip(fields, ("number", "type", "label", "question", "options", "answer", "text", "more"), strict=True)) + " FROM supplier")
    return " UNION ALL ".join(rows)


def case(name: str, lines: list, *questions: Q, kind: str = "", more: Callable[[], Column] | None = None, source: str = "") -> None:
    """Registers a document and its questions as a query."""
    made = Case(lines, list(questions), kind, more, source)

    def run(spark, d, made=made):
        return shown(parser.questions(paragraphs(spark, d, made.lines, made.kind, made.source)), made.more and made.more())

    run.__name__ = name
    QUERIES[name], SQL[name] = run, _sql(made)


AB = ["A. {n}", "B. other"]
_AB = "A:{n}|B:other"

case(
    "prs_main",
    ["{n} 学习资料", "第一章 {c}", "一、单选题（共2题）", "1. 下列哪个是{n}（）。", *AB, "答案：A", "解析：因为{c}", "2. 选择（）。", *AB, "B", "二、判断题", "1. {n}有利于安全。（√）", "2. 不对。", "答案：错误", "三、简答题", "1. 什么是{n}？", "答案：一个供应商", "位于{c}。", "四、填空题", "{n}位于____。", "答案：{c}"],
    Q("1", "single", "下列哪个是{n}（）。", _AB, "A", more="因为{c}"), Q("2", "single", "选择（）。", _AB, "B"), Q("1", "judge", "{n}有利于安全。", answer="A"), Q("2", "judge", "不对。", answer="B"),
    Q("1", "short", "什么是{n}？", text="一个供应商\n位于{c}。"), Q("", "short", "{n}位于____。", text="{c}", label="填空题"), more=lambda: F.col("analysis"),
)
case(
    "prs_question_start",
    ["1/9[单选题]哪个是{n}（）", *AB, "答案：A", "2[题]（判断）{n}有利于安全。", "A", "3 题（单选）选{n}（）", *AB, "B", "【简答题】什么是{n}？", "答案：supplier {k}", "题目：为什么用{n}？", "答案：因为{c}", "第5题 {n}在哪里？", "答案：在{c}", "Q6. {n}有多少？", "答案：{k}个", "7、{n}如何？", "答案：很好"],
    Q("1", "single", "哪个是{n}（）", _AB, "A", more="number and type"), Q("2", "judge", "{n}有利于安全。", answer="A", more="number before 题"), Q("3", "single", "选{n}（）", _AB, "B", more="number before 题"),
    Q("", "short", "什么是{n}？", text="supplier {k}", more="type"), Q("", "short", "为什么用{n}？", text="因为{c}", more="label"), Q("5", "short", "{n}在哪里？", text="在{c}", more="number"), Q("6", "short", "{n}有多少？", text="{k}个", more="number"), Q("7", "short", "{n}如何？", text="很好", more="number"), more=lambda: F.col("boundary"),
)
case(
    "prs_header",
    ["初级工", "电工基础", "一、单选题", "1. 选{n}（）", *AB, "答案：A", ("{c}", {"style": "Heading2"}), "2. 再选{n}（）", *AB, "答案：B", "第二章 控制", "3. 问{n}是什么？", "答案：text"],
    Q("1", "single", "选{n}（）", _AB, "A", more="初级工/电工基础"), Q("2", "single", "再选{n}（）", _AB, "B", more="初级工/N"), Q("3", "short", "问{n}是什么？", text="text", more="初级工/第二章 控制"),
    more=lambda: F.concat_ws("/", "level", F.regexp_replace("category", r"^N\d*$", "N")),
)
case(
    "prs_type_meta",
    ["一、不定项选择题", "1. 选{n}（）", *AB, "答案：AB", "二、匹配题", "1. 匹配{n}。", "答案：{n}-{c}", "三、排序题", "1. 排列{n}。", "答案：BA", "四、计算题", "1. 计算{n}。", "答案：{k}", "五、单项选择题", "1. 一个（）", *AB, "答案：B"],
    Q("1", "multiple", "选{n}（）", _AB, "AB", label="不定项选择题"), Q("1", "short", "匹配{n}。", text="{n}-{c}", label="匹配题"), Q("1", "short", "排列{n}。", text="BA", label="排序题"), Q("1", "short", "计算{n}。", text="{k}", label="计算题"), Q("1", "single", "一个（）", _AB, "B"),
)
case("prs_peel", ["1. （多选题）选{n}（）", *AB, "答案：AB", "2. 【判断】{n}是对的。", "答案：√", "3. 简答题：什么是{n}？", "答案：文字"], Q("1", "multiple", "选{n}（）", _AB, "AB"), Q("2", "judge", "{n}是对的。", answer="A"), Q("3", "short", "什么是{n}？", text="文字"))
case("prs_headings", ["（一）单选题（标准格式）", "1. 选{n}（）", *AB, "答案：A", "## 判断题", "1. {n}是对的。", "答案：对", "简答题、问答题", "1. 谁是{n}？", "答案：文字"], Q("1", "single", "选{n}（）", _AB, "A"), Q("1", "judge", "{n}是对的。", answer="A"), Q("1", "short", "谁是{n}？", text="文字"))
case(
    "prs_declared",
    ["一、单选题（共3题）", "1. 选{n}（）", *AB, "答案：A", "3. 再选（）", *AB, "答案：B", "二、判断题（共 1 题）", "1. {n}是对的。", "答案：对", "2. 多余的。", "答案：错"],
    Q("1", "single", "选{n}（）", _AB, "A"), Q("2", "single", "【原文缺少内容：单选题第 2 题】", more="true"), Q("3", "single", "再选（）", _AB, "B"), Q("1", "judge", "{n}是对的。", answer="A"), Q("2", "judge", "多余的。", answer="B"), more=lambda: F.when(F.col("placeholder"), "true"),
)
case("prs_placeholder", ["一、判断题（共4题）", "2. {n}是对的。", "答案：对"], Q("1", "judge", "【原文缺少内容：判断题第 1 题】", "none", more="error"), Q("2", "judge", "{n}是对的。", answer="A", more="normal"), Q("3", "judge", "【原文缺少内容：判断题第 3 题】", "none", more="error"), Q("4", "judge", "【原文缺少内容：判断题第 4 题】", "none", more="error"), more=lambda: F.col("status"))
case(
    "prs_answer_letters",
    ["1. a{n}（）", *AB, "C. c", "答案：A、C", "2. b（）", *AB, "答案：B。因为{n}", "3. c（）", *AB, "C. c", "答案：ABC", "4. d（）", *AB, "正确答案为：（A B）", "5. e（）", *AB, "答案：A. {n}"],
    Q("1", "multiple", "a{n}（）", _AB + "|C:c", "AC"), Q("2", "single", "b（）", _AB, "B"), Q("3", "multiple", "c（）", _AB + "|C:c", "ABC"), Q("4", "multiple", "d（）", _AB, "AB"), Q("5", "single", "e（）", _AB, "A"),
)
case("prs_is_judgement", ["1. {n}一。", "答案：（正确）", "2. {n}二。", "答案：×", "3. {n}三。", "答案：B（错误）", "4. {n}四。", "答案：【对】。"], Q("1", "judge", "{n}一。", answer="A"), Q("2", "judge", "{n}二。", answer="B"), Q("3", "judge", "{n}三。", answer="B"), Q("4", "judge", "{n}四。", answer="A"))
case("prs_is_short", ["1. {n}的原因是什么？", "因为它在{c}很久了。", "2. 简述{n}。", "①先看。", "②后做。", "3. 选{n}（）", *AB, "A"], Q("1", "short", "{n}的原因是什么？", text="因为它在{c}很久了。"), Q("2", "short", "简述{n}。", text="①先看。\n②后做。"), Q("3", "single", "选{n}（）", _AB, "A"))
case("prs_mapping", ["一、简答题", "1. 写出字母的含义{n}？", "T. 温度 P. 压力 F. 流量", "2. 下一个{n}是什么？", "答案：文字"], Q("1", "short", "写出字母的含义{n}？", text="T. 温度 P. 压力 F. 流量"), Q("2", "short", "下一个{n}是什么？", text="文字"))
case(
    "prs_inline_answer",
    ["1. {n}是对的。（√）", "2. 选{n}（答案：B）", *AB, "3. （A）选哪个{n}", *AB, "4. 选{c}的是 参考答案 B", *AB],
    Q("1", "judge", "{n}是对的。", answer="A"), Q("2", "single", "选{n}", _AB, "B"), Q("3", "single", "选哪个{n}", _AB, "A"), Q("4", "single", "选{c}的是", _AB, "B"),
)
case("prs_inline_short", ["1. 什么是{n}？它是在{c}的一个供应商", "2. {n}有哪些特点？答案：又快又好又省又大"], Q("1", "short", "什么是{n}？", text="它是在{c}的一个供应商"), Q("2", "short", "{n}有哪些特点？", text="又快又好又省又大"))
case("prs_split_inline", ["1. 选{n}（）。 A. 甲 B. 乙 C. {c} 答案：C 解析：看{n}", "2. 选（）。（A）甲（B）乙 参考答案：A"], Q("1", "single", "选{n}（）。", "A:甲|B:乙|C:{c}", "C", more="看{n}"), Q("2", "single", "选（）。", "A:甲|B:乙", "A"), more=lambda: F.col("analysis"))
case("prs_judge_pair", ["1. {n}是对的（）", "A.正确B.错误", "答案：A", "2. {n}不对（）", "正确B.错误", "B"], Q("1", "judge", "{n}是对的（）", answer="A"), Q("2", "judge", "{n}不对（）", answer="B"))
case("prs_compact_answer", ["一、单选题", "1. 单位{n}是（）。答案 C；A.甲 B.乙 C.{c}", "2. 选（）。答案：BA、甲 B、{n}"], Q("1", "single", "单位{n}是（）。", "A:甲|B:乙|C:{c}", "C"), Q("2", "single", "选（）。", "A:甲|B:{n}", "B"))
case("prs_collapsed", ["9. 下列错误的是{n}（）。", "A. 甲", "B. {c}", "C. 丙丙D. 丁", "参考答案：D"], Q("9", "single", "下列错误的是{n}（）。", "A:甲|B:{c}|C:丙丙|D:丁", "D"), kind="pdf")
case(
    "prs_fragment",
    ["80、【多选】{n}包括（）部分。", "A.甲", "B.乙的", "续行{c}C.丙", "丁丁 E.戊", "答案：A,B,C,D,E"],
    Q("80", "multiple", "{n}包括（）部分。", "A:甲|B:乙的续行{c}|C:丙|D:丁丁|E:戊", "ABCDE"), kind="pdf",
)
case("prs_missing_a", ["18. 下列不适用{n}的是（）。", "甲{c}B. 乙C. 丙", "参考答案：C"], Q("18", "single", "下列不适用{n}的是（）。", "A:甲{c}|B:乙|C:丙", "C"))
case("prs_broken_number", ["191 20[单选题]选{n}（）", *AB, "A", "201 20[判断题]{n}是对的。", "B"], Q("19", "single", "选{n}（）", _AB, "A"), Q("20", "judge", "{n}是对的。", answer="B"))
case("prs_pdf_prefix", ["80（.）.{n}是对的。", "答案：对", "17120单选题选{n}（）", *AB, "B"], Q("80", "judge", "（） {n}是对的。", answer="A"), Q("17", "single", "选{n}（）", _AB, "B"), kind="pdf")
case("prs_option_line", ["1. 选{n}（）", "（A）{n}", "【B】乙", "C、丙", "D丁", "答案：D", "2. 再选（）", "A {n}", "B 乙", "答案：A"], Q("1", "single", "选{n}（）", "A:{n}|B:乙|C:丙|D:丁", "D"), Q("2", "single", "再选（）", "A:{n}|B:乙", "A"))
case("prs_add_option", ["1. 选{n}（）", ("A. {n}", {"images": ["{k}.png"]}), "续{c}", ("B. 图", {"images": ["b.png"]}), "答案：A"], Q("1", "single", "选{n}（）", "A:{n}续{c}|B:", "A", more="{k}.png;b.png"), more=lambda: F.array_join(F.flatten(F.transform("options", lambda o: o["images"])), ";"))
case("prs_unlabeled", ["一、简答题", "1. {n}有哪些内容？", "包括设备材料和{c}的记录。", "2. 列出{n}的步骤。", "①看。", "②做。"], Q("1", "short", "{n}有哪些内容？", text="包括设备材料和{c}的记录。", more="unlabelled"), Q("2", "short", "列出{n}的步骤。", text="①看。\n②做。", more="unlabelled"), more=lambda: F.col("answer_from"))
case(
    "prs_continuation",
    ["1. 为什么{n}？", "参考答案：", "1、第一{c}。", "2、第二。", "3、第三。", "2. 下一个{n}是什么？", "答案：甲，", "乙。", "3. 选{n}（）", *AB, "答案：A", "解析：因为{n}", "所以{c}。", "4. 完了{n}吗？", "答案：完了"],
    Q("1", "short", "为什么{n}？", text="1、第一{c}。\n2、第二。\n3、第三。"), Q("2", "short", "下一个{n}是什么？", text="甲，乙。"), Q("3", "single", "选{n}（）", _AB, "A", more="因为{n}所以{c}。"), Q("4", "short", "完了{n}吗？", text="完了"), more=lambda: F.col("analysis"),
)
case("prs_question_like", ["1. {n}是对的。", "答案：√", "{n}在{c}吗？", "答案：×", "下列{n}正确的是（）。", *AB, "答案：B"], Q("1", "judge", "{n}是对的。", answer="A", more="false"), Q("", "judge", "{n}在{c}吗？", answer="B", more="true"), Q("", "single", "下列{n}正确的是（）。", _AB, "B", more="true"), more=lambda: F.col("inferred_boundary"))
case("prs_fill", ["一、填空题", "1. {n}在（{c}）和【地方】之间。", "2. 编号是（　）。", "答案：{k}"], Q("1", "short", "{n}在（　）和【　】之间。", text="{c}；地方", label="填空题"), Q("2", "short", "编号是（　）。", text="{k}", label="填空题"))
case("prs_styled_fill", ["一、填空题", ("供应商的名称是{n}。", {"strong": ["{n}"]}), ("2. 在{c}的{n}。", {"strong": ["{c}", "{n}"]})], Q("1", "short", "供应商的名称是（　）。", text="{n}", label="填空题"), Q("2", "short", "在（　）的（　）。", text="{c}；{n}", label="填空题"), kind="docx")
case("prs_fill_split", ["一、填空题", "1. 分别是____、____、____。", "答案：{n}；{c}；丙", "2. 一个____。", "答案：甲；乙"], Q("1", "short", "分别是____、____、____。", text="{n}；{c}；丙", label="填空题", more="{n}+{c}+丙"), Q("2", "short", "一个____。", text="甲；乙", label="填空题"), more=lambda: F.array_join("blank_answers", "+"))
case("prs_force_section", ["一、判断题", "{n}是对的（√）", "{c}是错的（×）", "二、简答题", "{n}是什么东西 答案：一个供应商", "{c}是什么东西 答案：一个国家"], Q("1", "judge", "{n}是对的", answer="A", more="section"), Q("2", "judge", "{c}是错的", answer="B", more="section"), Q("1", "short", "{n}是什么东西", text="一个供应商", more="section"), Q("2", "short", "{c}是什么东西", text="一个国家", more="section"), kind="docx", more=lambda: F.col("boundary"))
case(
    "prs_finalize",
    ["一、多选题", "1. 选{n}（）", *AB, "答案：A", "二、单选题", "2. 再选{n}（）", *AB, "答案：AB", "三、判断题", "3. {n}（）", "A. 甲", "B. 乙", "答案：A", "4. {n}是对的。", "A. 对", "B. 错", "答案：B", "四、简答题", "5. 说明{n}。", "A. 甲", "B. 乙"],
    Q("1", "single", "选{n}（）", _AB, "A"), Q("2", "multiple", "再选{n}（）", _AB, "AB"), Q("3", "single", "{n}（）", "A:甲|B:乙", "A"), Q("4", "judge", "{n}是对的。", answer="B"), Q("5", "short", "说明{n}。", text="A. 甲\nB. 乙"),
)
_THREE = ["一、单选题（共3题）", "1. 甲{n}？", *AB, "2. 乙{n}？", *AB, "3. 丙{n}？", *AB]
case("prs_central_keys", [*_THREE, "参考答案", "1-3 ABA", "第二部分 {c}", "4. 丁{n}？", *AB, "答案：B"], Q("1", "single", "甲{n}？", _AB, "A", more="key"), Q("2", "single", "乙{n}？", _AB, "B", more="key"), Q("3", "single", "丙{n}？", _AB, "A", more="key"), Q("4", "single", "丁{n}？", _AB, "B", more="answer"), more=lambda: F.col("answer_from"))
_ITEM = lambda text, k, num="9": (text, {"num_id": num, "level": 0, "ordinal": k})
case(
    "prs_auto_appendix",
    ["一、选择题", "1. 甲{n}（）", *AB, "2. 乙{n}（）", *AB, "二、判断题", "1. {n}是对的。", "2. {c}是对的。", "三、简答题", "1. 什么是{n}？", "{c}参考答案", "选择题", _ITEM("B", 1), _ITEM("A", 2), "判断题", _ITEM("√", 1), _ITEM("×", 2), "简答题", _ITEM("一个供应商", 1), "在{c}。"],
    Q("1", "single", "甲{n}（）", _AB, "B", more="key"), Q("2", "single", "乙{n}（）", _AB, "A", more="key"), Q("1", "judge", "{n}是对的。", answer="A", more="key"), Q("2", "judge", "{c}是对的。", answer="B", more="key"), Q("1", "short", "什么是{n}？", text="一个供应商\n在{c}。", more="key"), kind="docx", more=lambda: F.col("answer_from"),
)
case("prs_key_entry", [*_THREE, "4. 什么是{n}？", "选择题答案", "1.A 2、B", "3：A", "简答题答案", "4. {c}的供应商"], Q("1", "single", "甲{n}？", _AB, "A"), Q("2", "single", "乙{n}？", _AB, "B"), Q("3", "single", "丙{n}？", _AB, "A"), Q("4", "short", "什么是{n}？", text="{c}的供应商"))
case("prs_small", ["{n}", "一、填空题", "1. {n}在＿＿＿。", "答案：{c}", "二、判断题", "（√）{n}是对的。"], Q("1", "short", "{n}在＿＿＿。", text="{c}", label="填空题"), Q("", "judge", "{n}是对的。", answer="A"), source="{n}（1）.docx")
case(
    "prs_number",
    ["阅读以下材料，回答1-2题：", "{n}在{c}。", "1/9[单选题]{n}在哪？", *AB, "答案：A", "2. 谁在{c}？", "答案：文字", "3. 还有{n}吗？", "答案：没有"],
    Q("1", "single", "{n}在哪？", _AB, "A", more="2"), Q("2", "short", "谁在{c}？", text="文字", more="2"), Q("3", "short", "还有{n}吗？", text="没有", more="0"), more=lambda: F.when(F.col("material") == "", 0).otherwise(F.size(F.split("material", "\n"))),
)
case(
    "win_material_fill",
    [("阅读材料一，回答1-2题：", {"images": ["{k}.png"]}), "{n}在{c}。", "1. 在哪里？", "答案：{c}", "2. 是谁？", "答案：{n}", "3. 还有吗？", "答案：没有", "材料二：另一段{n}", "4. 哪一段？", "答案：另一段", "一、简答题", "5. 没有材料吗？", "答案：没有"],
    Q("1", "short", "在哪里？", text="{c}", more="阅读材料一，回答1-2题：\n{n}在{c}。+{k}.png"), Q("2", "short", "是谁？", text="{n}", more="阅读材料一，回答1-2题：\n{n}在{c}。+{k}.png"), Q("3", "short", "还有吗？", text="没有", more="+"), Q("4", "short", "哪一段？", text="另一段", more="材料二：另一段{n}+"), Q("5", "short", "没有材料吗？", text="没有", more="+"),
    more=lambda: F.concat("material", F.lit("+"), F.array_join("material_images", ";")),
)
case(
    "win_split_start",
    ["1", "题 {n}的编号是（）。", *AB, "A", "2", "题", "下列{n}正确的是（）。", *AB, "B", "3", "{c} stem", *AB, "答案：A", "117", "（）"],
    Q("1", "single", "{n}的编号是（）。", _AB, "A"), Q("2", "single", "下列{n}正确的是（）。", _AB, "B"), Q("3", "single", "{c} stem", _AB, "A", more="（）"), more=lambda: F.col("analysis"),
)
case(
    "win_image_option",
    ["1. 哪个是{n}的图（）", ("", {"images": ["a{k}.png"]}), "A. 图形", ("", {"images": ["b.png"]}), "B. 图", "答案：B"],
    Q("1", "single", "哪个是{n}的图（）", "A:|B:", "B", more="+a{k}.png|b.png"), more=lambda: F.concat(F.array_join("images", ";"), F.lit("+"), F.array_join(F.transform("options", lambda o: F.array_join(o["images"], ";")), "|")),
)


# --- readings, scores and counters ----------------------------------------------------------------
_INDEXED = ["1/3[单选题]选{n}（）", *AB, "A", "2/3[判断题]{n}是对的。", "A", "3/3[简答题]什么是{n}？", "答案：文字"]


@query("prs_entry", f"SELECT s_suppkey::VARCHAR AS doc_id, unnest([1, 2, 3])::INT AS ord, unnest(['single', 'judge', 'short']) AS type, unnest([{sql_text('选{n}（）')}, {sql_text('{n}是对的。')}, {sql_text('什么是{n}？')}]) AS question, unnest(['A', 'A', '']) AS answer, unnest(['', '', '文字']) AS answer_text FROM supplier")
def prs_entry(spark, d):
    return parser.entry(paragraphs(spark, d, _INDEXED)).select("doc_id", "ord", "type", "question", F.array_join("answer", "").alias("answer"), "answer_text")


@query("prs_adaptive", "SELECT s_suppkey::VARCHAR AS doc_id, unnest(['pdf', 'docx']) AS kind, 'strict' AS profile, unnest([2, 2])::BIGINT AS questions FROM supplier")
def prs_adaptive(spark, d):
    """A PDF has two readings, of which the one that scores better counts; other files have one."""
    both = [parser.diagnostics(paragraphs(spark, d, [*_INDEXED[:5], "{c}不是题目的一行"], kind)).select("doc_id", F.lit(kind).alias("kind"), "profile", "questions") for kind in ("pdf", "docx")]
    return both[0].unionByName(both[1])


@query("prs_score", "SELECT s_suppkey::VARCHAR AS doc_id, 3::BIGINT AS strong, 3::BIGINT AS questions, 3::BIGINT AS normal, 0::BIGINT AS warning, 0::BIGINT AS error, 536.0::DOUBLE AS score FROM supplier")
def prs_score(spark, d):
    """Three good questions of three expected ones: 3 * 12 and the whole of 500."""
    return parser.diagnostics(paragraphs(spark, d, _INDEXED)).select("doc_id", "strong", "questions", "normal", "warning", "error", "score")


@query("agg_parser_diag", "SELECT s_suppkey::VARCHAR AS doc_id, 16::BIGINT AS paragraphs, 1::BIGINT AS noise, 1::BIGINT AS structure, 14::BIGINT AS assigned, 0::BIGINT AS unassigned, 1::BIGINT AS joined_numbers, 3::BIGINT AS boundaries, 3::BIGINT AS explicit, 4::BIGINT AS questions, 3::BIGINT AS content, 1::BIGINT AS placeholders, 1::BIGINT AS sections, 1::BIGINT AS duplicates, 0::BIGINT AS gaps FROM supplier")
def agg_parser_diag(spark, d):
    """Every line of a document is accounted for: assigned to a question, part of the structure, noise, or left over."""
    lines = ["一、单选题（共4题）", "1. 选{n}的是（）", *AB, "A", "- 3 -", "2", "题 下列{c}正确的是（）", *AB, "B", "3. 选{n}的是（）", *AB, "A", "解析：{c}"]
    names = ("paragraphs", "noise", "structure", "assigned", "unassigned", "joined_numbers", "boundaries", "explicit", "questions", "content", "placeholders", "sections", "duplicates", "gaps")
    return parser.diagnostics(paragraphs(spark, d, lines)).select("doc_id", *names)


@query("agg_layout_stats", "SELECT s_suppkey::VARCHAR AS doc_id, unnest(['indexed', 'labeled', 'numbered-choice', 'generic']) AS layout, unnest([3, 0, 0, 0])::BIGINT AS indexed_typed, unnest([0, 0, 2, 0])::BIGINT AS numbered, unnest([0, 2, 0, 0])::BIGINT AS labelled, unnest([2, 0, 4, 0])::BIGINT AS option_lines, unnest([3, 2, 0, 0])::BIGINT AS answer_lines FROM supplier")
def agg_layout_stats(spark, d):
    """The forms that documents' lines have, and the layout they make."""
    kinds = (_INDEXED, ["题目：什么是{n}？", "答案：文字", "题目：谁在{c}？", "答案：文字"], ["1. 选{n}（）", *AB, "2. 选{c}（）", *AB], ["{n}", "{c}"])
    found = [parser.diagnostics(paragraphs(spark, d, lines)).select("doc_id", "layout", "indexed_typed", "numbered", "labelled", "option_lines", "answer_lines") for lines in kinds]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


# --- single lines ---------------------------------------------------------------------------------
@query("flt_noise", f"WITH {v.PARAGRAPHS}, m AS (SELECT doc_id, idx, CASE idx % 5 WHEN 0 THEN '第 ' || idx || ' 页' WHEN 1 THEN '- ' || idx || ' -' WHEN 2 THEN 'Part ........ 12' WHEN 3 THEN '' ELSE text END AS line, idx % 5 AS m, text FROM p) SELECT doc_id, idx FROM m WHERE m < 4 OR trim(text, ' ') = '' OR regexp_matches(trim(text, ' '), '^[-—–] *[0-9]+ *[-—–]$') OR regexp_matches(trim(text, ' '), '^[^ ].{{0,50}}[.．·…]{{4,}} *[0-9]+$')")
def flt_noise(spark, d):
    """Page numbers, dot leaders and empty lines among the documents' own lines."""
    idx = F.col("idx")
    line = F.when(idx % 5 == 0, F.concat(F.lit("第 "), idx.cast("string"), F.lit(" 页"))).when(idx % 5 == 1, F.concat(F.lit("- "), idx.cast("string"), F.lit(" -"))).when(idx % 5 == 2, "Part ........ 12").when(idx % 5 == 3, "").otherwise(F.col("text"))

    @F.pandas_udf("boolean")
    def noise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: L.noise(L.one_line(t)))

    return v.paragraphs(spark, d).select("doc_id", "idx", line.alias("line")).filter(noise("line")).select("doc_id", "idx")


@query("flt_title", "SELECT s_suppkey, unnest(['same', 'copy', 'begins', 'study', 'style', 'question', 'other']) AS form, unnest([true, true, true, true, true, false, false]) AS title FROM supplier")
def flt_title(spark, d):
    """Lines that only repeat what their file is called, or say that it is learning material."""
    forms = {"same": "{}", "copy": "{} 题库", "begins": "{}", "study": "仪表专业学习资料（1.2-3.4）", "style": "Any heading", "question": "1. {}", "other": "Something else"}

    @F.pandas_udf("array<struct<form:string,title:boolean>>")
    def titles(names: pd.Series) -> pd.Series:
        def of(name: str) -> list[dict]:
            files = {"copy": f"{name}题库(1).docx", "begins": f"{name} extended.pdf"}
            return [{"form": form, "title": L.document_title(text.format(name), files.get(form, f"{name}.docx"), "Title" if form == "style" else "")} for form, text in forms.items()]

        return names.map(of)

    return v.table(spark, d, "supplier").select("s_suppkey", F.explode(titles("s_name")).alias("t")).select("s_suppkey", "t.form", "t.title")


_CONTEXT = "CASE WHEN idx % 7 = 0 THEN 'material ' || idx WHEN idx % 7 = 5 THEN '' END"


@query("win_material_carry", f"WITH {v.PARAGRAPHS}, m AS (SELECT doc_id, idx, {_CONTEXT} AS s, count({_CONTEXT}) OVER (PARTITION BY doc_id ORDER BY idx) AS g FROM p) SELECT doc_id, idx, nullif(max(s) OVER (PARTITION BY doc_id, g), '') AS material FROM m")
def win_material_carry(spark, d):
    """What carries on until its end, as a window over any number of lines."""
    p, idx = v.paragraphs(spark, d).select("doc_id", "idx"), F.col("idx")
    return W.carry_material(p, ["doc_id"], [F.asc("idx")], idx % 7 == 0, idx % 7 == 5, F.concat(F.lit("material "), idx.cast("string")), "material").select("doc_id", "idx", "material")
