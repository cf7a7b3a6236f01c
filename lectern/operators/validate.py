"""Validation of questions: issues, confidence in hundredths, status; one expression, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.question import truth_of_line
from lectern.functions.text import OPTION_MARKS, encoding_anomaly, one_line

_STRINGS = "array<string>"
#: Columns a question may lack, and what then stands for them.
DEFAULTS = {
    "images": f"cast(array() as {_STRINGS})", "answer_images": f"cast(array() as {_STRINGS})", "raw_texts": f"cast(array() as {_STRINGS})",
    "analysis": "''", "answer_text": "''", "inferred_boundary": "false", "duplicate_of": "cast(null as string)",
}


#: Words that stand for a figure where an option has no text.
FIGURE_WORDS = ("图", "图形", "图片", "图示", "示意图", "符号图", "见图", "如下图")


def figure(line: Column) -> Column:
    """Whether an option's text (as one line) only says that there is a figure."""
    return F.lower(F.regexp_replace(F.coalesce(line, F.lit("")), r"[\s()（）\[\]【】<>《》.。:：、，,;；]", "")).isin(*FIGURE_WORDS)


def _signed(line: Column) -> Column:
    """:func:`lectern.functions.text.option_signature` of a text that is one line already."""
    return F.translate(F.regexp_replace(F.lower(line), OPTION_MARKS, ""), "−–—", "---")


def read_options(options: Column) -> Column:
    """Each option with what the checks ask of its text, normalised once: key, one, sig, figure, truth, images, empty."""
    def named(**fields) -> Column:
        return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))

    lines = F.transform(options, lambda o: named(key=o["key"], one=one_line(F.coalesce(o["text"], F.lit(""))), images=F.coalesce(F.size(o["images"]), F.lit(0)), empty=F.coalesce(o["text"], F.lit("")) == ""))
    return F.transform(lines, lambda o: named(key=o["key"], one=o["one"], sig=_signed(o["one"]), figure=figure(o["one"]), truth=truth_of_line(o["one"]), images=o["images"], empty=o["empty"]))


def read_raw(raw_texts: Column) -> Column:
    """(key, n, sig) of each line that gives a text for a key: "A. text", "(A) text" or "A text"."""
    lines = F.transform(F.flatten(F.transform(raw_texts, lambda t: F.split(F.coalesce(t, F.lit("")), "\n+"))), one_line)
    form = r"(?i)\A(?:[（(]?\s*([A-L])\s*(?:[）)]|[.、．:：])\s*|([A-L])\s+)(.+)\z"
    found = F.transform(F.filter(lines, lambda t: t.rlike(form)), lambda t: F.named_struct(F.lit("key"), F.upper(F.concat(F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 2))), F.lit("body"), F.trim(F.regexp_extract(t, form, 3))))
    return F.transform(found, lambda r: F.named_struct(F.lit("key"), r["key"], F.lit("n"), F.length(r["body"]), F.lit("sig"), _signed(r["body"])))


def best_raw(raw: Column, key: Column) -> Column:
    """The signature of the longest text that the lines give for a key, of equals the first; empty if none does."""
    own = F.filter(raw, lambda r: r["key"] == key)
    most = F.array_max(F.transform(own, lambda r: r["n"]))
    return F.coalesce(F.get(F.filter(own, lambda r: r["n"] == most), F.lit(0))["sig"], F.lit(""))


def duplicate_keys(read: Column) -> Column:
    """(sig, keys) of options (of :func:`read_options`) that share a signature, in order of the first."""
    sigs = F.array_distinct(F.filter(F.transform(read, lambda o: o["sig"]), lambda s: s != ""))
    groups = F.transform(sigs, lambda g: F.named_struct(F.lit("sig"), g, F.lit("keys"), F.transform(F.filter(read, lambda o: o["sig"] == g), lambda o: o["key"])))
    return F.filter(groups, lambda g: F.size(g["keys"]) > 1)


def _duplicate_issues(read: Column, raw: Column) -> Column:
    def issue(group: Column) -> Column:
        found = F.transform(group["keys"], lambda k: best_raw(raw, k))
        apart = F.forall(found, lambda s: s != "") & (F.size(F.array_distinct(found)) > 1)
        name = F.when(apart, "解析重复").when(F.forall(found, lambda s: s == group["sig"]), "导入片段重复").otherwise("疑似重复")
        return F.concat(name, F.lit("（"), F.array_join(group["keys"], "、"), F.lit("）"))

    return F.transform(duplicate_keys(read), issue)


def validate(questions: DataFrame) -> DataFrame:
    """Adds ``issues``, ``confidence_x100`` and ``status``."""
    df = questions
    for name, default in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(default))
    none = F.expr(f"cast(array() as {_STRINGS})")
    options = F.coalesce("options", F.expr("cast(array() as array<struct<key:string,text:string,images:array<string>>>)"))
    df = df.withColumn("__o", read_options(options)).withColumn("__raw", read_raw(F.coalesce("raw_texts", none)))
    q, kind, answer, read = F.coalesce("question", F.lit("")), F.col("type"), F.coalesce("answer", none), F.col("__o")
    keys = F.transform(read, lambda o: o["key"])
    short, n = kind == "short", F.size(read)
    images = F.aggregate(read, F.size("images"), lambda a, o: a + o["images"])
    figures = (n >= 2) & F.forall(read, lambda o: o["figure"])
    invalid = F.filter(answer, lambda k: ~F.array_contains(keys, k))
    no_text = (F.regexp_replace(F.coalesce("answer_text", F.lit("")), r"\s", "") == "") & (F.size("answer_images") == 0)
    all_text = F.concat_ws(" ", q, F.array_join(F.transform(options, lambda o: o["text"]), " "), "answer_text", "analysis", F.array_join("raw_texts", " "))
    bad_judge = (n != 2) | ~F.exists(read, lambda o: F.coalesce(o["truth"], F.lit(False))) | ~F.exists(read, lambda o: F.coalesce(~o["truth"], F.lit(False)))
    answered = (F.size(answer) > 0) | (F.coalesce("answer_text", F.lit("")) != "") | (F.size("answer_images") > 0)
    #: Condition, issue, hundredths.
    rules = [
        (F.length(q) < 4, "题干缺失或过短", 45),
        (q.rlike(r"(?:答案|参考答案|解析)\s*[:：]"), "题干中仍残留答案或解析标记", 18),
        (short & no_text, "无答案", 35),
        (~short & (n < 2), "选项不足", 40),
        (~short & (F.size(answer) == 0), "无答案", 35),
        (~short & (F.size(invalid) > 0), F.concat(F.lit("答案不符（"), F.array_join(invalid, "、"), F.lit("）")), 40),
        (~short & figures & (images < n), "图片选项缺少图像", 20),
        (F.exists(read, lambda o: o["empty"] & (o["images"] <= 0)), "空白选项", 15),
        (F.size(F.array_distinct(keys)) != n, "选项字母重复", 20),
    ]
    later = [
        (F.length(q) > 1000, "题干过长", 25),
        (F.length("answer_text") > 3000, "答案过长", 20),
        (encoding_anomaly(all_text), "字符映射异常", 22),
        ((kind == "multiple") & (F.size(answer) < 2), "多选仅一项", 15),
        ((kind == "judge") & bad_judge, "判断选项异常", 15),
        (F.col("inferred_boundary") & answered, "边界待查", 5),
        (F.col("inferred_boundary") & ~answered, "边界待查且无答案", 8),
        (F.coalesce(F.col("duplicate_of").cast("string"), F.lit("")) != "", "重复题", 18),
    ]

    def named(rows):
        return F.array_compact(F.array(*(F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m, _ in rows)))

    def points(rows):
        return sum((F.when(c, p).otherwise(0) for c, _, p in rows), F.lit(0))

    df = df.withColumn("__dup", F.when(figures, none).otherwise(_duplicate_issues(read, F.col("__raw"))))
    duplicate = F.when(F.exists("__dup", lambda i: i.startswith("解析重复") | i.startswith("疑似重复")), 18).when(F.size("__dup") > 0, 8).otherwise(0)
    df = df.withColumn("issues", F.array_distinct(F.concat(named(rules), F.col("__dup"), named(later))))
    df = df.withColumn("confidence_x100", F.greatest(F.lit(0), 100 - points(rules) - duplicate - points(later)).cast("int"))
    fatal = (~short & (n < 2)) | (F.col("confidence_x100") < 45)
    df = df.withColumn("status", F.when(fatal, "error").when(F.size("issues") > 0, "warning").otherwise("normal"))
    return df.select(*questions.columns, "issues", "confidence_x100", "status") if not {"issues", "status", "confidence_x100"} & set(questions.columns) else df.drop("__dup", "__o", "__raw")
