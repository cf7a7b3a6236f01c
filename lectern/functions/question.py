"""Functions on questions: grading, status, types, labels, issue kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import one_line

#: Labels of the core types.
TYPE_LABELS = {"single": "单选题", "multiple": "多选题", "judge": "判断题", "short": "简答题", "choice_error": "单选题"}
#: Words for true and false.
TRUE_WORDS, FALSE_WORDS = ("正确", "对", "是", "√", "✓", "✔", "TRUE", "T"), ("错误", "错", "否", "×", "✕", "✖", "❌", "FALSE", "F")
#: Fixed values: (kind, pattern) of issues, the first that matches counts.
ISSUE_KINDS = (
    ("sourceOptionDuplicate", "导入片段重复|原文确实重复|原文重复|原文选项内容重复"),
    ("parserOptionDuplicate", "解析重复|解析疑似重复识别"),
    ("possibleOptionDuplicate", "疑似重复|选项内容重复|选项字母重复"),
    ("missingAnswer", "无答案|缺少答案|缺少参考答案"),
    ("answerMismatch", "答案不符|答案.+不在选项中"),
    ("optionStructure", "选项不足|选项少于|空白选项|图片选项缺少图像|图片选项待核对"),
    ("typeIssue", "多选仅一项|多选题只有一个答案|判断选项异常|判断题选项数量"),
    ("boundary", "边界|题干文字未完整识别|残留答案|粘连|题干过长|答案过长"),
    ("duplicateQuestion", "重复题|疑似与第"),
)
#: Header words of a question table's columns.
HEADER_WORDS = {
    "number": ("序号", "题号", "编号", "NO", "ID", "索引"),
    "question": ("题干", "题目", "问题", "试题", "试题内容", "题目内容", "内容"),
    "answer": ("正确答案", "标准答案", "参考答案", "答案", "答"),
    "analysis": ("解析", "答案解析", "试题解析", "错误解析", "说明", "备注"),
    "type": ("题型", "试题类型", "题目类型", "类型"),
    "difficulty": ("难度", "试题难度", "题目难度", "难易程度", "难易度"),
    "category": ("分类", "类别", "题目分类", "知识点", "章节", "科目", "专业", "模块"),
    "combined_options": ("选项", "备选项", "答案选项"),
}
#: Words of the three levels of difficulty.
DIFFICULTY_WORDS = {"简单": ("简单", "容易", "易", "初级", "基础"), "中等": ("中等", "中", "一般", "普通"), "困难": ("较难", "困难", "难", "高级")}


def same_answer(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def judge(kind: Column, answer: Column, selected: Column, self_score: Column) -> Column:
    """Whether an answer is right: objective questions by equal keys, short ones by the learner's own score."""
    return F.when(kind == "short", F.coalesce(self_score == "mastered", F.lit(False))).otherwise(same_answer(answer, selected))


def answer_status(kind: Column, correct: Column, revealed: Column, self_score: Column) -> Column:
    done = F.when(kind == "short", F.coalesce(self_score, F.lit("")) != "").otherwise(correct.isNotNull() & ~F.coalesce(revealed, F.lit(False)))
    return F.when(~done, "unanswered").when(F.coalesce(correct, F.lit(False)), "correct").otherwise("wrong")


def truth_of_line(line: Column, table: bool = False) -> Column:
    """true, false or null by a text that is one line already; tables also write Y and N."""
    clean = F.upper(line)
    yes, no = TRUE_WORDS + (("Y", "YES") if table else ()), FALSE_WORDS + (("N", "NO") if table else ())
    return F.when(clean.isin(*yes), True).when(clean.isin(*no), False)


def truth(text: Column, table: bool = False) -> Column:
    """true, false or null; tables also write Y and N."""
    return truth_of_line(one_line(F.coalesce(text, F.lit(""))), table)


def difficulty(text: Column) -> Column:
    clean = one_line(text)
    out = F.when(F.length(clean) <= 12, clean).otherwise("")
    for level, words in DIFFICULTY_WORDS.items():
        out = F.when(clean.isin(*words), level).otherwise(out)
    return out


def type_of_label(text: Column) -> tuple[Column, Column]:
    """(core type, display label) of a type's name in a document, or nulls."""
    clean = one_line(text)
    table = (("多选|多项", "multiple", "多选题"), ("判断|对错|是非", "judge", "判断题"), ("单选|单项", "single", "单选题"), ("填空", "short", "填空题"), ("画图|作图|绘图", "short", "画图题"), ("计算", "short", "计算题"))
    own = F.regexp_replace(clean, r"[\s（(].*$", "")
    kind, label = F.when(clean.rlike("简答|问答|论述|实操|主观"), "short"), F.when(clean.rlike("简答|问答|论述|实操|主观"), F.when(own == "", "简答题").otherwise(own))
    for pattern, k, shown in reversed(table):
        kind, label = F.when(clean.rlike(pattern), k).otherwise(kind), F.when(clean.rlike(pattern), shown).otherwise(label)
    return kind, label


def header_class(text: Column) -> Column:
    """Role of a column by its header: ``option:A``, ``question``, ``answer``, ... or null."""
    header = F.upper(F.regexp_replace(one_line(text), r"[\s_\-—－:：()（）【】\[\]]", ""))
    key = F.coalesce(*(F.nullif(F.regexp_extract(header, p, 1), F.lit("")) for p in (r"^(?:备选项|选项|答案选项|答案项)?([A-L])\z", r"^([A-L])(?:备选项|选项|答案项)\z")))
    out = F.lit(None).cast("string")
    for role, words in reversed(HEADER_WORDS.items()):
        out = F.when(header.isin(*words), role).otherwise(out)
    return F.coalesce(F.concat(F.lit("option:"), key), out)


def issue_kind(issue: Column) -> Column:
    return F.coalesce(*(F.when(issue.rlike(p), k) for k, p in ISSUE_KINDS), F.lit("other"))


def issue_kinds(issues: Column) -> Column:
    return F.array_distinct(F.transform(issues, issue_kind))


def confidence_bucket(x100: Column) -> Column:
    c = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(x100, F.lit(0))))
    return F.when(c < 45, "low").when(c < 75, "medium").otherwise("high")


def display_label(*choices: Column, unknown: str = "未知题型") -> Column:
    """The first label that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in choices), F.lit(unknown))


def type_label(kind: Column) -> Column:
    return reduce(lambda out, kv: F.when(kind == kv[0], kv[1]).otherwise(out), TYPE_LABELS.items(), F.lit(None).cast("string"))


def answer_display(answer_text: Column, answer: Column) -> Column:
    return F.when(answer_text != "", answer_text).otherwise(F.array_join(answer, "、"))


def order_dependent(options: Column) -> Column:
    """Whether some option speaks of the others' places ("all of the above")."""
    return F.exists(options, lambda o: o["text"].rlike("以上|以下|上述|前述|全部|均为|均是|都为|都是|全选|都正确|都错误|均正确|均错误"))


def scope_key(kind: Column, count: Column, ordered: bool = False) -> Column:
    parts = [F.coalesce(F.when(kind != "", kind), F.lit("all")), F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).cast("string")]
    return F.concat_ws("|", *([F.lit("order")] if ordered else []), *parts)


def option_state(options: Column, answer: Column, selected: Column) -> Column:
    """Each option with its state after grading: chosen and right, right, chosen and wrong, or plain."""
    def state(o: Column) -> Column:
        right, chosen = F.array_contains(answer, o["key"]), F.array_contains(selected, o["key"])
        s = F.when(right & chosen, "chosen-correct").when(right, "correct").when(chosen, "chosen-wrong").otherwise("")
        return F.struct(o["key"].alias("key"), o["text"].alias("text"), s.alias("state"))

    return F.transform(options, state)


def source_format(name: Column, kind: Column) -> Column:
    """Family of a bank's source file by its kind or its name's extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.\\/]+)\z", 1))
    kind = F.lower(F.coalesce(F.when(kind != "", kind), ext))
    #: Extensions of each family.
    families = {"word": "doc docx docm dotx dotm rtf odt", "pdf": "pdf", "excel": "xls xlsx xlsm xltx xltm ods csv tsv", "text": "txt md markdown html htm", "qbank": "qbank json"}
    out = F.lit("other")
    for family, exts in reversed(families.items()):
        out = F.when(kind.isin(*exts.split()) | ext.isin(*exts.split()), family).otherwise(out)
    return out


def name_class(name: Column) -> Column:
    n = F.length(F.coalesce(name, F.lit("")))
    return F.when(n > 19, "bank-name-compact").when(n > 18, "bank-name-medium").otherwise("bank-name-normal")


def combined_options(text: Column) -> Column:
    """Options written in one cell ("A. x B. y"): markers from the first A on, in strict sequence, part the
    texts; what follows the last of them is its text."""
    marker = r"(?i)(?:^|(?<=[\n\s；;。？！?：:]))[（(]?\s*([A-L])\s*(?:[）)]|[.、．:：])\s*"
    keys = F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(1)), F.upper)
    first = F.array_position(keys, "A").cast("int")
    own = F.when(first > 0, F.slice(keys, first, F.lit(12))).otherwise(F.slice(keys, 1, 0))
    wanted = F.transform(F.sequence(F.lit(65), F.lit(76)), lambda c: F.char(c))
    n = F.size(F.filter(own, lambda k, i: F.slice(own, F.lit(1), i + 1) == F.slice(wanted, F.lit(1), i + 1)))
    bodies = F.split(text, marker, F.greatest(first, F.lit(1)) + n)
    found = F.transform(F.slice(own, F.lit(1), n), lambda k, i: F.struct(k.alias("key"), F.trim(F.get(bodies, first + i)).alias("text")))
    return F.filter(found, lambda p: p["text"] != "")


# --- what stands for several issues ---------------------------------------------------------------
_MISSING, _MISMATCH, _SHORT = "无答案|缺少答案|缺少参考答案", "答案不符|答案.+不在选项中", "选项不足|选项少于"
_NAMED_DUPLICATE = "^(?:导入片段重复|原文确实重复|原文重复|解析重复|疑似重复|原文选项内容重复|解析疑似重复识别)"


def normalize_issues(issues: Column) -> Column:
    """Issues tidied, each once, with those that others make superfluous merged or left out.

    A named duplicate replaces the general one; a missing answer counts once and before wrong ones;
    wrong answers are one issue with all their letters; too few options and a wrong answer are one
    cause; a judgement's wrong options replace their being too few.
    """

    def without(found: Column, pattern: str) -> Column:
        return F.filter(found, lambda i: ~i.rlike(pattern))

    def several(found: Column, pattern: str) -> Column:
        return F.size(F.filter(found, lambda i: i.rlike(pattern)))

    def with_letters(found: Column, before: str, after: str, bare: str) -> Column:
        """An issue that names all letters that the issues in question name."""
        lists = F.transform(found, lambda i: F.regexp_extract_all(F.upper(F.regexp_extract(i, r"(?i)[（(]([A-L](?:[、,，/\s]+[A-L])*)[）)]", 1)), F.lit("([A-L])"), F.lit(1)))
        letters = F.array_distinct(F.flatten(lists))
        return F.when(F.size(letters) > 0, F.concat(F.lit(before), F.array_join(letters, "、"), F.lit(after))).otherwise(bare)

    tidy = F.transform(F.coalesce(issues, F.expr("cast(array() as array<string>)")), lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(i, F.lit("")), r"^\s*[•·-]\s*", ""), r"\s+", " ")))
    out = F.array_distinct(F.filter(tidy, lambda i: i != ""))
    out = F.when(several(out, _NAMED_DUPLICATE) > 0, without(out, "^选项内容重复(?:[（(]|$)")).otherwise(out)
    wrong = F.filter(out, lambda i: i.rlike(_MISMATCH))
    out = F.when(F.size(wrong) > 1, F.concat(without(out, _MISMATCH), F.array(with_letters(wrong, "答案不符（", "）", "答案不符")))).otherwise(out)
    lone = F.when(several(out, _MISSING) > 1, F.concat(without(without(out, _MISMATCH), _MISSING), F.array(F.lit("无答案")))).otherwise(without(out, _MISMATCH))
    out = F.when(several(out, _MISSING) > 0, lone).otherwise(out)
    few, wrong = several(out, _SHORT), F.filter(out, lambda i: i.rlike(_MISMATCH))
    rest = without(without(out, _SHORT), _MISMATCH)
    out = (
        F.when((few > 0) & (F.size(wrong) > 0), F.concat(rest, F.array(with_letters(wrong, "选项不足（答案 ", " 无对应选项）", "选项不足"))))
        .when(few > 1, F.concat(without(out, _SHORT), F.array(F.lit("选项不足"))))
        .otherwise(out)
    )
    return F.array_distinct(F.when(several(out, "判断选项异常|判断题选项数量") > 0, F.filter(out, lambda i: i != "选项不足")).otherwise(out))


def issue_label(issue: Column, otherwise: Column) -> Column:
    """An issue as it is if it is short, else its group's name."""
    return F.when((issue != "") & (F.length(issue) <= 11) & ~issue.rlike("[：:]"), issue).otherwise(otherwise)


def extension_label(name: Column) -> Column:
    """What a file is called by its extension, in capitals; unknown ones are files."""
    ext = F.upper(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.\\/]+)\z", 1))
    return F.when(ext == "", "文件").otherwise(ext)


def fragment_label(kind: Column) -> Column:
    """How a review names the piece of the source that a question came from."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    sheet = k.isin("xlsx", "xlsm", "xltx", "xltm", "xls", "ods", "csv", "tsv", "excel")
    shown = F.when(k == "excel", "Excel").otherwise(F.upper(k))
    return F.when(sheet, F.concat(F.lit("原始 "), shown, F.lit(" 行"))).when(k == "pdf", "原始 PDF 文本片段").when(k != "", F.concat(F.lit("原始 "), shown, F.lit(" 文本片段"))).otherwise("原始文件片段")


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that is the same for the same parts, whoever makes it."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 24))


def content_hash(content: Column) -> Column:
    """A digest of bytes or text; equal contents have one."""
    return F.sha2(content.cast("binary"), 256)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 units, as features are hashed."""
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(F.hex(F.encode(text, "UTF-16BE"))) / 4).cast("int")), lambda k: F.conv(F.substring(F.hex(F.encode(text, "UTF-16BE")), k * 4 - 3, F.lit(4)), 16, 10).cast("long"))
    units = F.when(text == "", F.expr("cast(array() as array<long>)")).otherwise(units)
    #: The offset and the prime of the 32-bit hash.
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(1 << 32)))
