"""What one line of a question document says: types, numbers, headings, options, answers.

Plain functions on strings, used by the parser inside its grouped map; :mod:`lectern.functions.text`
builds its Column expressions from the same tables (:data:`LABELS`, :data:`SPACING`).
"""

from __future__ import annotations

import re
import unicodedata

# --- tidy text ------------------------------------------------------------------------------------
#: White space, with the ideographic and no-break spaces and the byte-order mark.
WS = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Labels of answers and analyses, and the words that documents write for them, longest first.
LABELS = {
    "参考答案": ("参考答案", "参考答", "参考"),
    "解析": ("答案解析", "试题解析", "解析", "说明"),
    "答案": ("正确答案", "标准答案", "答案", "答"),
}
#: Marks and words of truth, as answers.
TRUE_MARKS, FALSE_MARKS = ("√", "✓", "✔", "☑", "正确", "对", "是", "TRUE", "T"), ("×", "✕", "✖", "☒", "❌", "错误", "错", "否", "FALSE", "F")
_KEY = "[A-L]"
#: answer keys: one, or several with or without a mark between them
KEYS = rf"{_KEY}(?:\s*[,，、/\\|\s]?\s*{_KEY})*"
_S = f"{WS}*"
_MARK = "|".join(sorted((*TRUE_MARKS[:7], *FALSE_MARKS[:8]), key=len, reverse=True))
#: (pattern, replacement) in order: bracketed labels become plain, an answer in brackets follows its label
BRACKETED = (
    *((rf"[【\[［(（]{_S}(?:{'|'.join(words)}){_S}[】\]］)）]{_S}[:：]?", f"{name}：") for name, words in LABELS.items()),
    (rf"(?i)(参考答案|正确答案|标准答案|答案|答){_S}[（(【\[［]{_S}({_KEY}(?:{_S}(?:[,，、/\\|]|{WS}){_S}{_KEY})*|√|✓|×|✕|✖|正确|错误|对|错|是|否){_S}[）)】\]］]", r"\1：\2"),
)
_LETTERS = {"参考答案": f"{_S.join('参考答案')}{_S}(?:为|是)?", "解析": f"(?:{_S.join('答案')}{_S})?{_S.join('解析')}", "答案": f"(?<!参)(?<!参考)(?:正确|标准|试题)?{_S}{_S.join('答案')}{_S}(?:为|是)?"}
#: labels written with spaces between their characters; more than one colon after a label is one
SPELLED = (*((rf"{pattern}{_S}[:：]", f"{name}：") for name, pattern in _LETTERS.items()), (rf"(答案|解析)：{_S}[:：]+", r"\1："))
#: white space: runs are one space, line ends stand alone, none before closing marks or after opening ones
SPACING = (
    ("[ \\t\\f\\x0B]+", " "),
    (" *\n[ \n]*", "\n"),
    (rf"{WS}+([，。；：！？、])", r"\1"),
    ("([（(【\\[])[ \\t]+", r"\1"),
    ("[ \\t]+([）)】\\]])", r"\1"),
)
_WIDE = {c: c - 65248 for r in (range(0xFF21, 0xFF3B), range(0xFF41, 0xFF5B), range(0xFF10, 0xFF1A)) for c in r}
_DROPPED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD])


def half_width(text: str) -> str:
    return text.translate(_WIDE)


#: How UTF-8 shows when it was read as a single-byte code.
MOJIBAKE = "(?:Ã.|Â.|â€|ä¸|å[\x80-\xbf]|æ[\x80-\xbf]|ç[\x80-\xbf]|ï¿½)"
_GARBLED = re.compile(MOJIBAKE)
#: What a reading costs for each character that no text has; other characters of a text count one.
_COSTS = ((re.compile("�"), 80), (re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]"), 30), (re.compile("[-]"), 20), (_GARBLED, 16))
_USED = re.compile("[㐀-鿿豈-﫿A-Za-z0-9，。；：！？、,.!?;:'\"“”‘’（）()【】\\[\\]＋+\\-—_/\\\\]")
_ONE_BYTE = re.compile("(?:[\x00-\xff]|[" + "".join(c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))) + "])+")


def readability(text: str) -> int:
    return len(_USED.findall(text)) - sum(cost * len(p.findall(text)) for p, cost in _COSTS)


def repair_mojibake(text: str) -> str:
    """Runs of characters that are one byte each in code page 1252, decoded as UTF-8 where that reads better."""

    def decoded(m: re.Match) -> str:
        run = m[0]
        try:
            new = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in run).decode("utf-8") if _GARBLED.search(run) else run
        except UnicodeDecodeError:
            return run
        return new if readability(new) > readability(run) + 4 else run

    return _ONE_BYTE.sub(decoded, text) if _GARBLED.search(text) else text


#: Optional rules (sentence, what it should read): known sentences that a converter destroys.  Empty unless a caller fills it.
KNOWN_SENTENCES: list[tuple[re.Pattern, str]] = []


def known_sentence(text: str, rules=None) -> str:
    """Text with known destroyed sentences written out, where they still carry marks of the damage."""
    for pattern, to in KNOWN_SENTENCES if rules is None else rules:
        text = pattern.sub(lambda m, to=to: to if len(re.findall("[�ö±²³煾]", m[0])) >= 4 else m[0], text)
    return text


_TIDY = [(re.compile(p), to) for p, to in (*BRACKETED, *SPELLED, *SPACING)]
_PLAIN = re.compile(r"[\x21-\x27\x2a-\x5a\x5e-\x7e]+(?: [\x21-\x27\x2a-\x5a\x5e-\x7e]+)*")  # no brackets


def tidy(text: str | None) -> str:
    """Half-width letters and figures, plain labels, no invisible characters, tidy spacing; lines stay."""
    if not text:
        return ""
    if _PLAIN.fullmatch(text):
        return text
    text = half_width(known_sentence(repair_mojibake(text)))
    for k, (pattern, to) in enumerate(_TIDY):
        if k == len(BRACKETED):
            text = text.translate(_DROPPED).replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n")
        text = pattern.sub(to, text)
    return re.sub(rf"\A{WS}+|{WS}+\Z", "", text)


def one_line(text: str | None) -> str:
    return re.sub(rf"{WS}{{2,}}", " ", re.sub("\n+", " ", tidy(text))).strip()


_COMPACT = re.compile(rf"{WS}|[，。；：！？、,.!?;:'\"“”‘’（）()【】\[\]［］_\-]")


def compact(text: str | None) -> str:
    return _COMPACT.sub("", one_line(text)).lower()


_LIST = re.compile(r"(?:\d{1,3}[.、．)）]|[（(]\d{1,3}[）)]|[①-⑩]|[一二三四五六七八九十]+[、.．]|[-—•·])")
_RUNS_ON = re.compile("和|及|与|并|且|或|以及|同时|其中|即|是|为|的|、|，|。|；")


def list_item(text: str) -> bool:
    return bool(_LIST.match(text))


def joined(parts: list[str], mode: str = "question") -> str:
    """Lines as one text: a question's run on, an answer's are a point each, an analysis keeps its lists."""
    lines = [one for part in parts for line in tidy(part).split("\n") if (one := one_line(line))]
    out = lines[:1]
    for before, line in zip(lines, lines[1:], strict=False):
        item = mode != "question" and list_item(line)
        if mode == "answer":
            gap = "\n" if item or not (before.endswith(("，", ",", "：", ":")) or _RUNS_ON.match(line)) else ""
        else:
            gap = "\n" if item else " " if re.search("[A-Za-z0-9%℃°)]$", before) and re.match("[A-Za-z0-9(]", line) else ""
        out += [gap, line]
    return re.sub("\n(?=[，。；！？、）)】\\]])", "", tidy("".join(out))).strip()


_HEADS = {"question": "(?:题目|题干|问题)", "answer": "(?:参考答案|答案|答)", "analysis": "(?:答案解析|试题解析|解析|说明)"}


def cleaned(parts: list[str], mode: str) -> str:
    return re.sub(rf"^{_HEADS[mode]}\s*[:：]\s*", "", joined(parts, mode)).strip()


# --- types ----------------------------------------------------------------------------------------
#: Fixed values: (pattern of a type's name, core type, label), the first that matches counts.
TYPES = (
    ("不定项(?:选择题|题)?", "multiple", "不定项选择题"), ("多(?:项选择题|选题|选)", "multiple", "多选题"), ("判断题?|对错题", "judge", "判断题"), ("匹配题|配对题", "short", "匹配题"), ("排序题|顺序题", "short", "排序题"),
    ("案例题", "short", "案例题"), ("材料题", "short", "材料题"), ("填空题", "short", "填空题"), ("计算题", "short", "计算题"), ("画图题|绘图题|作图题", "short", "画图题"), ("实操题", "short", "实操题"), ("论述题", "short", "论述题"),
    ("问答题", "short", "问答题"), ("简答题", "short", "简答题"), ("单(?:项选择题|选题|选)|选择题", "single", "单选题"),
)
TYPE = "|".join(f"(?:{p})" for p, _, _ in TYPES)
#: Labels of the core types.
CORE_LABELS = {"single": "单选题", "multiple": "多选题", "judge": "判断题", "short": "简答题"}


def type_of(label: str | None) -> tuple[str, str]:
    return next(((t, shown) for p, t, shown in TYPES if re.fullmatch(p, label or "")), ("", ""))


_LEADING_TYPE = re.compile(rf"^[（(\[【]?\s*({TYPE})\s*[）)\]】]?\s*[:：-]?\s*")


def peel_type(text: str) -> tuple[str, str, str]:
    """(core type, label, rest) of a text that begins with a type's name; else empty names and the text."""
    m = _LEADING_TYPE.match(text)
    bracketed = m and (m[0].strip()[:1] in "（([【" or m[0].strip()[-1:] in ":：-" or m.end() == len(text))
    return (*type_of(m[1]), text[m.end() :]) if m and (bracketed or m[1].endswith("题")) else ("", "", text)


# --- what an answer says --------------------------------------------------------------------------
_ANSWER_LABEL = rf"(?:正确答案|标准答案|参考答案|答案|答)\s*(?:为|是)?\s*[:：]?\s*"
_TRUE, _FALSE = ("|".join(sorted(words, key=len, reverse=True)) for words in (TRUE_MARKS, FALSE_MARKS))


def _bare(value: str) -> str:
    """An answer without its label, outer brackets and closing marks, in capitals."""
    out, before = re.sub(rf"^{_ANSWER_LABEL}", "", one_line(value)).upper(), None
    while out != before:
        before = out
        out = re.sub(r"[，,。；;\s]+$", "", out)
        out = re.sub(r"^[（(【\[]\s*([^（(【\[）)】\]]*)[）)】\]]$", r"\1", out).strip()
    return out


def truth_of(value: str) -> bool | None:
    """The truth value that a word or mark stands for, or none."""
    clean = _bare(value)
    return True if clean in TRUE_MARKS else False if clean in FALSE_MARKS else None


def is_truth(value: str) -> bool:
    """Whether an answer is one of a judgement: a word or mark of truth, alone or explaining A or B."""
    clean = _bare(value)
    return truth_of(clean) is not None or bool(re.fullmatch(r"(?:A\s*[（(【\[]?\s*(?:正确|对)|B\s*[（(【\[]?\s*(?:错误|错))\s*[）)】\]]?", clean))


def letters(value: str) -> list[str]:
    """Keys that an answer names; truth marks stand for A and B."""
    clean = _bare(value)
    for words, key in ((_TRUE, "A"), (_FALSE, "B")):
        if re.match(rf"(?:{words})(?=$|[，。；;（(])", clean):
            return [key]
    if m := re.match(rf"({KEYS})(?=\s*(?:$|[；;，,。（(【\[]))", clean):
        return list(dict.fromkeys(re.findall(_KEY, m[1])))
    if m := re.match(rf"({_KEY})\s*[.．、:：)）]\s*\S", clean):  # the key with its option's text
        return [m[1]]
    m = re.search(rf"[（(【\[]\s*({KEYS})\s*[）)】\]]", clean)
    return list(dict.fromkeys(re.findall(_KEY, m[1]))) if m else []


_ANSWER_ALONE = re.compile(rf"^(?:答案\s*[:：]?\s*)?[（(【\[]?\s*(?:{KEYS}|{_MARK})\s*[）)】\]]?\s*[,，。；;]?$", re.I)


def answer_alone(text: str) -> bool:
    return bool(_ANSWER_ALONE.match(text))


# --- what a question looks like -------------------------------------------------------------------
BLANK = re.compile(r"[（(【\[]\s*[）)】\]]|_{2,}|＿{2,}")
#: How questions open, and words that ask for a text.
_OPENINGS = "下列|以下|关于|根据|在|当|为了|某|用|一个|一台|串行|金属|仪表|控制|应急|进入|高处|放射|动火"
_ASKING = "是什么|有哪些|有何|如何|为什么|哪几|哪一|多少|几种|怎样|怎么|应做哪些|应做好哪些|应符合哪些|起什么作用"


def has_blank(text: str) -> bool:
    return bool(re.search(r"[（(]\s*[）)]|_{2,}|＿{2,}", text))


def asks(text: str) -> bool:
    """A strong cue of a question: a question mark at its end, a blank in brackets, an opening."""
    return bool(re.search(r"[？?]$|[（(]\s*[）)]", text) or re.match(rf"(?:题目|题干|问题)\s*[:：]|(?:{_OPENINGS}|什么|如何|为什么|简述|说明)", text))


def asks_for_text(text: str) -> bool:
    """Whether a question wants a written answer."""
    if not text or re.search(r"[（(]\s*[）)]", text):
        return False
    if re.search("简答题?|问答题|实操题|论述题|填空题|计算题|画图题|绘图题|作图题", text) or re.match(r"(?:简述|写出|列出|阐述|分析|解释|回答|说明)(?!\s*[:：]?\s*(?:正确|错误))", text):
        return True
    return bool(re.search(_ASKING, text) and re.search(r"[？?]\s*$|^(?:题目|题干|问题)\s*[:：]", text))


def question_like(text: str, hint: str = "", listed: bool = False) -> bool:
    """Whether an unnumbered line may be a question of its own."""
    if len(text) < 5 or option_line(text) or re.match(r"(?:答案|参考答案|解析|答|说明)\s*[:：]|因为|由于|所以|因此|其中|即|本题|该题|故|解析可知", text):
        return False
    return bool(re.search(r"[？?]$|[（(]\s*[）)]", text) or re.match(_OPENINGS, text) or hint == "judge" or listed or hint and len(text) >= 10)


_OPTION = re.compile(rf"^[（(【\[]?\s*({_KEY})\s*(?:[）)】\]]\s*[.、．:：]?|[.、．:：])\s*(.*)$", re.I)
_LOOSE = re.compile(rf"^({_KEY})\s{{1,3}}([^A-L].+)$", re.I)


def option_line(text: str) -> tuple[str, str] | None:
    """(key, body) of a line that is written like an option."""
    m = _OPTION.match(text) or _LOOSE.match(text)
    return (m[1].upper(), m[2].strip()) if m else None


_FIGURE_WORDS = ("图", "图形", "图片", "图示", "示意图", "符号图", "见图", "如下图")


def figure_only(text: str) -> bool:
    return re.sub(r"[\s()（）\[\]【】<>《》.。:：、，,;；]", "", one_line(text)).lower() in _FIGURE_WORDS


# --- starts of questions --------------------------------------------------------------------------
#: (name, pattern): the forms a question's start has, tried in order.  n is its number, t its type, c its text.
STARTS = tuple(
    (name, re.compile(pattern, re.I))
    for name, pattern in (
        ("number and type", rf"^[,，]?\s*(?P<n>\d+)\s*/\s*\d+\s*[\[【]?\s*(?P<t>{TYPE})\s*[\]】]?\s*(?P<c>.*)$"),
        ("glued number", rf"^[,，]?\s*(?P<n>\d{{1,4}}?)1(?P<total>\d{{1,3}})\s*[\[【]?\s*(?P<t>{TYPE})\s*[\]】]?\s*(?P<c>.*)$"),
        ("broken number", rf"^[,，]?\s*(?P<n>\d{{1,4}})\s+(?P<total>\d{{1,4}})\s*[\[【]?\s*(?P<t>{TYPE})\s*[\]】]?\s*(?P<c>.*)$"),
        ("count", r"^[,，]?\s*(?P<n>\d+)\s*/\s*\d+\s*[\[【]?\s*题\s*[\]】]?\s*(?P<c>.*)$"),
        ("number before 题", r"^(?P<n>\d{1,4})\s*[\[【]?\s*题(?![目干])\s*[\]】]?\s*(?:[.、．:：)）-]\s*)?(?P<c>.*)$"),
        ("number and type", rf"^[,，]?\s*(?P<n>\d+)\s*[\[【]?\s*(?P<t>{TYPE})\s*[\]】]?\s*(?P<c>.*)$"),
        ("type", rf"^[（(\[【]\s*(?P<t>{TYPE})\s*[）)\]】]\s*(?P<c>.+)$"),
        ("type", rf"^(?P<t>{TYPE})\s*[:：]\s*(?P<c>.*)$"),
        ("label", r"^(?:题目|题干|问题)\s*[:：]\s*(?P<c>.+)$"),
        ("number", r"^(?:Q|题)\s*(?P<n>\d{1,5})\s*[.、．:：)）-]\s*(?P<c>.*)$"),
        ("number", r"^第\s*(?P<n>\d{1,5})\s*题\s*[.、．:：)）-]?\s*(?P<c>.*)$"),
        ("number", r"^(?P<n>\d{1,5})(?:\s*/\s*\d+)?\s*[.、．:：)）]\s*(?P<c>.*)$"),
    )
)
_BARE_NUMBER = re.compile(r"^(?P<n>\d{1,4})\s*(?P<c>[A-Z]{0,6}[一-鿿].{4,})$")


def broken_number(number: str, total: str) -> str:
    """"201 20" was "20/20": a slash that became a 1."""
    cut = number[:-1]
    return cut if int(number) > int(total) and number.endswith("1") and cut and 1 <= int(cut) <= int(total) else number


def pdf_prefix(text: str) -> str:
    """"80（.）." was "80.（ ）": the mark of the number slipped into the brackets."""
    m = re.match(r"^(\d{1,5})\s*[（(]\s*[.．]\s*[）)]\s*[.．、:：]?\s*(.*)$", text)
    return f"{m[1]}. （）{' ' + m[2] if m[2] else ''}" if m else text


def start_of(text: str, pdf: bool = False, bare: bool = False) -> dict | None:
    """name, number, core type, label and content of a line that starts a question; ``bare`` allows a number without a mark."""
    text = pdf_prefix(text) if pdf else text
    for name, pattern in STARTS:
        m = pattern.match(text)
        if not m:
            continue
        g = {"n": "", "t": None, "total": None} | m.groupdict()
        number = g["n"] or ""
        if name == "glued number" and not (pdf and 1 <= int(number) <= int(g["total"]) <= 500):
            continue
        if name == "broken number":
            number = broken_number(number, g["total"])
        hint, label, content = (*type_of(g["t"]), g["c"]) if g["t"] else peel_type(g["c"] or "")
        return {"name": name, "number": number, "hint": hint, "label": label, "content": content}
    if bare and (m := _BARE_NUMBER.match(text)):
        hint, label, content = peel_type(m["c"])
        return {"name": "bare number", "number": m["n"], "hint": hint, "label": label, "content": content}
    return None


def strongly_numbered(text: str) -> bool:
    """Whether a line starts a question whatever stands around it: by number with type, type or label."""
    found = start_of(text)
    return found is not None and found["name"] in ("number and type", "broken number", "count", "type", "label")


def plain_number(text: str) -> int:
    """The number that a line begins with as a question's, or 0."""
    found = start_of(text)
    if found and found["number"]:
        return int(found["number"])
    m = re.match(r"^(?:第\s*)?(\d{1,4})\s*题?\s*-|^(\d{1,4})\s*[（(\[【]", text)
    return int(m[1] or m[2]) if m else 0


# --- headings -------------------------------------------------------------------------------------
_ORDINAL = re.compile(r"^(?:#{1,6}\s*)?(?:[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[）)])?\s*")
#: Levels of a trade's examinations, and how names of subjects end.
LEVELS = ("初级工", "中级工", "高级工", "技师", "高级技师")
_SUBJECT = re.compile("^(?!.*[。？?！!])[^：:]{2,28}(?:知识|控制阀|安全环保|管理|基础|专业|法规|标准|实操)$")
_SECTION = re.compile(r"^[一二三四五六七八九十]+[、.．]\s*\S|^[（(][一二三四五六七八九十]+[）)]\s*\S|^第[一二三四五六七八九十\d]+(?:部分|章|节)")
_TYPE_HEADING = re.compile(rf"^(?:图片)?\s*[（(\[【]?\s*({TYPE})\s*[）)\]】]?\s*(?:[（(](.*)[）)])?$")


def type_heading(text: str) -> tuple[str, str, int] | None:
    """(core type, label, declared number of questions or 0) of a line that only names a type."""
    bare = _ORDINAL.sub("", text)
    if re.match(r"^(?:简答题|问答题)\s*[/／、和及\s]+\s*(?:简答题|问答题)(?:\s*[（(].*[）)])?$", bare):
        return "short", "简答题", 0
    m = _TYPE_HEADING.match(bare)
    if not m:
        return None
    core, label = type_of(m[1])
    if m[1] == "选择题" and re.search("多选|多项", m[2] or ""):
        core, label = "multiple", "多选题"
    count = re.fullmatch(r"共\s*(\d+)\s*题", (m[2] or "").strip())
    return core, label, int(count[1]) if count and m[1].endswith("题") and 1 <= int(count[1]) <= 5000 else 0


def heading(text: str, style: str = "") -> tuple[str, str, str] | None:
    """(kind, value, label) with kind ``type``, ``level`` or ``category``."""
    if not text:
        return None
    if found := type_heading(text):
        return "type", found[0], found[1]
    if m := re.match(r"^#{1,6}\s*(.+)$", text):
        named = re.search(f"{TYPE}", m[1])
        return ("type", *type_of(named[0])) if named and named[0].endswith("题") else ("category", m[1].strip(), "")
    if option_line(text) or re.search(r"[；;,，]\s*[A-L]\s*[.、．:：)）]", text, re.I) or start_of(text) or re.match(r"(?:正确答案|标准答案|参考答案|答案解析|试题解析|答案|答|解析|说明)\s*(?:为|是)?\s*[:：]", text):
        return None
    if text in LEVELS:
        return "level", text, ""
    named, styled = bool(style), bool(re.search("heading|标题|title", style or "", re.I))
    if named and len(text) <= 30 and not re.search(r"[。？?！!：:（）()]", text) and not re.fullmatch(r"\d+|[A-L]", text):
        return "category", re.sub(r"\d+$", "", text).strip() or text, ""
    if _SUBJECT.match(text):
        return "category", text, ""
    if _SECTION.match(text) or styled and len(text) <= 40 and not asks(text):
        return "category", _ORDINAL.sub("", text), ""
    return None


def title_key(text: str) -> str:
    """What a document's title and its file's name have in common."""
    text = re.sub(r"\.(?:docx?|docm|dotx|dotm|xlsx?|xlsm|xltx|xltm|pdf|rtf|odt|ods|csv|tsv|txt|md|markdown|html?)$", "", one_line(text), flags=re.I)
    text = re.sub(r"(?:[（(]\s*\d+\s*[）)])+$", "", text)
    return re.sub(r"[\s　·•_—–\-，,。．.：:；;]+", "", text).lower()


_STUDY = re.compile(r"^[㐀-鿿A-Za-z0-9]*(?:学习内容|学习资料|培训内容|培训资料|复习资料|知识汇总)(?:[（(]\s*[\d.月/]+\s*[-—–~～至]\s*[\d.月/]+\s*[）)])?$")


def document_title(text: str, source: str = "", style: str = "") -> bool:
    """Whether a line only repeats what the document is called."""
    if not 2 <= len(text) <= 100 or start_of(text) or option_line(text) or re.search(r"[（(]\s*[）)]|[？?]$", text) or re.match(r"(?:题目|题干|问题|正确答案|标准答案|参考答案|答案|答|解析|说明)\s*[:：]", text):
        return False
    own, name = title_key(text), title_key(source)
    if own and name and (own.startswith(name) or name.startswith(own)):
        return True
    return bool(_STUDY.match(text) or re.search("title|标题", style or "", re.I) and len(text) <= 60)


_NOISE = re.compile(r"^第\s*\d+\s*页(?:\s*(?:初级工|中级工|高级工))?$|^[-—–]\s*\d+\s*[-—–]$|^\S.{0,50}[.．·…]{4,}\s*\d+$|^后接[㐀-鿿]{2,6}$")


def noise(text: str, repeats: int = 0) -> bool:
    """Page numbers, dot leaders of a table of contents, empty lines."""
    return not text or bool(_NOISE.match(text)) or repeats >= 3 and bool(re.match(r"第\s*\d+\s*页|[-—–]\s*\d+\s*[-—–]", text))


# --- a line in pieces -----------------------------------------------------------------------------
_LABELLED = re.compile(r"(?P<reference>(?:参考答案|参考答|参考)\s*[:：])|(?P<analysis>(?:答案解析|试题解析|解析|说明)\s*[:：])|(?P<answer>(?:正确答案|标准答案|答案|答)\s*(?:为|是)?\s*[:：])")
_CLEAR = re.compile(rf"(?:^|(?<=[\s；;。？！?：:)）】\]]))(?:[（(【\[]\s*({_KEY})\s*[）)】\]]|({_KEY})\s*[.、．:：)）])\s*")
_TIGHT = re.compile(rf"({_KEY})\s*[.、．:：)）]\s*", re.I)
_SPACED = re.compile(rf"(?:^|(?<=[\s；;。！？?：:（()）]))({_KEY})(?![A-Za-z0-9_]*[.、．:：)）])\s*(?=[㐀-鿿A-Za-z0-9（(\-+√✓✔×✕✖])")


def option_marks(text: str) -> list[tuple[str, int, int]]:
    """(key, start, end) of the marks that part a line into options.

    Marks in a clear place always count.  Others, glued to the text before or without punctuation,
    count only as a chain without gaps from A: of three with A in a clear place, else of four; and if A
    has lost its mark, the text before B is A where B, C and D follow.
    """
    clear = [((m[1] or m[2]).upper(), m.start(), m.end()) for m in _CLEAR.finditer(text)]
    places = {start: (key, start, end, 2) for key, start, end in clear}
    near = {start + d for _, start, _ in clear for d in (-1, 0, 1)}
    for pattern, weight in ((_TIGHT, 1), (_SPACED, 0)):
        for m in pattern.finditer(text):
            if m.start(1) not in near and m.end() < len(text):
                free = not m.start(1) or text[m.start(1) - 1] in " \n；;。！？?：:）)"
                places.setdefault(m.start(1), (m[1].upper(), m.start(1), m.end(), weight if not free else weight + 3))
    found = sorted(places.values(), key=lambda p: p[1])

    def chain(first: str) -> list[tuple]:
        out, wanted = [], ord(first)
        start = next((k for k, p in enumerate(found) if p[0] == first), len(found))
        for p in found[start:]:
            if ord(p[0]) == wanted:
                out.append(p)
                wanted += 1
            elif ord(p[0]) > wanted:
                break
        return out

    def bodies(marks: list[tuple]) -> bool:
        return all(text[a[2] : b].strip() for a, b in zip(marks, [*(m[1] for m in marks[1:]), len(text)], strict=True))

    own = chain("A")
    glued = [p for p in own if p[3] < 2]
    triple = len(own) == 3 and own[0][3] == 2 and all(p[3] in (1, 2, 4) for p in own[1:])
    if len(own) >= 3 and bodies(own) and (not glued or len(own) >= 4 or triple):
        return [p[:3] for p in own]
    rest = chain("B")
    if len(own) < 3 and len(rest) >= 3 and text[: rest[0][1]].strip() and bodies(rest):
        return [("A", 0, 0), *(p[:3] for p in rest)]
    return clear


def judge_pair(text: str) -> list[tuple[str, str]] | None:
    """The two options of a judgement written in one: "A.正确B.错误", or without the A."""
    clean = re.sub(r"^选项\s*[:：]\s*|[,，。；;\s]+$", "", one_line(text))
    m = re.match(r"^(?:A\s*[.、．:：)）]?\s*)?(正确|对|是|错误|错|否)\s*B\s*[.、．:：)）]?\s*(正确|对|是|错误|错|否)$", clean, re.I)
    if not m or truth_of(m[1]) == truth_of(m[2]):
        return None
    return [("A", "正确" if truth_of(m[1]) else "错误"), ("B", "正确" if truth_of(m[2]) else "错误")]


def _options_in(text: str) -> list[tuple[str, str]]:
    marks = option_marks(text)
    return [(k, text[b:end].strip()) for (k, _, b), end in zip(marks, [*(m[1] for m in marks[1:]), len(text)], strict=True)]


def answer_before_options(text: str) -> list[tuple[str, str, str]] | None:
    """Pieces of "question 答案 C；A.x B.y", where the answer stands before its options."""
    label = re.search(r"(?:正确答案|标准答案|参考答案|答案(?!解析)|答)\s*(?:为|是)?\s*[:：]?\s*", text)
    m = re.match(r"^([A-L]{1,8})\s*[；;，,、\s]*A\s*(?:[.、．:：)）]\s*|\s+)(.+)$", text[label.end() :], re.I | re.S) if label else None
    found = _options_in("A. " + m[2].strip()) if m else []
    if len(found) < 2 or found[0][0] != "A" or not all(body for _, body in found):
        return None
    head = text[: label.start()].strip()
    return [*([("text", "", head)] if head else []), ("answer", "", m[1].upper()), *(("option", k, body) for k, body in found)]


def pieces(text: str) -> list[tuple[str, str, str]]:
    """(kind, key, value) of a line's parts: text, option, answer, reference, analysis."""
    text = re.sub(r"选项\s*[:：]", " ", tidy(text)).strip()
    if found := answer_before_options(text):
        return found
    if pair := judge_pair(text):
        return [("option", key, value) for key, value in pair]
    labels = [(m.lastgroup, "", m.start(), m.end()) for m in _LABELLED.finditer(text)]
    end = labels[0][2] if labels else len(text)
    marks = [("option", key, a, b) for key, a, b in option_marks(text[:end])] + labels
    if not marks:
        return [("text", "", text)]
    out = [("text", "", text[: marks[0][2]].strip())]
    out += [(kind, key, text[b:after].strip()) for (kind, key, _, b), after in zip(marks, [*(m[2] for m in marks[1:]), len(text)], strict=True)]
    return [p for p in out if p[2] or p[0] != "text"]


_CANDIDATE = rf"(?:{KEYS}|{_MARK}|TRUE|FALSE)"
_IN_BRACKETS = re.compile(rf"[（(【\[]\s*(?:正确答案|标准答案|参考答案|答案|答)\s*[:：]?\s*({_CANDIDATE})\s*[）)】\]]", re.I)
_AT_END = re.compile(rf"(?:参考答案|参考答|正确答案|标准答案|参考|答案)\s*(?:为|是)?\s*[:：]?\s*({_CANDIDATE})\s*$", re.I)
_FIRST = re.compile(rf"^[（(【\[]\s*({_CANDIDATE})\s*[）)】\]]\s*(.+)$", re.I)
_LAST = re.compile(rf"^(.{{4,}}?)\s*[（(【\[]\s*({_CANDIDATE})\s*[）)】\]]\s*[。.]?\s*$", re.I)


def inline_answer(text: str, implicit: bool) -> tuple[str, list[str], bool]:
    """(text, keys, whether they are of a judgement) with answers that stand in the text taken out of it: labelled
    ones, and if ``implicit`` those in brackets at its beginning or end."""
    clean, values = one_line(text), []
    if found := [m[1] for m in _IN_BRACKETS.finditer(clean)]:
        values, clean = values + found, _IN_BRACKETS.sub(" ", clean).strip()
    if m := _AT_END.search(clean):
        values, clean = [*values, m[1]], clean[: m.start()].strip()
    if implicit:
        if m := _FIRST.match(clean):
            values, clean = [*values, m[1]], m[2].strip()
        if m := _LAST.match(clean):
            values, clean = [*values, m[2]], m[1].strip()
    keys = list(dict.fromkeys(k for v in values for k in letters(v)))
    return re.sub(r"\s+", " ", clean) if values else text, keys, any(truth_of(v) is not None for v in values)


def inline_text_answer(text: str, hint: str = "") -> tuple[str, str]:
    """(question, answer) of "question? answer" in one text, where the question wants a text; else the answer is empty."""
    m = re.match(r"^(.{4,}?[？?])\s*(.+)$", text, re.S)
    answer = re.sub(rf"^{_ANSWER_LABEL}", "", m[2]).strip() if m else ""
    if len(answer) < 8 or re.match(r"(?:第?\d+题|题目|题干|问题)\s*[:：]", answer):
        return text, ""
    cue = re.search("什么|哪些|如何|为什么|简述|写出|列出|说明|原因|措施|步骤|内容|要求|规定|方法|特点|作用|注意事项|有何|定义|组成|分类|区别|关系|含义", m[1])
    return (m[1].strip(), answer) if hint == "short" or cue else (text, "")


_OPEN, _SHUT = "（(【[", "）)】]"


def filled_blanks(text: str) -> tuple[str, list[str]]:
    """The text with its outermost bracketed words taken out as answers of a cloze; blanks and truth marks stay."""
    out, answers, depth, start = [], [], 0, 0
    at = 0
    for k, c in enumerate(text):
        if c in _OPEN:
            start, depth = (k, 1) if not depth else (start, depth + 1)
        elif c in _SHUT and depth:
            depth -= 1
            word = text[start + 1 : k].strip()
            if not depth and _SHUT[_OPEN.index(text[start])] == c and word and not re.fullmatch(r"[_＿—\-\s]+|√|✓|×|✕|✖|正确|错误|对|错", word):
                out += [text[at:start], text[start], "　" if text[start] in "（【" else " ", c]
                answers.append(word)
                at = k + 1
    return ("".join(out) + text[at:], answers) if answers else (text, [])


def styled_blanks(text: str, marked: list[str]) -> tuple[str, list[str]]:
    """The text with words that stand out by their style taken out as answers of a cloze."""
    answers = []
    for word in dict.fromkeys(w for m in marked if (w := one_line(m)) and len(w) <= 200):
        if word in text:
            text = text.replace(word, "（　）", 1)
            answers.append(word)
    return text, answers


def split_blanks(answer: str, blanks: int) -> list[str]:
    """One answer for each of several blanks, if the text parts into that many."""
    parts = [p.strip() for p in re.split(r"；|;|、|\||/|，(?=[^，]{1,40}(?:，|$))", answer) if p.strip()]
    return parts if blanks > 1 and len(parts) == blanks else []


# --- keys at a document's end ---------------------------------------------------------------------
_RANGE = re.compile(rf"^(\d{{1,4}})\s*[-—–~～至到]\s*(\d{{1,4}})\s*[:：]?\s*((?:(?:{_KEY}|[TF√✓✔☑×✕✖☒❌对错])[\s,，、;；]*)+)$", re.I)
_PAIR = re.compile(rf"(\d{{1,4}})\s*[.、．:：)）-]?\s*({_MARK}|{_KEY}(?:\s*[,，、/\\|]?\s*{_KEY})*)(?![A-Za-z一-鿿])", re.I)
_TEXT_ENTRY = re.compile(r"^(?:第\s*)?(\d{1,4})\s*题?\s*[.、．:：)）-]\s*(.+)$")


def key_entries(text: str) -> list[tuple[int, str]]:
    """(number, answer) of a line of answers: "1-3 ACB", "1.A 2.B 3.对", or "1. a text"."""
    if m := _RANGE.match(text):
        values = re.findall(rf"{_KEY}|[TF√✓✔☑×✕✖☒❌对错]", m[3], re.I)
        if len(values) == int(m[2]) - int(m[1]) + 1:
            return [(int(m[1]) + k, v) for k, v in enumerate(values)]
    pairs = [(int(m[1]), m[2]) for m in _PAIR.finditer(text)]
    left = re.sub(r"[\s,，、;；。.]+", "", _PAIR.sub("", text))
    if pairs and (not left or len(pairs) > 1):
        return pairs
    m = _TEXT_ENTRY.match(text)
    return [(int(m[1]), m[2].strip())] if m else pairs


def objective(value: str) -> bool:
    """Whether an entry of a key names options or a truth value."""
    return bool(re.fullmatch(rf"{KEYS}|{_MARK}|[TF]", value.strip(), re.I))


_KEY_HEADS = ("选择题", "单选题", "多选题", "不定项选择题", "判断题", "填空题", "简答题", "问答题", "计算题", "匹配题", "配对题", "排序题", "顺序题")


def key_heading(text: str) -> tuple[str, str] | None:
    """(``named`` or ``general``, label of the type) of a line that opens a table of answers."""
    clean = re.sub(r"\s*[:：]$", "", text)
    if m := re.fullmatch(rf"({'|'.join(_KEY_HEADS)})\s*(?:参考)?答案", clean):
        return "named", m[1] if m[1] == "选择题" else type_of(m[1])[1]
    if clean in ("答案汇总", "答案表", "参考答案汇总"):
        return "named", ""
    return ("general", "") if clean in ("参考答案", "标准答案", "正确答案", "答案") else None


def appendix_label(text: str) -> str:
    """The type that a heading inside an appendix of answers names, or an empty text."""
    clean = re.sub(r"^[一二三四五六七八九十]+[、.．]\s*|\s*[:：]$", "", text)
    return "选择题" if clean in ("选择题", "单选题", "单项选择题") else type_of(clean)[1] if clean in ("多选题", "多项选择题", "不定项选择题", "判断题", "对错题", "填空题", "简答题", "问答题", "计算题") else ""


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)
