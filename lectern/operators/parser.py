"""Paragraphs to questions: a grouped-map fold per document.

A document's lines go through passes, each a function from lines to lines: tables of answers at the end
are set aside (:func:`answer_keys`), reading material is noted at the questions it belongs to
(:func:`materials`), numbers that stand alone join their questions (:func:`joined_starts`), noise goes
(:func:`without_noise`), pictures join the options they show (:func:`image_options`).  A
:class:`Reader` then takes the lines in order; the first of its rules (:data:`Reader.RULES`) that takes a
line decides what it is.  Drafts become rows (:func:`settled`), sections that declare more questions than they
have get placeholders (:func:`with_missing`), answers from the tables go to the questions they
number (:func:`apply_keys`).  A PDF's text is read with strict and with relaxed boundaries, and the reading that
scores better counts (:func:`adapted`).

A document's lines meet in one task, as reading in order needs; documents are independent.
Validation follows as column expressions on the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.operators.options import collapsed, from_raw_lines, graded
from lectern.operators.validate import validate

PDF, WORD = "pdf", ("doc", "docx", "docm", "dotx", "dotm", "rtf", "odt")


@dataclass
class Line:
    index: int
    text: str
    images: list[str] = field(default_factory=list)
    strong: list[str] = field(default_factory=list)
    style: str = ""
    num_id: str = ""
    level: int | None = None
    ordinal: int = 0
    #: indexes of all paragraphs that this line stands for
    at: list[int] = field(default_factory=list)
    material: str = ""
    material_images: list[str] = field(default_factory=list)
    is_material: bool = False
    one: str = ""

    def __post_init__(self):
        self.text, self.at = L.tidy(self.text), self.at or [self.index]
        self.one = L.one_line(self.text)

    @property
    def listed(self) -> bool:
        return bool(self.num_id) and self.num_id != "0" and not self.level

    def with_text(self, text: str, *others: Line) -> Line:
        """This line with another text, standing for ``others`` too."""
        return replace(self, text=text, images=_unique(i for p in (self, *others) for i in p.images), at=_unique(a for p in (self, *others) for a in p.at))


def _unique(values) -> list:
    return list(dict.fromkeys(values))


# --- passes ---------------------------------------------------------------------------------------
@dataclass
class Key:
    number: int
    value: str
    label: str = ""
    #: from an appendix of list items, whose numbers count the questions of a type
    by_place: bool = False


def _appendix(lines: list[Line]) -> tuple[int, list[Key]] | None:
    """(line, entries) of an appendix whose answers are list items under headings of types.

    It takes a heading such as "... 参考答案" before at least two type headings and four list items within 23 lines.
    """
    for k, p in enumerate(lines):
        if not re.match(r"^.{1,24}(?:参考答案|答案汇总|答案表)\s*[:：]?$", p.one) or L.key_heading(p.one):
            continue
        near = lines[k + 1 : k + 24]
        labels = [bool(L.appendix_label(q.one)) for q in near]
        if sum(labels) >= 2 and sum(q.ordinal > 0 and 0 < len(q.one) <= 120 and not label for q, label in zip(near, labels, strict=True)) >= 4:
            break
    else:
        return None
    entries, label, top = [], "", ""
    for p in lines[k + 1 :]:
        if found := L.appendix_label(p.one):
            label, top = found, ""
        elif label in ("简答题", "计算题"):  # one list of answers, whose points may be lists of their own
            top = top or (p.num_id if p.ordinal else "")
            if p.ordinal and p.num_id == top:
                entries.append(Key(p.ordinal, p.one, label, True))
            elif p.one and entries and entries[-1].label == label:
                entries[-1].value += "\n" + p.one
        elif label and p.ordinal:
            entries.append(Key(p.ordinal, p.one, label, True))
    return k, entries


def _evidence(lines: list[Line], general: bool) -> bool:
    """Whether what follows a heading of answers is a table of answers and not one question's answer."""
    rows, numbers = 0, set()
    for p in lines[:13]:
        if not p.one or L.type_heading(p.one):
            continue
        found = L.key_entries(p.one)
        if not general:
            if found:
                return True
            continue
        if L.key_heading(p.one) or re.match(r"(?:题目|题干|问题)\s*[:：]", p.one) or not found and len(p.one) > 12:
            return False
        if found:
            if not all(L.objective(v) for _, v in found):
                return False
            rows, numbers = rows + 1, numbers | {n for n, _ in found}
            if len(found) > 1 or rows >= 3 and len(numbers) >= 3:
                return True
    return False


def answer_keys(lines: list[Line]) -> tuple[list[Line], list[Key], bool]:
    """(lines without the tables of answers, their entries, whether one is an appendix of list items)."""
    appendix = _appendix(lines)
    kept, entries, label, active = [], [], "", False
    end = appendix[0] if appendix else len(lines)
    for k, p in enumerate(lines[:end]):
        head = L.key_heading(p.one)
        if head and (not active or head[0] == "named") and _evidence(lines[k + 1 : end], head[0] == "general"):
            active, label = True, head[1]
        elif not active:
            kept.append(p)
        elif typed := L.type_heading(p.one):
            label = typed[1]
        elif found := L.key_entries(p.one):
            entries += [Key(n, v, label) for n, v in found]
        elif re.match(r"^第[一二三四五六七八九十\d]+(?:部分|章|节)|^[一二三四五六七八九十]+[、.．]", p.one):
            active = False
            kept.append(p)
        else:
            kept.append(p)
    return kept, entries + (appendix[1] if appendix else []), appendix is not None


_MATERIAL = re.compile(r"^(?:材料|案例|背景资料)\s*(?:[一二三四五六七八九十\d]*\s*[:：]|[一二三四五六七八九十\d]+\s*$)")
_INSTRUCTION = re.compile(r"^(?:阅读材料|阅读以下材料|根据以下材料|根据材料)(?:\s*[一二三四五六七八九十\d]+)?\s*(?:[:：，。]|$)|^(?:阅读|根据).{0,20}(?:材料|案例).{0,20}(?:回答|完成|作答)")
_MATERIAL_RANGE = re.compile(r"(?:回答|完成|作答)第?\s*(\d{1,4})\s*[-—–~～至到]\s*(\d{1,4})\s*题")


def materials(lines: list[Line]) -> list[Line]:
    """Notes reading material at the lines it holds for: up to its range's end, a heading, or the next material."""
    out, text, images, collecting, last = [], "", [], False, 0
    for p in lines:
        number = L.plain_number(p.one)
        titled = re.fullmatch(r"材料|案例|背景资料", p.one) and re.search("heading|标题|title", p.style, re.I)
        if not number and (_MATERIAL.match(p.one) or _INSTRUCTION.match(p.one) or titled):
            text, images, collecting = re.sub(r"^(?:材料|案例|背景资料)\s*[:：]\s*", "", p.one).strip(), list(p.images), True
            span = _MATERIAL_RANGE.search(p.one)
            last = int(span[2]) if span else 0
            out.append(replace(p, is_material=True))
            continue
        if not collecting and (L.type_heading(p.one) or re.match(r"^第[一二三四五六七八九十\d]+(?:部分|章|节)|^[一二三四五六七八九十]+[、.．]\s*\D", p.one)):
            text, images, last = "", [], 0
        elif number:
            if last and number > last:
                text, images, last = "", [], 0
            collecting = False
        elif collecting and p.one:
            text, images = "\n".join(x for x in (text, p.one) if x), images + p.images
            out.append(replace(p, is_material=True))
            continue
        out.append(replace(p, material=text, material_images=_unique(images)) if text or images else p)
    return out


_ALONE = re.compile(r"^(\d{1,4})\s*[.、．:：)）-]?$")
_BARE_LABEL = re.compile(r"^(?:正确答案|标准答案|参考答案|答案|答)\s*(?:为|是)?\s*[:：]$")
_OPTION_OR_ANSWER = re.compile(r"^(?:[A-L]\s*[.、．:：)）]|[（(]?[A-L][）)]|(?:正确答案|标准答案|参考答案|答案|答)\s*(?:为|是)?\s*[:：])", re.I)


def _body_of_number(number: str, lines: list[Line]) -> int:
    """How many of the lines after a lone number are its question: 0 if none is.

    A line that opens like a question is; any other needs a cue of a question, or that options or an
    answer follow within three lines.
    """
    if not lines:
        return 0
    first = lines[0].one
    skip = 1 if first == "题" and len(lines) > 1 else 0
    body, after = lines[skip].one, lines[skip + 1 : skip + 4]
    if L.noise(body) or _ALONE.match(body) or re.match(r"^题\s*共?\s*\d+$", body):
        return 0
    if not skip and (re.match(rf"^(?:题目|题干|问题)\s*[:：]?|^题\s*\S|^[（(\[【]?\s*(?:{L.TYPE})", body) and not L.type_heading(body)):
        return 1
    if int(number) > 99 and not skip:
        return 0
    followed = any(_OPTION_OR_ANSWER.match(p.one) for p in after)
    new = L.start_of(body) or L.option_line(body) or _OPTION_OR_ANSWER.match(body) or L.heading(body, lines[skip].style) or L.BLANK.fullmatch(body)
    return skip + 1 if followed and not new and (L.asks(body) or len(body) >= 2) else 0


def joined_starts(lines: list[Line]) -> tuple[list[Line], int]:
    """Lone numbers joined with the next one or two lines where those are a question; and how many were."""
    out, k, repaired = [], 0, 0
    while k < len(lines):
        m = None if out and _BARE_LABEL.match(out[-1].one) else _ALONE.match(lines[k].one)  # after a label it is the answer
        n = _body_of_number(m[1], lines[k + 1 : k + 7]) if m else 0
        if n:
            others = lines[k + 1 : k + 1 + n]
            out.append(lines[k].with_text(f"{m[1]}. {re.sub('^题 *(?![目干])', '', others[-1].text)}", *others))
            repaired += 1
        else:
            out.append(lines[k])
        k += 1 + n
    return out, repaired


def without_noise(lines: list[Line]) -> tuple[list[Line], list[int]]:
    """Lines but for page numbers, dot leaders and empty ones; and the paragraphs that went."""
    repeats: dict[str, int] = {}
    keys = [L.compact(p.text) for p in lines]
    for key in keys:
        if key and len(key) <= 80:
            repeats[key] = repeats.get(key, 0) + 1
    kept = [p for p, key in zip(lines, keys, strict=True) if (not key and p.images) or not L.noise(p.one, repeats.get(key, 0))]
    there = {id(p) for p in kept}
    return kept, [a for p in lines if id(p) not in there for a in p.at]


_FIGURE_OPTION = re.compile(r"^[（(]?\s*[A-L]\s*(?:[）)]|[.、．:：]|\s+)?\s*(?:图|图形|图片|图示|示意图|符号图|见图|如下图)\s*$", re.I)


def image_options(lines: list[Line]) -> tuple[list[Line], int]:
    """A line of pictures only joins the option after it that says "figure"; and how many did."""
    out: list[Line] = []
    joined = 0
    for p in lines:
        if out and not out[-1].one and out[-1].images and _FIGURE_OPTION.match(p.one):
            before = out.pop()
            p = p.with_text(p.text, before)
            joined += 1
        out.append(p)
    return out, joined


# --- the fold -------------------------------------------------------------------------------------
@dataclass
class Draft:
    number: str = ""
    level: str = ""
    category: str = ""
    chapter: str = ""
    hint: str = ""
    label: str = ""
    #: how its start was found, and where its answer came from
    boundary: str = ""
    answer_from: list[str] = field(default_factory=list)
    stem: list[str] = field(default_factory=list)
    options: list[list] = field(default_factory=list)  # [key, parts, images]
    answer: list[str] = field(default_factory=list)
    prose: list[str] = field(default_factory=list)
    analysis: list[str] = field(default_factory=list)
    images: list[str] = field(default_factory=list)
    answer_images: list[str] = field(default_factory=list)
    analysis_images: list[str] = field(default_factory=list)
    material: str = ""
    material_images: list[str] = field(default_factory=list)
    difficulty: str = ""
    knowledge: str = ""
    raw: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    truth: bool = False
    guessed: bool = False

    def complete(self) -> bool:
        return bool(self.answer or self.prose)

    def empty(self) -> bool:
        return not (self.stem or self.options or self.complete() or self.analysis)

    def question(self) -> str:
        return L.cleaned(self.stem, "question")

    def add_option(self, key: str, text: str, images: list[str]) -> None:
        own = next((o for o in self.options if o[0] == key), None)
        if own is None:
            self.options.append([key, [text] if text else [], list(images)])
        else:
            own[1] += [text] if text else []
            own[2] += images

    def next_key(self) -> str:
        return chr(ord(self.options[-1][0]) + 1) if self.options else "A"


class Reader:
    """Builds the drafts of one document from its lines."""

    def __init__(self, source: str = "", kind: str = "", relaxed: bool = False, appendix: bool = False):
        self.source, self.kind, self.relaxed, self.appendix = source, kind, relaxed, appendix
        self.done: list[Draft] = []
        self.now: Draft | None = None
        self.mode, self.awaited, self.waiting = "question", "", None
        self.level = self.category = self.chapter = self.hint = self.label = ""
        #: (first draft, label, core type, declared number, heading) of sections that declare how many questions they have
        self.sections: list[tuple[int, str, str, int, str]] = []
        self.in_section = 0
        self.counts: dict[str, int] = {}
        self.noise: list[int] = []
        self.structure: list[int] = []
        self.left: list[Line] = []

    def count(self, what: str) -> None:
        self.counts[what] = self.counts.get(what, 0) + 1

    # drafts -----------------------------------------------------------------------------------------
    def close(self) -> None:
        if self.now is not None:
            self.done.append(self.now)
        self.now, self.mode, self.awaited = None, "question", ""

    def open(self, number: str, boundary: str, hint: str = "", label: str = "") -> Draft:
        self.close()
        self.now = Draft(number, self.level, self.category, self.chapter, hint or self.hint, label or self.label, boundary, guessed=boundary == "guessed")
        self.count("boundaries")
        self.count("guessed" if boundary == "guessed" else "explicit")
        if self.waiting is not None:
            value, self.waiting = self.waiting, None
            self.now.answer_from.append("before the question")
            if L.is_truth(value):
                self.now.hint, self.now.truth = "judge", True
            if keys := L.letters(value):
                self.now.answer = keys
            else:
                self.now.hint, self.now.prose = "short", [L.cleaned([value], "answer")]
        return self.now

    def touch(self, p: Line, images: str = "question") -> None:
        """Notes a line, its pictures and its material at the draft."""
        q = self.now
        q.at += [a for a in p.at if a not in q.at]
        if p.text and (not q.raw or q.raw[-1] != p.text):
            q.raw.append(p.text)
        q.material = q.material or p.material
        q.material_images += p.material_images
        {"question": q.images, "answer": q.answer_images, "analysis": q.analysis_images}.get(images, []).extend(p.images)

    def _styled(self, key: str, text: str, p: Line) -> None:
        """An option that stands out by colour or highlight is an answer."""
        plain = [re.sub(r"^[A-L]\s*[.、．:：)）]\s*", "", L.one_line(s)) for s in p.strong]
        if text and key not in self.now.answer and any(s and (s in text or text in s) for s in plain):
            self.now.answer.append(key)
            self.now.answer_from.append("style")

    def take(self, kind: str, key: str, value: str, p: Line) -> None:
        """One piece of a line goes where it belongs."""
        if kind == "text" and not value:
            return
        if self.now is None:
            self.open("", "guessed")
        q = self.now
        place = {"option": "", "analysis": "analysis", "answer": "answer", "reference": "answer"}.get(kind) if kind != "text" else {"analysis": "analysis", "reference": "answer", "answer": "answer"}.get(self.mode, "question")
        self.touch(p, place)
        if kind == "option":
            self.mode = "option"
            q.add_option(key, value, p.images)
            self._styled(key, value, p)
        elif kind in ("answer", "reference"):
            self._answer(value, kind)
        elif kind == "analysis":
            self.mode = "analysis"
            q.analysis += [value] if value else []
        elif self.mode == "option" and q.options:
            q.options[-1][1].append(value)
        elif self.mode == "answer":
            if keys := L.letters(value):
                q.answer += keys
            elif q.hint == "short" or not q.options:
                q.prose.append(value)
            else:
                self.mode = "analysis"
                q.analysis.append(value)
        elif self.mode == "reference":
            q.prose.append(value)
        elif self.mode == "analysis":
            q.analysis.append(value)
        else:
            q.stem.append(value)

    def _answer(self, value: str, kind: str = "answer") -> None:
        """What follows a label of an answer: keys, a truth value, prose, or an explanation of a choice."""
        q = self.now
        self.awaited = "" if value else kind  # a label alone: its text is on the next line
        wants_text = q.hint == "short" or kind == "reference" and not q.options and L.asks_for_text(q.question())
        keys = L.letters(value)
        self.mode = "answer"
        if not value:
            self.mode = "reference" if wants_text or not q.options else "answer"
        elif L.is_truth(value):
            q.hint, q.truth, q.answer = "judge", True, q.answer + keys
        elif keys and (q.options or not wants_text) and (q.options or len(value) <= 24):
            q.answer += keys
        elif q.options and q.hint != "short" and not (kind == "reference" and L.asks_for_text(q.question())):
            self.mode = "analysis"
            q.analysis.append(value)
        else:
            self.mode, q.hint = "reference", "short"
            q.prose.append(value)
        if value:
            q.answer_from.append(kind)

    def content(self, text: str, p: Line, implicit: bool = True) -> None:
        """The text of a question, with the answer that may stand in it."""
        q = self.now
        compact = L.answer_before_options(text) is not None
        clean, keys, truth = L.inline_answer(text, implicit and self.label != "填空题" and q.label != "填空题") if not compact else (text, [], False)
        if keys:
            q.answer += keys
            q.truth |= truth
            q.answer_from.append("inline")
            self.count("inline_answers")
        if compact:
            self.count("compact_choices")
        for piece in L.pieces(clean):
            self.take(*piece, p)

    # rules: each takes a line and says what it was, or leaves it to the next ------------------------
    def _material(self, p: Line) -> str:
        if p.is_material:
            self.structure += p.at
            return "material"
        return ""

    def _empty(self, p: Line) -> str:
        if not p.text and not p.images:
            self.noise += p.at
            return "noise"
        return ""

    def _awaited(self, p: Line) -> str:
        """The text of a label that stood alone on the line before."""
        if not (self.now and self.awaited and p.one):
            return ""
        follows = self.now.options and (L.option_line(p.one) or [0])[0] == self.now.next_key()
        if follows or L.strongly_numbered(p.one) or L.type_heading(p.one) or L._LABELLED.match(p.one):
            self.awaited = ""
            return ""
        found = L.start_of(p.one)
        following = found and self.now.number and found["number"] and int(found["number"]) == int(self.now.number) + 1
        if following and (self.now.options or int(self.now.number) > 1 or L.asks(found["content"])):
            self.awaited = ""
            return ""
        self.touch(p, "answer")
        self._answer(p.text, self.awaited)
        return "answer"

    def _page(self, p: Line) -> str:
        """A lone number inside an answer that has begun is a page's."""
        if self.now and self.mode in ("reference", "answer", "analysis") and re.fullmatch(r"\d{1,4}", p.one):
            self.noise += p.at
            return "noise"
        return ""

    def _meta(self, p: Line) -> str:
        m = re.match(r"^(知识点|考点|分类|章节|难度)\s*[:：]\s*(.+)$", p.one)
        if not m:
            return ""
        name, value, q = m[1], m[2].strip(), self.now
        if q is None:
            self.structure += p.at
            if name == "章节":
                self.chapter = value
            elif name != "难度":
                self.category = value
        else:
            self.touch(p, "")
            if name == "难度":
                q.difficulty = value
            elif name == "章节":
                q.chapter = value
            elif name == "分类":
                q.category = value
            else:
                q.knowledge, q.category = value, q.category or value
        return "meta"

    def _labelled(self, p: Line) -> str:
        if m := re.match(r"^(?:正确答案|标准答案|参考答案|答案|答)\s*(?:为|是)?\s*[:：]\s*(.*)$", p.one):
            if self.now is None:  # the answer of the next question
                self.waiting = m[1] or None
                self.structure += p.at
                return "answer"
        if self.now is not None and re.match(r"^(?:选项|正确答案|标准答案|参考答案|答案|答|答案解析|试题解析|解析|说明)\s*(?:为|是)?\s*[:：]", p.one):
            found = L.pieces(p.text)
            for piece in found:
                self.take(*piece, p)
            return found[0][0]
        return ""

    def _forced(self, p: Line) -> bool:
        """Whether a line of a typed section is a question by its form alone."""
        if L.heading(p.one, p.style):
            return False
        if self.label == "填空题":
            filled = L.filled_blanks(p.one)[1]
            if self.kind in WORD:
                before = self.now.question() if self.now else ""
                waits = self.now and not self.now.complete() and L.has_blank(before) and not L.filled_blanks(before)[1]
                return not (waits and not filled and not L.asks(p.one))
            return bool(filled) and (bool(re.search("[。！？?；;]$", p.one)) or len(filled) > 1 or self.now is None)
        if self.hint in ("single", "multiple") and L.answer_before_options(p.one):
            return True
        if self.hint == "judge" and re.search(r"[（(【\[]\s*(?:√|✓|×|✕|✖|正确|错误|对|错)\s*[）)】\]]\s*[,，。；;]?$", p.one):
            return True
        return self.hint == "short" and bool(re.search(r"(?:正确答案|标准答案|参考答案|答案|答)\s*(?:为|是)?\s*[:：]", p.one)) and not L.start_of(p.one)

    def _section_row(self, p: Line) -> str:
        if not self._forced(p) or L.start_of(p.one):
            return ""
        self.in_section += 1
        self.open(str(self.in_section), "section")
        self.touch(p)
        if not self._blanks(p.text, p):
            self.content(p.text, p)
        return "start"

    def _blanks(self, text: str, p: Line) -> bool:
        """A cloze whose answers stand out by their style."""
        q = self.now
        stem, found = L.styled_blanks(text, p.strong) if q.label == "填空题" or self.label == "填空题" else (text, [])
        if found:
            q.hint, q.label = "short", "填空题"
            q.stem.append(stem)
            q.prose.append("；".join(found))
            q.answer_from.append("style")
            self.count("styled_blanks")
        return bool(found)

    def _continues(self, p: Line) -> str:
        q = self.now
        if q is None or self.mode not in ("reference", "answer", "analysis") or self._next_option(p) or not p.one:
            return ""
        head = L.heading(p.one, p.style)
        if not self._goes_on(p, head) or self.kind == PDF and head:
            return ""
        self.take("text", "", p.text, p)
        return "text"

    def _goes_on(self, p: Line, head) -> bool:
        """Whether a line goes on with the answer or analysis before it."""
        q, text, answering = self.now, p.one, self.mode in ("reference", "answer")
        stem = q.question()
        wants_text = q.hint == "short" or L.asks_for_text(stem) or "reference" in q.answer_from
        if answering and wants_text and re.match(r"[A-L]\s*[.、．:：)）]", text):
            return True
        if L.strongly_numbered(text) or head and (head[0] != "category" or p.style or L._SUBJECT.match(text)):
            return False
        following = q.number.isdigit()
        bare = L._BARE_NUMBER.match(text)
        if bare and q.complete() and following and int(bare["n"]) == int(q.number) + 1 and (re.search(r"[：:？?]$|[（(]\s*[）)]", bare["c"]) or L.asks(bare["c"]) or re.match("更换|安装|检查|校验", bare["c"])):
            return False
        found = L.start_of(text)
        if found and found["number"]:
            n = int(found["number"])
            if answering and (q.hint == "short" or not q.options):
                points = [int(x) for part in q.prose for x in re.findall(r"(?:^|[；;。！？!?\n])\s*(\d{1,3})\s*[.、．)）](?!\d)", part)]
                last = points[-1] if points else 0
                fresh = re.match(r"(?:题目|题干|问题)\s*[:：]", found["content"]) or re.search(r"[？?]|[（(]\s*[）)]", found["content"]) or found["hint"]
                if n == last + 1 and not fresh:
                    return True
            if L.asks(found["content"]) or following and n == int(q.number) + 1:
                return False
        nouns = "说明书|规格表|一览表|接线表|布置图|安装图|配管图|流程图|示意图|记录表|清单|台账|规程|设备|材料|文件|记录|措施|步骤|方法|内容|要求|规定|系统|装置|工具|仪器|仪表|等"
        if answering and q.hint == "short" and stem and len(text) <= 60 and re.search(f"(?:{nouns})$", text) and not re.search(r"[？?]|[（(]\s*[）)]|什么|哪些|如何|为什么|是否|能否|下列|以下|简述", text):
            return True
        if self.mode == "answer" and q.hint != "short" and not re.search("(?:什么|简述|说明|哪些|如何|为什么|规定|要求|步骤|内容)[？?]?$", stem):
            return False
        if re.match("因为|由于|其中|即|所以|因此|说明|注意|另外|同时|并且|且|或", text):
            return True
        if L.list_item(text):
            return not L.asks(text)
        previous = (q.analysis if self.mode == "analysis" else q.prose)[-1:]
        if previous and previous[0].endswith(("，", ",", "；", ";", "：", ":")):
            return True
        if self.mode == "analysis":
            return not (q.hint == "judge" and len(text) >= 5) and not L.asks(text)
        return (q.hint == "short" or not q.options) and not L.asks(text)

    def _title(self, p: Line) -> str:
        if not L.document_title(p.one, self.source, p.style):
            return ""
        self.structure += p.at
        self.count("titles")
        if self.now and not self.now.empty():
            self.close()
        return "title"

    def _heading(self, p: Line) -> str:
        head = L.heading(p.one, p.style)
        if not head:
            return ""
        self.structure += p.at
        if self.now and (self.now.stem or self.now.options or self.now.prose):
            self.close()
        kind, value, label = head
        if kind == "type":
            self.in_section, self.hint, self.label = 0, value, label
            self.sections.append((len(self.done), label, value, L.type_heading(p.one)[2] if L.type_heading(p.one) else 0, p.one))
        else:
            self.sections.append((len(self.done), "", "", 0, ""))
            if kind == "level":
                self.level, self.hint, self.label = value, "", ""
            else:
                self.category = self.chapter = value
                if re.match(r"^[一二三四五六七八九十]+[、.．]\s*\S|^第[一二三四五六七八九十\d]+(?:部分|章|节)", p.one):
                    self.hint = self.label = ""  # a new part; its subsections keep the type
        return "heading"

    def _listed_option(self, p: Line) -> str:
        """A list item after a question that has no answer yet is the option of its place."""
        q = self.now
        if not (q and not q.complete() and p.num_id and p.num_id != "0" and 1 <= p.ordinal <= 8 and q.stem and q.hint != "short" and not L.asks(p.one)) or self.mode not in ("question", "option") or L.option_line(p.one):
            return ""
        if chr(64 + p.ordinal) != q.next_key():
            return ""
        for piece in L.pieces(f"{q.next_key()}. {p.text}"):
            self.take(*piece, p)
        return "option"

    def _start(self, p: Line) -> str:
        q = self.now
        found = L.start_of(p.one, self.kind == PDF, bare=bool(self.hint or q and q.hint or q and q.complete()))
        if found is None and p.listed and not L.option_line(p.one) and p.one:
            found = {"name": "list", "number": str(p.ordinal or ""), **dict(zip(("hint", "label", "content"), L.peel_type(p.one), strict=True))}
        if found is None:
            return ""
        number, name = found["number"], found["name"]
        if name == "bare number" and q is not None:
            following = q.number.isdigit() and int(number) == int(q.number) + 1
            blank_start = q.empty() and q.boundary in ("number and type", "broken number", "glued number")
            if not following and (blank_start or not q.complete() or q.number.isdigit()) or self.kind == PDF and not self.relaxed and not q.complete():
                return ""
        if name == "bare number" and q is None and not self.hint:
            return ""
        if self.kind == PDF and q is not None and not q.complete() and re.match(r"^[+-]?\d+\.\d+\s*[A-Za-zµμΩ℃°%]", p.one):
            return ""  # a measure, not a number and a mark
        if found["hint"]:
            self.hint, self.label = found["hint"], found["label"]
        more = q is not None and name == "label" and (q.empty() or self.kind == PDF and not q.options and not q.complete() and re.fullmatch(r"[（(]?补充[）)]?|附加|追加", q.question()))
        if not more:
            q = self.open(number, name, found["hint"], found["label"])
            if name == "bare number":
                self.count("bare_numbers")
        elif found["hint"]:
            q.hint, q.label = found["hint"], found["label"]
        self.touch(p)
        if not self._blanks(found["content"], p):
            self.content(found["content"], p)
        return "start"

    def _lost_a(self, p: Line) -> str:
        """Options whose first has lost its mark: "x B. y C. z"."""
        q = self.now
        if not q or q.options or not q.stem or q.hint in ("short", "judge") or L.option_line(p.one) or not re.search(r"B\s*[.、．:：)）].*C\s*[.、．:：)）]", p.one, re.I) or not self._chooses():
            return ""
        found = [x for x in L.pieces(f"A. {p.one}") if x[0] == "option"]
        if len(found) < 3 or "".join(x[1] for x in found) != "ABCDEFGHIJKL"[: len(found)] or not all(x[2] for x in found):
            return ""
        for piece in found:
            self.take(*piece, p)
        self.count("compact_choices")
        return "option"

    def _chooses(self) -> bool:
        stem = self.now.question()
        return self.now.hint in ("single", "multiple") or L.has_blank(stem) or bool(re.match("下列|以下|关于|根据|在|当|选择|哪|何种", stem))

    def _fragment(self, p: Line) -> str:
        """A line that ends the last option and goes on with the next, or whose first option has lost its mark."""
        q = self.now
        if not q or self.mode != "option" or len(q.options) < 2 or q.hint in ("short", "judge") or not self._chooses() or L.option_line(p.one):
            return ""
        marks = [(m[1].upper(), m.start(), m.end()) for m in re.finditer(r"([A-L])\s*[.、．:：)）]\s*", p.one, re.I)]
        gap = ord(marks[0][0]) - ord(q.next_key()) if marks else -1
        head = p.one[: marks[0][1]].strip() if marks else ""
        if gap not in (0, 1) or gap == 1 and not head:
            return ""
        found = [("option", q.next_key(), head)] if gap else [("text", "", head)] if head else []
        for k, (key, _, b) in enumerate(marks):
            if ord(key) != ord(marks[0][0]) + k:
                break
            found.append(("option", key, p.one[b : marks[k + 1][1] if k + 1 < len(marks) else len(p.one)].strip()))
        if not all(v for _, _, v in found):
            return ""
        for piece in found:
            self.take(*piece, p)
        self.count("compact_choices")
        return "option"

    def _lone_answer(self, p: Line) -> str:
        q = self.now
        if not q or self._next_option(p):
            return ""
        truth = L.is_truth(p.one)
        colon = re.match(r"^([AB])\s*[:：]\s*(正确|错误|对|错)\s*[,，。；;]?$", p.one)
        if colon and (q.hint == "judge" or L.has_blank(q.question())):
            q.answer.append("A" if L.truth_of(colon[2]) else "B")
            truth = True
        elif L.answer_alone(p.one) and (q.options or truth or q.hint == "judge" and re.match("^[AB]", p.one)):
            q.answer += L.letters(p.one)
        else:
            return ""
        if truth:
            q.hint, q.truth = "judge", True
        q.answer_from.append("line")
        self.touch(p)
        self.mode = "answer"
        return "answer"

    def _next_option(self, p: Line) -> tuple[str, str] | None:
        """(key, body) of a line that is the option to come."""
        q = self.now
        if not q or not q.stem:
            return None
        m = re.match(r"^([A-L])\s*(?:[.、．:：)）]\s*)?(.+)$", re.sub(r"^[（(【\[]\s*([A-L])\s*[）)】\]]", r"\1.", p.one), re.I)
        if not m or m[1].upper() != q.next_key() or re.match(r"[A-Za-z0-9]", m[2]) and not re.match(r"^[（(【\[]?\s*[A-L]\s*[.、．:：)）\s]", p.one, re.I):
            return None
        return m[1].upper(), m[2].strip()

    def _option(self, p: Line) -> str:
        found = self._next_option(p)
        if not found:
            return ""
        parts = L.pieces(p.text)
        several = [x for x in parts if x[0] == "option"]
        if len(several) > 1 and several[0][1] == found[0] or any(x[0] in ("answer", "reference", "analysis") for x in parts) and several:
            for piece in parts:
                self.take(*piece, p)
        else:
            self.touch(p, "")
            self.now.add_option(*found, p.images)
            self._styled(*found, p)
            self.mode = "option"
        return "option"

    def _unlabelled(self, p: Line) -> str:
        """An answer in words without a label, after a question that wants one."""
        q = self.now
        if not q or self.mode != "question" or q.options or q.complete() or not q.stem or not p.one:
            return ""
        stem, text = q.question(), p.one
        if q.label == "填空题" and L.has_blank(stem) and not L.has_blank(text) and not L.asks(text):
            sure = True
        elif not (q.hint == "short" or L.asks_for_text(stem)):
            return ""
        elif re.match(r"[A-L]\s*[.、．:：)）]", text, re.I) or self._mapping(text, stem):
            sure = True
        elif self._question_goes_on(text, stem) or L.asks(text):
            return ""
        else:
            short = q.hint == "short"
            points = 3 * short + 2 * bool(re.search(r"[？?]$", stem)) + (short and bool(re.search("[。！!]$", stem))) + 2 + (q.boundary == "label")
            points += 3 * L.list_item(text) + 2 * bool(re.match("是指|是|指|包括|主要包括|由|有|可分为|分为|应|需要|需|其|答|原因是|措施有|特点是|作用是", text)) + (len(text) >= 12 and not re.search("[？?]$", text))
            sure = points >= 4
        if not sure:
            return ""
        self.touch(p, "answer")
        self.mode, q.hint = "reference", "short"
        q.answer_from.append("unlabelled")
        q.prose.append(p.text)
        self.count("unlabelled_answers")
        return "answer"

    @staticmethod
    def _mapping(text: str, stem: str) -> bool:
        """A line that explains letters one by one, out of order or many."""
        keys = re.findall(r"(?:^|[\s；;。])[（(]?\s*([A-Z])\s*[）).、．:：]", text)
        return len(keys) >= 3 and L.asks_for_text(stem) and (len(keys) >= 6 or [ord(k) for k in keys] != list(range(ord(keys[0]), ord(keys[0]) + len(keys))) or bool(re.search("字母.*含义", stem)))

    @staticmethod
    def _question_goes_on(text: str, stem: str) -> bool:
        if re.match("和|与|及|或|以及|并|且|其中|即|分别|包括|由|是|为|的|可|应|需|需要|以及其", text):
            return not re.search("[。！？?]$", stem)
        open_end = re.search("[，,：:、（(]$|(?:和|与|及|或|包括|分为|由|是|为|有|如下|下列|以下)$", stem)
        return bool(open_end or not re.search("[。！？?；;]$", stem) and re.search("[？?]$", text))

    def _guess(self, p: Line) -> str:
        """A question without any mark of a start: after a complete one, or where none is open."""
        q, text = self.now, p.one
        free = self.kind != PDF or self.relaxed or bool(re.search(r"[?？]\s*$", text))
        like = free and L.question_like(text, self.hint, p.listed)
        if q is not None and not (q.complete() and like):
            return ""
        if q is None:
            if L.option_line(text) or len(text) < 5 and not p.images or not (self.hint or like or free and (p.images or p.listed)):
                return ""
        self.open("", "guessed")
        self.touch(p)
        if not self._blanks(p.text, p):
            self.content(p.text, p)
        return "start"

    def _rest(self, p: Line) -> str:
        if self.now is None:
            self.left.append(p)
            return "left"
        self.touch(p)
        if p.text:
            implicit = self.mode == "question" and not self.now.stem
            self.content(p.text, p, implicit)
        return "text"

    RULES = (_material, _empty, _awaited, _page, _meta, _labelled, _section_row, _continues, _title, _heading, _listed_option, _start, _lost_a, _fragment, _lone_answer, _option, _unlabelled, _guess, _rest)

    def line(self, p: Line) -> str:
        """Takes one line; returns what it was read as."""
        return next(what for rule in self.RULES if (what := rule(self, p)))


# --- drafts to rows -------------------------------------------------------------------------------
#: What stands for a question's text that was not found.
_NO_TEXT, _NO_TEXT_IMAGE = "【题干文字未识别】", "【图片题：题干文字未识别】"


def core_type(hint: str, options: list[list], answer: list[str], truth: bool, prose: bool, wants_text: bool) -> str:
    """A question's type by what it has: the number of options and answers counts before a heading's word."""
    n, k = len(options), len(answer)
    truths = [L.truth_of(o[1]) for o in options]
    pair = n == 2 and True in truths and False in truths
    table = (
        (hint == "short" and not k, "short"),
        (n > 1 and k > 1, "multiple"),
        (n > 1 and k == 1, "judge" if pair or truth else "single"),
        (truth or pair, "judge"),
        (n > 1, "multiple" if hint == "multiple" else "single"),
        (n == 1, "judge" if truths[:1] != [None] or hint == "judge" else "multiple" if k > 1 or hint == "multiple" and not k else "single"),
        (hint == "short" or prose or wants_text, "short"),
        (hint == "judge" or hint == "multiple" and k > 1, hint),
    )
    return next((t for ok, t in table if ok), "single" if k == 1 or hint != "multiple" else "multiple")


def _judgement(options: list[list], answer: list[str]) -> tuple[list[list], list[str], bool]:
    """Both options of a judgement in their usual order, the answer with them; False if the options are others."""
    both = [["A", "正确", []], ["B", "错误", []]]
    truths = [L.truth_of(o[1]) for o in options]
    if len(options) < 2:
        own = [] if not truths or truths[0] is None or answer else ["A" if truths[0] else "B"]
        return both, answer or own, True
    if len(options) == 2 and None not in truths:
        said = _unique("A" if truths[k] else "B" for a in answer for k, o in enumerate(options) if o[0] == a)
        return both, said or answer, True
    return options, answer, False


def settled(q: Draft, kind: str = "", appendix: bool = False) -> dict | None:
    """A draft as a row; None for one that holds nothing."""
    stem, prose = q.question(), [p for p in q.prose if p]
    hint, sources = q.hint, list(q.answer_from)
    if q.label == "填空题" and not (prose or q.answer or q.options):
        clean, found = L.filled_blanks(stem)
        remark = appendix and re.search("_{2,}|＿{2,}", stem) and len(found) == 1 and re.search("除外|除非|备注|说明", found[0])
        if found and not remark:
            stem, prose, hint = clean, ["；".join(found)], "short"
            sources.append("blanks")
    if not prose and not q.options and not q.answer:
        head, tail = L.inline_text_answer(stem, hint)
        if tail:
            stem, prose = head, [tail]
            sources.append("inline")
    failed = False
    if not (stem or q.options or prose):
        raw = [r for t in q.raw if (r := L.one_line(t)) and not re.fullmatch(r"\d{1,4}\s*[\[【]?\s*题\s*[\]】]?|题|题目|题干|问题", r)]
        pictures = q.images or q.answer_images or q.analysis_images
        if not (q.number or q.boundary not in ("", "guessed") or pictures or raw):
            return None
        stem, failed = " ".join(raw) if raw and not pictures else _NO_TEXT_IMAGE if pictures else _NO_TEXT, True
    options = []
    for key, parts, images in q.options:
        text = L.cleaned(parts, "question")
        options.append([key, "" if images and L.figure_only(text) else text, _unique(images)])
    answer = _unique(q.answer)
    if options and (pair := L.judge_pair(f"{options[0][0]}.{options[0][1]}")):
        options = [[k, t, options[0][2] if k == "A" else []] for k, t in pair]
    if collapsed(options, answer, stem, hint):
        sources.append("collapsed")
    if appendix and not answer and hint not in ("short", "judge") and len(options) > 1:  # the answer stands in the blank
        inside = re.findall(r"[（(]\s*([A-L])\s*[）)]", stem)
        if len(inside) == 1 and any(o[0] == inside[0] for o in options):
            answer, stem = inside, re.sub(r"([（(])\s*[A-L]\s*([）)])", r"\1 \2", stem)
    if appendix and not answer and hint == "judge" and (m := re.match(r"^(.*?[（(]\s*[）)])\s*(正确|错误|对|错)\s*[。．.]?$", stem)):
        stem, answer = m[1], ["A" if L.truth_of(m[2]) else "B"]
    core = core_type(hint, options, answer, q.truth, bool(prose), L.asks_for_text(stem))
    if core == "judge":
        options, answer, _ = _judgement(options, answer)
    text = L.cleaned(prose, "answer")
    if core == "short":
        if options and not text:
            text = L.cleaned([f"{k}. {t}" for k, t, _ in options], "answer")
        if answer and not text:
            text = "".join(answer)
        options, answer = [], []
    label = q.label if q.label and L.type_of(q.label)[0] == core else L.CORE_LABELS[core]
    row = {
        "number": q.number, "type": core, "display_label": label, "source_label": q.label, "type_hint": q.hint, "level": q.level, "category": q.category, "chapter": q.chapter,
        "question": stem, "options": [{"key": k, "text": t, "images": list(i)} for k, t, i in options], "answer": answer, "answer_text": text,
        "blank_answers": L.split_blanks(text, len(L.BLANK.findall(stem))) if q.label == "填空题" or core == "short" and L.has_blank(stem) else [],
        "analysis": L.cleaned(q.analysis, "analysis"), "images": _unique(q.images), "answer_images": _unique(q.answer_images), "analysis_images": _unique(q.analysis_images),
        "material": q.material, "material_images": _unique(q.material_images), "difficulty": q.difficulty, "knowledge_point": q.knowledge,
        "boundary": q.boundary, "answer_from": "、".join(_unique(sources)), "raw_texts": q.raw, "paragraphs": q.at, "inferred_boundary": q.guessed, "placeholder": False, "failed": failed,
    }
    return from_raw_lines(row)


def with_missing(rows: list[dict], sections) -> tuple[list[dict], list[int], list[int]]:
    """(rows with a placeholder for each number up to a section's declared count that it lacks, in their places; the
    numbers that are missing; numbers beyond a declared count)."""
    out, missing, extra = [], [], []
    for k, (first, label, core, count, head) in enumerate([(0, "", "", 0, ""), *sections]):
        end = sections[k][0] if k < len(sections) else len(rows)
        own = rows[first if k else 0 : end]
        numbers = [int(r["number"]) for r in own if r["number"].isdigit()]
        if count and any(1 <= n <= count for n in numbers):
            for n in sorted(set(range(1, count + 1)) - set(numbers)):
                place = next((i for i, r in enumerate(own) if r["number"].isdigit() and int(r["number"]) > n), len(own))
                own.insert(place, _placeholder(n, label, core, head, own[0] if own else {}))
                missing.append(n)
            extra += [n for n in numbers if n > count]
        out += own
    return out, missing, extra


def _placeholder(number: int, label: str, core: str, head: str, near: dict) -> dict:
    #: Fixed value: the text of a question that its section declares and does not have.
    text = f"【原文缺少内容：{label}第 {number} 题】"
    blank = {"number": str(number), "type": core or "single", "display_label": label, "source_label": label, "type_hint": core, "question": text, "boundary": "declared", "raw_texts": [head], "placeholder": True}
    same = {c: near.get(c, "") for c in ("level", "category", "chapter")}
    return dict.fromkeys(_NAMES[2:], "") | {c: [] for c in _LISTS} | {"inferred_boundary": False, "failed": False, "duplicate_of": None} | same | blank


def _fits(row: dict, key: Key) -> bool:
    """Whether a key's type is the question's."""
    if not key.label or key.label in (row["display_label"], row["source_label"]):
        return True
    if key.label == "选择题":
        return row["type"] in ("single", "multiple")
    if key.by_place and key.label in ("填空题", "简答题", "问答题", "计算题") and row["source_label"] in ("填空题", "简答题", "问答题", "计算题"):
        return False
    return row["type"] == L.type_of(key.label)[0]


def apply_keys(rows: list[dict], keys: list[Key]) -> int:
    """Gives answers from tables to questions that have none, each once; returns how many."""
    used, applied = set(), 0
    for key in keys:
        free = [k for k, r in enumerate(rows) if k not in used and not r["placeholder"] and not r["answer"] and (not r["answer_text"] or key.by_place and r["answer_from"] == "unlabelled")]
        if key.by_place:
            free = [k for k in free if _fits(rows[k], key)]
        else:
            free = [k for k in free if rows[k]["number"] == str(key.number)]
            free = [k for k in free if _fits(rows[k], key)] or free
        if not free:
            continue
        row, found = rows[free[0]], L.letters(key.value)
        written = L.type_of(key.label)[0] == "short" if key.label and key.label != "选择题" else row["type"] == "short"
        if written:
            row["answer"], row["answer_text"] = [], L.cleaned([key.value], "answer")
            if not row["options"]:
                core, label = L.type_of(key.label)
                row["type"], row["display_label"] = "short", label if core == "short" else row["display_label"]
            row["blank_answers"] = L.split_blanks(row["answer_text"], len(L.BLANK.findall(row["question"])))
        elif L.is_truth(key.value):
            row["type"], row["display_label"], row["answer"], row["answer_text"] = "judge", "判断题", found, ""
            row["options"] = [{"key": k, "text": t, "images": []} for k, t in (("A", "正确"), ("B", "错误"))]
        elif found:
            row["answer"], row["answer_text"] = found, ""
            if len(found) > 1 and row["display_label"] != "不定项选择题":
                row["type"], row["display_label"] = "multiple", row["source_label"] if L.type_of(row["source_label"])[0] == "multiple" else "多选题"
        else:
            continue
        row["answer_from"] = "、".join(x for x in (row["answer_from"], "key") if x)
        used.add(free[0])
        applied += 1
    return applied


def gaps(rows: list[dict], most: int = 50) -> int:
    """How many numbers are missing between neighbours of one level, category and chapter."""
    last, out = {}, 0
    for r in rows:
        if r["number"].isdigit() and 1 <= (n := int(r["number"])) <= 9999:
            group = (r["level"], r["category"], r["chapter"])
            before = last.get(group)
            if before and n != 1 and 0 < n - before - 1 <= most:
                out += n - before - 1
            last[group] = n
    return out


def repeats(rows: list[dict]) -> int:
    """Marks questions whose text and options came before; returns how many."""
    seen, out = {}, 0
    for r in rows:
        sign = L.compact("|".join([r["question"], *(o["text"] for o in r["options"])]))
        if len(sign) >= 8 and not r["placeholder"]:
            if sign in seen:
                out += 1
            r["duplicate_of"] = str(seen[sign]) if sign in seen else None
            seen.setdefault(sign, r["ord"])
    return out


# --- a document -----------------------------------------------------------------------------------
_COUNTED = ("boundaries", "explicit", "guessed", "inline_answers", "compact_choices", "styled_blanks", "unlabelled_answers", "bare_numbers", "titles")
#: Counters of :func:`diagnostics`.
COUNTERS = (
    "paragraphs", "kept", "noise", "assigned", "structure", "unassigned", "joined_numbers", "image_options", *_COUNTED, "failed", "questions", "content",
    "placeholders", "sections", "extra", "keys", "keys_applied", "gaps", "duplicates", "normal", "warning", "error",
)


def read(lines: list[Line], source: str = "", kind: str = "", relaxed: bool = False) -> tuple[list[dict], dict]:
    """(rows, counters) of one document under one profile."""
    kept, keys, appendix = answer_keys(lines)
    appendix = appendix and kind in ("", *WORD)
    kept, joined = joined_starts(materials(kept))
    kept, gone = without_noise(kept)
    kept, pictures = image_options(kept)
    reader = Reader(source, kind, relaxed, appendix)
    for p in kept:
        reader.line(p)
    reader.close()
    rows, moved = [], {}
    for k, q in enumerate(reader.done):
        moved[k] = len(rows)
        if (row := settled(q, kind, appendix)) is not None:
            rows.append(row)
    moved[len(reader.done)] = len(rows)
    content = len(rows)
    rows, missing, extra = with_missing(rows, [(moved[first], *rest) for first, *rest in reader.sections])
    for k, r in enumerate(rows):
        r["ord"], r["duplicate_of"] = k + 1, None
    applied = apply_keys(rows, keys)
    duplicates = repeats(rows)
    states = [graded(r)[1] for r in rows if not r["placeholder"]]
    of_keys = {a for p in lines for a in p.at} - {a for p in kept for a in p.at} - set(gone)
    numbers = {
        "paragraphs": len(lines), "kept": len(kept), "noise": len(gone) + len(reader.noise), "assigned": sum(len(q.at) for q in reader.done), "structure": len(reader.structure) + len(of_keys), "unassigned": sum(len(p.at) for p in reader.left),
        "joined_numbers": joined, "image_options": pictures, "failed": sum(r["failed"] for r in rows), "questions": len(rows), "content": content, "placeholders": len(missing),
        "sections": sum(bool(s[1]) for s in reader.sections), "extra": len(extra), "keys": len(keys), "keys_applied": applied, "gaps": gaps(rows), "duplicates": duplicates,
    }
    return rows, {c: 0 for c in COUNTERS} | {c: reader.counts.get(c, 0) for c in _COUNTED} | numbers | {s: states.count(s) for s in ("normal", "warning", "error")}


def layout(lines: list[Line]) -> dict:
    """Counts of the forms that a document's lines have, and the layout they make."""
    n = dict.fromkeys(("indexed_typed", "indexed", "numbered", "bare_numbered", "labelled", "option_lines", "answer_lines", "type_headings", "table_like"), 0)
    rows = [p.one for p in lines if p.one]
    for text in rows:
        found = L.start_of(text)
        name = found["name"] if found else "bare number" if L._BARE_NUMBER.match(text) else ""
        form = {"number and type": "indexed_typed", "broken number": "indexed_typed", "count": "indexed", "number before 题": "indexed", "number": "numbered", "bare number": "bare_numbered", "label": "labelled", "type": "labelled"}.get(name)
        if form:
            n[form] += 1
        n["option_lines"] += L.option_line(text) is not None
        n["answer_lines"] += bool(re.match(r"(?:正确答案|标准答案|参考答案|答案|答)\s*(?:为|是)?\s*[:：]", text)) or L.answer_alone(text)
        n["type_headings"] += L.type_heading(text) is not None
        n["table_like"] += "\t" in text or bool(re.search("(?:题目|题干).*(?:答案|正确答案)", text))
    indexed, share = n["indexed_typed"] + n["indexed"], len(rows)
    many, some = max(3, min(12, -(-share * 4 // 100))), max(2, min(8, -(-share * 2 // 100)))
    if indexed >= many:
        name = "mixed-indexed" if n["numbered"] >= some or n["labelled"] >= some else "indexed"
    elif n["labelled"] >= some and n["answer_lines"] >= some:
        name = "labeled"
    else:
        name = "numbered-choice" if n["numbered"] >= some and n["option_lines"] >= some else "generic"
    strong = indexed + n["numbered"] + n["labelled"]
    return n | {"layout": name, "strong": strong, "loose": strong + n["bare_numbered"]}


def reading_score(counts: dict, form: dict) -> float:
    """How good a reading is: its questions by their state, what it left over, and how many of the expected it found."""
    #: Points of each.
    points = {"normal": 12, "warning": 9, "error": 2, "unassigned": -0.35, "duplicates": -5, "gaps": -0.5}
    score = sum(p * counts[c] for c, p in points.items())
    expected = max(form["strong"], form["loose"])
    if expected:
        share = counts["content"] / expected
        score += 500 * min(1, share) - max(0, share - 1.18) * expected * 8
    return score


def adapted(lines: list[Line], source: str = "", kind: str = "") -> tuple[list[dict], dict]:
    """(rows, diagnostics) of one document: of a PDF the better of two readings."""
    form = layout(lines)
    strict = read(lines, source, kind)
    chosen, profile, score = strict, "strict", reading_score(strict[1], form)
    if kind == PDF:  # elsewhere both readings are the same
        relaxed = read(lines, source, kind, relaxed=True)
        a, b = strict[1], relaxed[1]
        # more questions that are no better, with more guesses and gaps, are worse
        worse = len(relaxed[0]) > len(strict[0]) and b["normal"] <= a["normal"] and b["warning"] >= a["warning"] and b["error"] >= a["error"] and b["gaps"] > a["gaps"] and b["guessed"] > a["guessed"]
        if (other := reading_score(b, form)) > score and not worse:
            chosen, profile, score = relaxed, "relaxed", other
    return chosen[0], form | chosen[1] | {"profile": profile, "score": round(score, 2)}


def parse(lines: list[dict], source: str = "", kind: str = "") -> list[dict]:
    """Questions of one document's lines (index, text, and of images, strong, style, num_id, level, list_ordinal what there is)."""
    return adapted([_line(p) for p in lines], source, kind)[0]


def _line(p: dict) -> Line:
    lists = ([] if p.get(c) is None else list(p[c]) for c in ("images", "strong"))
    return Line(p["index"], p.get("text") or "", *lists, p.get("style") or "", p.get("num_id") or "", p.get("level"), p.get("list_ordinal") or 0)


# --- tables ---------------------------------------------------------------------------------------
SCHEMA = (
    "doc_id string, ord int, number string, type string, display_label string, source_label string, type_hint string, level string, category string, chapter string, "
    "question string, options array<struct<key:string,text:string,images:array<string>>>, answer array<string>, answer_text string, blank_answers array<string>, analysis string, "
    "images array<string>, answer_images array<string>, analysis_images array<string>, material string, material_images array<string>, difficulty string, knowledge_point string, "
    "boundary string, answer_from string, raw_texts array<string>, paragraphs array<int>, inferred_boundary boolean, placeholder boolean, failed boolean, duplicate_of string"
)
_NAMES = re.findall(r"(?:^|, )(\w+) (?:string|int|array|boolean)", SCHEMA)
_LISTS = ("options", "answer", "blank_answers", "images", "answer_images", "analysis_images", "material_images", "raw_texts", "paragraphs")
_INPUTS = (("images", "array<string>"), ("strong", "array<string>"), ("style", "string"), ("num_id", "string"), ("level", "int"), ("list_ordinal", "int"), ("kind", "string"), ("source_name", "string"))


def document(pdf: pd.DataFrame) -> tuple[list[dict], dict]:
    """:func:`adapted` of a table of one document's paragraphs."""
    rows = pdf.sort_values("index").astype(object).where(pdf.notna(), None).to_dict("records")
    lines = [_line(r | {c: None if r[c] is None else int(r[c]) for c in ("index", "level", "list_ordinal")}) for r in rows]
    kind, source = (next((r[c] for r in rows if r[c]), "") for c in ("kind", "source_name"))
    return adapted(lines, source, kind)


def _columns(paragraphs: DataFrame, key: str) -> DataFrame:
    there = [F.col(c) if c in paragraphs.columns else F.expr(f"cast(null as {t})").alias(c) for c, t in _INPUTS]
    return paragraphs.select(F.col(key), F.col("index").alias("index"), "text", *there)


def questions(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """Validated questions of paragraphs (key, index, text, and of images, strong, style, num_id, level, list_ordinal,
    kind and source_name what there is)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _ = document(pdf)
        return pd.DataFrame([{"doc_id": pdf[key].iloc[0], **r} for r in rows], columns=_NAMES)

    found = validate(_columns(paragraphs, key).groupBy(key).applyInPandas(run, SCHEMA))
    #: Issues of placeholders and of questions without text, whatever else they have.
    missing, unread = F.concat(F.lit("原文声明存在第 "), "number", F.lit(" 题，但正文缺少该题内容")), "题目边界已检测，但题干文字未完整识别"
    issues = F.when(F.col("placeholder"), F.array(missing)).when(F.col("failed"), F.array_distinct(F.concat("issues", F.array(F.lit(unread))))).otherwise(F.col("issues"))
    sure = F.when(F.col("placeholder"), 0).when(F.col("failed"), F.least("confidence_x100", F.lit(20))).otherwise(F.col("confidence_x100"))
    lost = F.col("placeholder") | F.col("failed")
    return found.withColumns({"issues": issues, "confidence_x100": sure, "status": F.when(lost, "error").otherwise(F.col("status"))})


_FORM = ("indexed_typed", "indexed", "numbered", "bare_numbered", "labelled", "option_lines", "answer_lines", "type_headings", "table_like", "strong", "loose")


def diagnostics(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """One row per document: its layout, the profile that was chosen and its score, and all counters."""
    names = ("doc_id", "layout", "profile", "score", *_FORM, *COUNTERS)
    schema = "doc_id string, layout string, profile string, score double, " + ", ".join(f"{c} long" for c in (*_FORM, *COUNTERS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, found = document(pdf)
        return pd.DataFrame([{"doc_id": pdf[key].iloc[0], **found}], columns=names)

    return _columns(paragraphs, key).groupBy(key).applyInPandas(run, schema)


def entry(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """Questions only: the texts, options and answers that readers of a document want."""
    return questions(paragraphs, key).select("doc_id", "ord", "number", "type", "question", "options", "answer", "answer_text")
