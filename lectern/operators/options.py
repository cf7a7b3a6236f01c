"""Repairs of one question's options, and its grade, as plain functions; the parser and stored rows use them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import lines as L

_SIGN = re.compile(rf"{L.WS}|[，,。；;：:'\"“”‘’（）()【】\[\]［］]")
_RAW = re.compile(r"^[（(]?\s*([A-L])\s*(?:[）)]|[.、．:：])\s*(.+)$|^([A-L])\s+(.+)$", re.I)


def signature(text: str) -> str:
    """What two options share that say the same."""
    return re.sub("[−–—]", "-", _SIGN.sub("", L.one_line(text).lower()))


def raw_bodies(raw_texts: list[str]) -> dict[str, list[str]]:
    """For each key the texts that lines give for it, in order, each once."""
    out: dict[str, list[str]] = {}
    for line in (one for raw in raw_texts or () for part in (raw or "").split("\n") if (one := L.one_line(part))):
        if m := _RAW.match(line):
            key, body = (m[1] or m[3]).upper(), (m[2] or m[4]).strip()
            if body and body not in out.setdefault(key, []):
                out[key].append(body)
    return out


def best_body(raw_texts: list[str], key: str) -> str:
    """The longest text that a line gives for a key; of equals the first."""
    return max(raw_bodies(raw_texts).get(key, [""]), key=len)


def collapsed(options: list[list], answer: list[str], stem: str, hint: str) -> bool:
    """Parts options [key, text, images] whose text holds the next option's mark ("x D. y" under C), in place.

    It takes evidence that there is a next option: an answer that names it or a later one, a later
    option that stands apart, or a question that asks to choose; and no other text under its key.
    """
    chooses = hint in ("single", "multiple") or L.has_blank(stem) or L.asks(stem)
    changed, k = False, 0
    while k < len(options):
        key, text, _ = options[k]
        following = chr(ord(key) + 1)
        m = re.search(rf"(?<=\S)[（(【\[]?{following}\s*[.、．:：)）】\]]\s*(?=\S)", text) if key < "L" else None
        later = any(o[0] > following for o in options)
        named = any(a >= following for a in answer)
        if m and (chooses or later or named):
            head, tail = L.cleaned([text[: m.start()]], "question"), L.cleaned([text[m.end() :]], "question")
            own = next((o for o in options if o[0] == following), None)
            if head and tail and (own is None or not own[1] or own[1] == tail):
                options[k][1] = head
                if own is None:
                    options.insert(k + 1, [following, tail, []])
                else:
                    own[1] = own[1] or tail
                changed = True
        k += 1
    return changed


def from_raw_lines(row: dict) -> dict:
    """A row whose cut, doubled or torn options have the text that its own lines give for them."""
    options = row["options"]
    if row["type"] == "judge" and len(options) == 2 and all(L.truth_of(o["text"]) is not None for o in options):
        return row
    bodies, signs = raw_bodies(row["raw_texts"]), [signature(o["text"]) for o in options]
    keys = [o["key"] for o in options]
    for k, o in enumerate(options):
        raw = max(bodies.get(o["key"], [""]), key=len)
        now, full = signs[k], signature(raw)
        later = [x for x in keys if x > o["key"]]
        several = any(re.search(rf"{x}\s*[.、．:：)）]", raw) for x in later) or sum(bool(re.search(rf"(?:^|\s){x}\s+", raw)) for x in later) >= 2
        if not full or full == now or several or L._LABELLED.search(raw):
            continue
        doubled = bool(now) and signs.count(now) > 1
        if now.startswith(full) and not doubled:
            continue  # it goes on beyond its first line
        cut = not now or full.startswith(now) or full.endswith(now) or len(now) < len(full) * 68 // 100
        torn = bool(re.match(r"[，,。；;、:：）)\]】]", L.one_line(o["text"])))
        if (cut or doubled or torn) and not (o["images"] and L.figure_only(raw)):
            o["text"] = raw
    return row


def with_rules(row: dict, rules) -> dict:
    """A row after optional rules (question pattern, key, doubled key, text): where the question matches and the key's
    option repeats the doubled one's, it gets the text.  There are no rules but those a caller brings."""
    by = {o["key"]: o for o in row["options"]}
    for pattern, key, other, text in rules:
        if key in by and other in by and re.search(pattern, row["question"]) and signature(by[key]["text"]) == signature(by[other]["text"]) != "":
            by[key]["text"] = text
    return row


def repaired(questions: DataFrame, rules=()) -> DataFrame:
    """``questions`` with :func:`from_raw_lines` and :func:`with_rules` applied to their options."""
    kind = "array<struct<key:string,text:string,images:array<string>>>"

    @F.pandas_udf(kind)
    def fixed(kinds: pd.Series, texts: pd.Series, options: pd.Series, raws: pd.Series) -> pd.Series:
        out = []
        for kind, text, own, raw in zip(kinds, texts, options, raws, strict=True):
            rows = [{"key": o["key"], "text": o["text"] or "", "images": [] if o["images"] is None else list(o["images"])} for o in (own if own is not None else ())]
            row = {"type": kind, "question": text or "", "options": rows, "raw_texts": [] if raw is None else list(raw)}
            out.append(with_rules(from_raw_lines(row), rules)["options"])
        return pd.Series(out)

    return questions.withColumn("options", fixed("type", "question", "options", "raw_texts"))


def _anomaly(text: str) -> bool:
    return bool(re.search(r"[�-]|煾{2,}|[A-Za-z0-9.]ö|[±²³]ö|ö{2,}", text) or L._GARBLED.search(text))


def graded(row: dict) -> tuple[int, str]:
    """(confidence in hundredths, status) of one row: what :func:`lectern.operators.validate.validate` gives a table."""
    q, kind, options, answer = row["question"], row["type"], row["options"], row["answer"]
    keys, texts, n = [o["key"] for o in options], [o["text"] or "" for o in options], len(options)
    written, figures = kind == "short", n > 1 and all(L.figure_only(t) for t in texts)
    pictures = len(row["images"]) + sum(len(o["images"]) for o in options)
    groups: dict[str, list[str]] = {}
    for k, t in zip(keys, texts, strict=True):
        if sign := signature(t):
            groups.setdefault(sign, []).append(k)
    doubled = []
    for sign, own in () if figures else groups.items():
        if len(own) > 1:
            doubled.append(8 if all(signature(best_body(row["raw_texts"], k)) == sign for k in own) else 18)
    truths = [L.truth_of(t) for t in texts]
    answered = bool(answer or row["answer_text"] or row["answer_images"])
    everything = " ".join([q, *texts, row["answer_text"], row["analysis"], *row["raw_texts"]])
    #: Condition, hundredths; the table of :func:`validate`.
    rules = (
        (len(q) < 4, 45), (bool(re.search(r"(?:答案|参考答案|解析)\s*[:：]", q)), 18), (written and not row["answer_text"].strip() and not row["answer_images"], 35),
        (not written and n < 2, 40), (not written and not answer, 35), (not written and any(a not in keys for a in answer), 40), (not written and figures and pictures < n, 20),
        (any(not o["text"] and not o["images"] for o in options), 15), (len(set(keys)) != n, 20), (bool(doubled), max(doubled, default=0)), (len(q) > 1000, 25), (len(row["answer_text"]) > 3000, 20),
        (_anomaly(everything), 22), (kind == "multiple" and len(answer) < 2, 15), (kind == "judge" and (n != 2 or set(truths) != {True, False}), 15),
        (row["inferred_boundary"], 5 if answered else 8), (bool(row.get("duplicate_of")), 18),
    )
    sure = max(0, 100 - sum(points for hit, points in rules if hit))
    return sure, "error" if not written and n < 2 or sure < 45 or row.get("failed") else "warning" if any(hit for hit, _ in rules) else "normal"
