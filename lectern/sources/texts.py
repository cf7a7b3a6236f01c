"""Text-like sources: encodings, delimited tables, HTML, Markdown, RTF."""

from __future__ import annotations

import csv
import html
import io
import re
from functools import cache
from html.parser import HTMLParser

import numpy as np

#: Encodings tried after the byte-order marks and strict UTF-8.
ENCODINGS = ("utf-16-le", "utf-16-be", "gb18030", "cp1252")
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\x84\x31\x95\x33", "gb18030"))


@cache
def _costs() -> np.ndarray:
    """What a character costs a reading, by code point; a plain ASCII byte costs 1.

    A common Chinese character costs a little more than the two ASCII bytes that may be misread as one, so a stretch of
    ASCII, whatever its words, never speaks for UTF-16: the other bytes decide.
    """
    cost = np.full(0x110000, 3.5)
    cost[:128], cost[:32], cost[[0, 127]], cost[[9, 10, 13]] = 1, 1.7, 4, 1
    cost[0x80:0xA0], cost[0xA0:0xC0], cost[0xC0:0x100] = 4, 2.5, 1.7
    cost[[ord(c) for c in bytes(k for k in range(0x80, 0xA0)).decode("cp1252", "ignore")]] = 2.5
    cost[[ord(c) for c in "‘’“”–—…€"]] = 1.7
    cost[0x3040:0x3100] = 2.2
    cost[0x3400:0xA000], cost[0xF900:0xFB00], cost[0xAC00:0xD7A4], cost[0xE000:0xF900] = 2.5, 2.5, 3, 3.3
    for codec, first, last, value in (("big5", 0xA4, 0xC6, 2.4), ("gb2312", 0xD8, 0xF7, 2.4), ("gb2312", 0xA1, 0xA9, 2.2), ("gb2312", 0xB0, 0xD7, 2.05)):
        known = (bytes((lead, trail)).decode(codec, "ignore") for lead in range(first, last + 1) for trail in range(0x40, 0xFF))
        at = [ord(c) for c in known if len(c) == 1 and ord(c) > 127]
        cost[at] = np.minimum(cost[at], value)
    return cost


def _cost(data: bytes, encoding: str) -> float:
    """How little ``data`` looks like text of an encoding: its characters' costs, 8 for each broken one, and half a one
    where a Chinese character touches a Latin letter."""
    broken = 0
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        text = data.decode(encoding, "replace")
        broken = text.count("\ufffd")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    han, letter = (points >= 0x3400) & (points < 0xA000), (points < 128) & (((points | 32) - 97) < 26)
    touching = np.count_nonzero(han[1:] & letter[:-1]) + np.count_nonzero(han[:-1] & letter[1:])
    return float(_costs()[points].sum()) + 8 * broken + touching / 2


def decode_auto(data: bytes) -> str:
    """By byte-order mark, declared XML encoding, strict UTF-8, else the most readable of :data:`ENCODINGS`."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if m := re.match(rb"""\s*<\?xml[^>]*encoding=["']([\w.-]+)""", data):
        try:
            return data.decode(m[1].decode("ascii"))
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(min(ENCODINGS, key=lambda e: _cost(data, e)), "replace")


def lines(text: str) -> list[tuple[int, str]]:
    """Non-blank lines with their number in the text."""
    return [(k, line.strip()) for k, line in enumerate(re.split(r"\r\n?|\n", text)) if line.strip()]


#: The delimiters a table may have, in order of preference.
DELIMITERS = (",", "\t", ";", "|")


def sniff_delimiter(text: str) -> str:
    """Of the first 20 lines: ten points for a line it divides, the mean number of cells, minus five mean deviations."""
    sample = [line for line in re.split(r"\r?\n", text)[:20] if line]

    def points(delimiter: str) -> float:
        counts = [n for line in sample if (n := len(next(csv.reader([line], delimiter=delimiter), []))) > 1]
        if not counts:
            return float("-inf")
        mean = sum(counts) / len(counts)
        return 10 * len(counts) + mean - 5 * sum(abs(n - mean) for n in counts) / len(counts)

    best = max(DELIMITERS, key=points)  # the first of equals
    return best if points(best) > float("-inf") else ","


def table(text: str, delimiter: str | None = None) -> list[list[str]]:
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or sniff_delimiter(text))
    return list(reader)


class _Blocks(HTMLParser):
    """Visible text with line ends after blocks, and the cells of tables."""

    BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 tr section article header footer blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag in ("br", "hr"):
            self.out.append("\n")
        elif tag == "li":
            self.out.append("• ")
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.cell is not None:
                self.cell.append(data)


def html_blocks(text: str) -> tuple[str, list[list[str]]]:
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    shown = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out).replace("\xa0", " "))
    return shown, [r for r in parser.rows if r]


def markdown_plain(text: str) -> str:
    """Markdown without its marks: fences, headings, quotes, bullets, images, links, emphasis, code."""
    for pattern, to in (
        (r"(?m)^```[^\n]*$", ""), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*+]\s+(?=\D)", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", r"\1【图片】"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"`([^`]+)`", r"\1"),
    ):
        text = re.sub(pattern, to, text)
    return text


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr generator themedata listtable listoverridetable datastore".split())
_RTF_TEXT = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "cell": "\t", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(data: bytes) -> str:
    """The text of an RTF document: groups nest, ``\\uN`` skips its fallback, ``\\'hh`` bytes are of the code page."""
    source = data.decode("latin-1")
    page, out, pending = "cp1252", [], bytearray()
    stack: list[tuple[bool, int]] = []
    hidden, fallback, skip = False, 1, 0

    def flush():
        if pending:
            out.append(bytes(pending).decode(page, "replace"))
            pending.clear()

    for m in _RTF.finditer(source):
        word, number, byte, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, fallback))
        elif brace == "}":
            flush()
            hidden, fallback = stack.pop() if stack else (False, 1)
        elif word:
            if word == "ansicpg" and number:
                page = {"936": "gb18030", "65001": "utf-8"}.get(number, f"cp{number}")
            elif word in _RTF_SKIP:
                hidden = True
            elif word == "uc":
                fallback = int(number or 1)
            elif word == "u" and number and not hidden:
                flush()
                out.append(chr(int(number) % 65536))
                skip = fallback
            elif word in _RTF_TEXT and not hidden:
                flush()
                out.append(_RTF_TEXT[word])
        elif sign == "*":
            hidden = True
        elif hidden:
            continue
        elif byte:
            if skip:
                skip -= 1
            else:
                pending.append(int(byte, 16))
        elif sign:
            flush()
            out.append({"~": "\xa0", "_": "-", "\n": "\n", "\r": "\n"}.get(sign, sign if sign in "\\{}" else ""))
        elif plain:
            cut = min(skip, len(plain))
            skip -= cut
            flush()
            out.append(plain[cut:])
    flush()
    # pairs of surrogates that came as two \u
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def unescape(text: str) -> str:
    return html.unescape(text)
