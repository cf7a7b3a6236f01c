"""Text of PDF files: objects, streams, fonts' Unicode maps, positioned text, lines, columns, margins."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from math import ceil, hypot
from statistics import median

from lectern.functions.lines import heading, repair_mojibake
from lectern.sources.fonts import Font, base_encoding, differences, gid_texts

#: What one stream may unpack to.
MOST_BYTES = 256 << 20
#: Fragments within this height are one line; margins recur on this share of pages, at least on 3.
LINE_HEIGHT, MARGIN_SHARE = 2.2, 0.3
#: Columns overlap in height by this share at least, and this share of their rows stand side by side.
COLUMN_OVERLAP, COLUMN_ROWS = 0.62, 0.22
_TOKEN = re.compile(rb"""\s+|%[^\r\n]*|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<dict><<|>>)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<mark>[\[\]])|(?P<ref>\d+\s+\d+\s+R\b)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'"*][A-Za-z0-9'"*]*)|(?P<text>\()|.""", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its bracket: brackets nest, a backslash escapes."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            at += 1
            if e == b"\r" and data[at : at + 1] == b"\n":
                at += 1
            elif e not in b"\r\n":
                out += _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0):
    while at < len(data):
        m = _TOKEN.match(data, at)
        kind, at = m.lastgroup, m.end()
        if kind == "text":
            s, at = _string(data, at)
            yield s, at
        elif kind == "hex":
            h = re.sub(rb"\s", b"", m[0][1:-1])
            yield bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), at
        elif kind == "name":
            yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[0][1:].decode("latin-1"))), at
        elif kind == "num":
            yield float(m[0]) if b"." in m[0] else int(m[0]), at
        elif kind == "ref":
            yield Ref(m[0].split()[0]), at
        elif kind in ("dict", "mark", "word"):
            yield Word(m[0].decode("latin-1")), at


def value(stream):
    """The next object of a token stream."""
    t, _ = next(stream)
    if t == "<<" and isinstance(t, Word):
        out = {}
        while True:
            k, _ = next(stream)
            if isinstance(k, Word) and k == ">>":
                return out
            out[k] = value(stream)
    if t == "[" and isinstance(t, Word):
        out = []
        while True:
            t = value(stream)
            if isinstance(t, Word) and t == "]":
                return out
            out.append(t)
    return t


class Document:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", data):
            self._object(int(m[1]), data, m.end())
        for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._inner(number)

    def _object(self, number: int, data: bytes, at: int) -> None:
        stream = tokens(data, at)
        try:
            o = value(stream)
            word, end = next(stream)
        except (StopIteration, ValueError, RecursionError):
            return
        self.objects[number] = o
        if word == "stream" and isinstance(o, dict):
            start = end + (2 if data[end : end + 2] == b"\r\n" else 1)
            size = o.get("Length")
            stop = start + size if isinstance(size, int) and not isinstance(size, Ref) else -1
            if stop < 0 or not re.match(rb"\s*endstream", data[stop : stop + 16]):
                stop = data.find(b"endstream", start)
            self.streams[number] = data[start : stop if stop >= 0 else len(data)]

    def _inner(self, number: int) -> None:
        body, o = self.stream(number), self.objects[number]
        heads = [t for t, _ in tokens(body[: self.get(o.get("First", 0))])]
        for n, offset in zip(heads[::2], heads[1::2], strict=False):
            try:
                self.objects.setdefault(n, value(tokens(body, self.get(o["First"]) + offset)))
            except StopIteration:
                pass

    def get(self, o):
        for _ in range(8):
            if not isinstance(o, Ref):
                return o
            o = self.objects.get(int(o))
        return None

    def stream(self, number: int) -> bytes:
        data, o = self.streams.get(number, b""), self.objects.get(number)
        filters = self.get(o.get("Filter")) if isinstance(o, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) == "FlateDecode":
                z = zlib.decompressobj()
                try:
                    data = z.decompress(data, MOST_BYTES)
                except zlib.error:
                    return b""
            elif self.get(f) == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data).decode())
            else:
                return b""
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in the order of the tree, with what they inherit."""
        out, seen = [], set()

        def walk(ref, held):
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen.add(id(node))
            held = held | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, held)
            else:
                out.append(held | node)

        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        for root in roots[-1:]:
            walk(root.get("Pages"), {})
        return out or [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Page"]


def unicode_map(cmap: bytes) -> tuple[dict[bytes, str], set[int]]:
    """Code to text, and the lengths of codes, of a ToUnicode map."""
    found: dict[bytes, str] = {}

    def text(raw: bytes) -> str:
        return raw.decode("utf-16-be", "replace")

    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        parts = [t for t, _ in tokens(block) if isinstance(t, bytes)]
        found |= {a: text(b) for a, b in zip(parts[::2], parts[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        stream = tokens(block)
        try:
            while True:
                low, high, to = value(stream), value(stream), value(stream)
                first, last = int.from_bytes(low), int.from_bytes(high)
                for k in range(min(last - first + 1, 65536)):
                    code = (first + k).to_bytes(len(low))
                    if isinstance(to, list):
                        if k < len(to):
                            found[code] = text(to[k])
                    else:
                        found[code] = text(to[:-2] + ((int.from_bytes(to[-2:]) + k) & 0xFFFF).to_bytes(2))
        except StopIteration:
            pass
    return found, {len(c) for c in found}


def cid_map(cmap: bytes) -> tuple[dict[bytes, int], set[int]]:
    """Code to character number, and the lengths of codes, of a font's own encoding."""
    found: dict[bytes, int] = {}
    sizes = {len(t) for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S) for t, _ in tokens(block) if isinstance(t, bytes)}
    for block in re.findall(rb"begincidchar(.*?)endcidchar", cmap, re.S):
        parts = [t for t, _ in tokens(block)]
        found |= dict(zip(parts[::2], parts[1::2], strict=False))
    for block in re.findall(rb"begincidrange(.*?)endcidrange", cmap, re.S):
        parts = [t for t, _ in tokens(block)]
        for low, high, cid in zip(parts[::3], parts[1::3], parts[2::3], strict=False):
            first, last = int.from_bytes(low), int.from_bytes(high)
            found |= {(first + k).to_bytes(len(low)): cid + k for k in range(min(last - first + 1, 65536))}
    return found, sizes


def cid_widths(doc: Document, parts: list) -> dict[int, float]:
    """Widths by character number: "first [w w ...]" or "first last w"."""
    out, k = {}, 0
    while k + 1 < len(parts):
        first, then = doc.get(parts[k]), doc.get(parts[k + 1])
        if isinstance(then, list):
            out |= {first + j: float(doc.get(w)) for j, w in enumerate(then)}
            k += 2
        elif k + 2 < len(parts):
            out |= dict.fromkeys(range(first, min(then, first + 65535) + 1), float(doc.get(parts[k + 2])))
            k += 3
        else:
            break
    return out


def _stream(doc: Document, ref) -> bytes:
    return doc.stream(int(ref)) if isinstance(ref, Ref) and int(ref) in doc.streams else b""


def font_of(doc: Document, ref) -> Font:
    f = doc.get(ref) or {}
    wide, encoding = f.get("Subtype") == "Type0", doc.get(f.get("Encoding"))
    found, sizes = unicode_map(_stream(doc, f.get("ToUnicode")))
    out = Font(map=found, wide=wide)
    kind = encoding if isinstance(encoding, str) else str(doc.get(encoding.get("BaseEncoding")) or "") if isinstance(encoding, dict) else ""
    out.simple = base_encoding(kind or "WinAnsi")
    if isinstance(encoding, dict) and not wide:
        out.simple |= differences([doc.get(p) for p in doc.get(encoding.get("Differences")) or []])
    if wide:
        own = doc.get((doc.get(f.get("DescendantFonts")) or [None])[0]) or {}
        out.cids, cid_sizes = cid_map(_stream(doc, f.get("Encoding")))
        sizes = sizes | (cid_sizes or {2})
        out.gids = _stream(doc, own.get("CIDToGIDMap"))
        out.embedded = gid_texts(_stream(doc, (doc.get(own.get("FontDescriptor")) or {}).get("FontFile2")))
        out.widths, out.width = cid_widths(doc, doc.get(own.get("W")) or []), float(doc.get(own.get("DW")) or 1000)
    else:
        first = doc.get(f.get("FirstChar")) or 0
        out.widths = {first + k: float(w) for k, w in enumerate(map(doc.get, doc.get(f.get("Widths")) or [])) if isinstance(w, int | float)}
        sizes = sizes | {1}
    out.sizes = tuple(sorted(sizes, reverse=True))
    return out


def fonts(doc: Document, resources) -> dict[str, Font]:
    return {name: font_of(doc, ref) for name, ref in (doc.get((doc.get(resources) or {}).get("Font")) or {}).items()}


# --- what a page shows ----------------------------------------------------------------------------
def times(a, b):
    """The matrix that does ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def string_text(raw: bytes) -> str:
    """A text string: by its byte-order mark, as UTF-8, else in one byte a character, mended where that reads better."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw[2:].decode("utf-16-be" if raw[0] == 0xFE else "utf-16-le", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return repair_mojibake(raw.decode("latin-1"))


def _mended(text: str) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", repair_mojibake(text))
    return re.sub(r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])", "", text)


def clean_text(text: str) -> str:
    """Mended, without control characters, ideographs that were set apart run on."""
    return _mended(text).strip()


class Painter:
    """Follows a page's operators: text with the place it is shown at, and pictures.  Forms are followed inside."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.texts: list[tuple[float, float, str]] = []
        self.pictures: list[tuple[float, float, float, float, int]] = []
        self.known: dict[int, dict[str, Font]] = {}

    def page(self, page: dict) -> Painter:
        contents = page.get("Contents")
        parts = self.doc.get(contents) if isinstance(self.doc.get(contents), list) else [contents]
        self.run(b"\n".join(_stream(self.doc, p) for p in parts), page.get("Resources"), _UNIT, 0)
        return self

    def run(self, body: bytes, resources, matrix, depth: int) -> None:
        doc, own = self.doc, self.doc.get(resources) or {}
        faces = self.known.setdefault(id(own), None) or fonts(doc, own)
        self.known[id(own)] = faces
        objects = doc.get(own.get("XObject")) or {}
        held, ctm = [], matrix
        font, size, leading, apart, gap, across, rise = Font(), 12.0, 0.0, 0.0, 0.0, 1.0, 0.0
        tm = line = _UNIT
        said: list[str | None] = []  # texts that marked content stands for

        def show(raw: bytes) -> None:
            nonlocal tm
            glyphs = font.glyphs(raw)
            text = _mended("".join(t for t, _ in glyphs))
            instead = next((k for k in range(len(said) - 1, -1, -1) if said[k] is not None), None)
            if instead is not None:
                text, said[instead] = clean_text(said[instead]), ""
            if text:
                at = times(tm, ctm)
                self.texts.append((at[5] + rise, at[4], text))
            wide = sum((w / 1000 * size + apart + (gap if t == " " else 0)) * across for t, w in glyphs)
            tm = times((1, 0, 0, 1, wide, 0), tm)

        def move(dx: float, dy: float) -> None:
            nonlocal tm, line
            tm = line = times((1, 0, 0, 1, dx, dy), line)

        stream, stack = tokens(body), []
        while True:
            try:
                t = value(stream)
            except StopIteration:
                return
            if not isinstance(t, Word):
                stack.append(t)
                continue
            a, stack = stack, []
            try:
                if t == "q":
                    held.append((ctm, font, size, leading, apart, gap, across, rise))
                elif t == "Q" and held:
                    ctm, font, size, leading, apart, gap, across, rise = held.pop()
                elif t == "cm":
                    ctm = times(tuple(map(float, a[-6:])), ctm)
                elif t == "BT":
                    tm = line = _UNIT
                elif t == "Tf":
                    font, size = faces.get(a[-2], font), float(a[-1]) or size
                elif t == "TL":
                    leading = float(a[0])
                elif t == "Tc":
                    apart = float(a[0])
                elif t == "Tw":
                    gap = float(a[0])
                elif t == "Tz":
                    across = float(a[0]) / 100
                elif t == "Ts":
                    rise = float(a[0])
                elif t in ("Td", "TD"):
                    leading = -float(a[1]) if t == "TD" else leading
                    move(float(a[0]), float(a[1]))
                elif t == "Tm":
                    tm = line = tuple(map(float, a[-6:]))
                elif t == "T*":
                    move(0, -leading)
                elif t in ("'", '"'):
                    if t == '"':
                        gap, apart = float(a[0]), float(a[1])
                    move(0, -leading)
                    show(a[-1])
                elif t == "Tj":
                    show(a[0])
                elif t == "TJ":
                    for piece in a[0]:
                        if isinstance(piece, bytes):
                            show(piece)
                        else:
                            tm = times((1, 0, 0, 1, -piece / 1000 * size * across, 0), tm)
                elif t in ("BDC", "BMC"):
                    marked = doc.get(a[-1]) if a else None
                    text = marked.get("ActualText") if isinstance(marked, dict) else None
                    said.append(string_text(text) if isinstance(text, bytes) else None)
                elif t == "EMC" and said:
                    said.pop()
                elif t == "Do":
                    self._object(objects.get(a[-1]), own, ctm, depth)
            except (IndexError, TypeError, ValueError, AttributeError):
                continue

    def _object(self, ref, resources, ctm, depth: int) -> None:
        o = self.doc.get(ref) if isinstance(ref, Ref) else None
        if not isinstance(o, dict):
            return
        if o.get("Subtype") == "Image":
            self.pictures.append((ctm[5] + hypot(ctm[2], ctm[3]) / 2, ctm[4], hypot(ctm[0], ctm[1]), hypot(ctm[2], ctm[3]), int(ref)))
        elif o.get("Subtype") == "Form" and depth < 12:
            matrix = tuple(float(self.doc.get(x)) for x in self.doc.get(o.get("Matrix")) or _UNIT)
            self.run(_stream(self.doc, ref), o.get("Resources", resources), times(matrix, ctm), depth + 1)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def picture(doc: Document, number: int) -> tuple[str, bytes] | None:
    """(extension, file) of an image object: JPEG and JPEG 2000 as they are, 8-bit grey and RGB samples as PNG; None for others."""
    o = doc.objects.get(number) or {}
    filters = doc.get(o.get("Filter"))
    last = doc.get(filters[-1]) if isinstance(filters, list) and filters else filters
    if last in ("DCTDecode", "JPXDecode"):
        return ("jpg" if last == "DCTDecode" else "jp2"), doc.streams.get(number, b"")
    width, height, bits = (doc.get(o.get(k)) for k in ("Width", "Height", "BitsPerComponent"))
    channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(doc.get(o.get("ColorSpace")))
    if last != "FlateDecode" or bits not in (8, None) or not channels or not isinstance(width, int) or not isinstance(height, int):
        return None
    data, stride = doc.stream(number), width * channels
    predictor = doc.get((doc.get(o.get("DecodeParms")) or {}).get("Predictor")) or 1
    if predictor < 2:
        data = b"".join(b"\0" + data[k : k + stride] for k in range(0, stride * height, stride))
    if 2 <= predictor < 10 or len(data) < height * (stride + 1):
        return None  # samples foretold in another way than PNG's, or too few
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return "png", b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data[: height * (stride + 1)])) + _chunk(b"IEND", b"")


# --- lines, columns, margins ----------------------------------------------------------------------
def lines(parts: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    """Fragments of one height joined from left to right; each joins the first line it is near."""
    rows: list[list] = []
    for y, x, text in parts:
        row = next((r for r in rows if abs(r[0] - y) <= LINE_HEIGHT), None)
        if row is None:
            rows.append(row := [y, []])
        row[1].append((x, text))
    out = []
    for y, pieces in rows:
        pieces.sort(key=lambda p: p[0])
        out.append((y, pieces[0][0], clean_text("".join(t for _, t in pieces))))
    return by_place([r for r in out if r[2]])


def by_place(rows: list[tuple]) -> list[tuple]:
    """From the top down; what differs in height by 2 at most from left to right."""
    out: list[list] = []
    for row in sorted(rows, key=lambda r: -r[0]):
        if out and out[-1][0][0] - row[0] <= 2:
            out[-1].append(row)
        else:
            out.append([row])
    return [r for band in out for r in sorted(band, key=lambda r: r[1])]


def _cut(xs: list[float]) -> tuple[float, float]:
    """(width, middle) of the widest gap between starts, two at least on its left and three on its right."""
    xs = sorted(xs)
    return max(((b - a, (a + b) / 2) for a, b in zip(xs[1:-3], xs[2:-2], strict=True)), default=(0.0, 0.0))


def in_columns(rows: list[tuple]) -> list[tuple]:
    """Two columns are read one after the other, between what stands across the page's top and bottom.

    It takes a wide gap, columns far apart that overlap in height, and rows that stand side by side;
    indents alone make no columns.
    """
    texts = [r for r in rows if r[2]]
    if len(texts) < 8:
        return by_place(rows)
    high, low = max(r[0] for r in texts), min(r[0] for r in texts)
    #: The least bands, gaps and distances, and their shares of the page.
    band = max(28.0, 0.06 * (high - low))
    middle = [r for r in rows if low + band < r[0] < high - band]
    body = [r for r in middle if r[2]]
    if len(body) < 6:  # a short page: all of it may be columns
        band, middle, body = -1.0, rows, texts
    span = max(1.0, max(r[1] for r in body) - min(r[1] for r in body))
    gap, cut = _cut([r[1] for r in body])
    left, right = [r for r in body if r[1] < cut], [r for r in body if r[1] >= cut]
    if gap < max(72.0, 0.24 * span) or min(len(left), len(right)) < 3 or median(r[1] for r in right) - median(r[1] for r in left) < max(120.0, 0.44 * span):
        return by_place(rows)
    ends = [(min(r[0] for r in c), max(r[0] for r in c)) for c in (left, right)]
    common = min(e[1] for e in ends) - max(e[0] for e in ends)
    near, free, beside = max(4.0, 0.008 * (high - low)), [r[0] for r in right], 0
    for y, *_ in left:
        best = min(free, key=lambda r: abs(r - y), default=None)
        if best is not None and abs(best - y) <= near:
            free.remove(best)
            beside += 1
    if common < COLUMN_OVERLAP * max(1.0, min(b - a for a, b in ends)) or beside < max(2, ceil(COLUMN_ROWS * min(len(left), len(right)))):
        return by_place(rows)
    parts = ([r for r in rows if r[0] >= high - band], [r for r in middle if r[1] < cut], [r for r in middle if r[1] >= cut], [r for r in rows if r[0] <= low + band])
    return [r for part in parts for r in by_place(part)]


#: Words of headers and footers, and how lines begin that are no margin however often they recur.
_MARGIN_WORDS = re.compile("题库|考试|试卷|培训|内部|版权所有|仅供|公司|集团|资料|文档")
_CONTENT = re.compile(r"^(?:\d{1,4}\s*(?:/|[.、．:：)）]|\[)|[A-L]\s*[.、．:：)）]|(?:答案|参考答案|正确答案|标准答案|解析|答案解析)\s*[:：])", re.I)
_PAGE_NUMBER = re.compile(r"^(?:第\s*\d+\s*页(?:\s*/\s*共?\s*\d+\s*页)?|\d+\s*/\s*\d+|[-—–]?\s*\d{1,4}\s*[-—–]?)$")


def margin_sign(text: str) -> str:
    """What the same margin has in common on all pages."""
    text = " ".join(clean_text(text).split())
    return "#" if _PAGE_NUMBER.match(text) else re.sub(r"第\s*\d+\s*页(?:\s*/\s*共?\s*\d+\s*页)?", "第#页", text)


def without_margins(pages: list[list[tuple]]) -> list[list[tuple]]:
    """Page numbers at the edges go, and short texts there like headers that recur on enough pages."""
    edges = []
    for rows in pages:
        ys = [r[0] for r in rows if r[2]]
        band = max(32.0, 0.08 * (max(ys) - min(ys))) if ys else 0.0
        edges.append({id(r): margin_sign(r[2]) for r in rows if r[2] and (r[0] >= max(ys) - band or r[0] <= min(ys) + band)})
    seen = Counter(sign for edge in edges for sign in set(edge.values()))
    least = max(3, ceil(MARGIN_SHARE * len(pages)))
    gone = {s for s, n in seen.items() if s == "#" or n >= least and len(s) <= 60 and not _CONTENT.match(s) and (_MARGIN_WORDS.search(s) or "第#页" in s or not heading(s))}
    return [[r for r in rows if edge.get(id(r)) not in gone] for rows, edge in zip(pages, edges, strict=True)]


def split_options(text: str) -> list[str]:
    """Options that stand one after another in a line, each as a line, if the line begins with the first."""
    marks = [(m[1], m.start(), m.end()) for m in re.finditer(r"([A-L])\s*[.．、:：)）]\s*", text)]
    if len(marks) < 2 or marks[0][1] > 2:
        return [text]
    parts = [(k, text[b:after].strip()) for (k, _, b), after in zip(marks, [*(m[1] for m in marks[1:]), len(text)], strict=True)]
    out = [f"{k}.{t}" for k, t in parts if t]
    return out if len(out) > 1 else [text]


def _page_rows(doc: Document, page: dict) -> tuple[list[tuple], list[tuple]]:
    """(lines, pictures) of a page; where there are columns, fragments far apart at one height are not one line."""
    painter = Painter(doc).page(page)
    parts = painter.texts
    xs = sorted({round(x) for _, x, _ in parts})
    wide = [(b - a, a) for a, b in zip(xs, xs[1:], strict=False)]
    if wide and max(wide)[0] > 120:
        cut = max(wide)[1] + 1
        apart = lines([p for p in parts if p[1] < cut]) + lines([p for p in parts if p[1] >= cut])
        if in_columns(apart) != by_place(apart):
            return apart, painter.pictures
    return lines(parts), painter.pictures


def read(data: bytes) -> tuple[list[dict], dict[str, bytes]]:
    """(paragraphs, pictures by name): lines in reading order over all pages, without margins and tables of contents."""
    doc, pages, files = Document(data), [], {}
    for n, page in enumerate(doc.pages(), 1):
        rows, drawn = _page_rows(doc, page)
        for y, x, _, _, number in drawn:
            if found := picture(doc, number):
                name = f"page_{n:04d}_image_{len(files) + 1:04d}.{found[0]}"
                files[name] = found[1]
                rows.append((y, x, "", name))
        pages.append(rows)
    out = []
    for n, rows in enumerate(without_margins(pages), 1):
        whole = "\n".join(r[2] for r in by_place(rows) if r[2])
        if re.search(r"(?m)^\s*[⽬目]\s*录\s*$", whole) and not re.search(r"(?m)^\s*(?:\d+[.、]|\d+\s*/\s*\d+).*(?:题|答案)", whole):
            continue  # a table of contents
        for row in in_columns(rows):
            texts = split_options(row[2]) if row[2] else [""]
            out += [{"text": t, "images": [row[3]] if not row[2] else [], "page": n, "encoding_warning": "�" in t} for t in texts]
    return [{"index": k, **p} for k, p in enumerate(out)], files


def paragraphs(data: bytes) -> list[dict]:
    return read(data)[0]
