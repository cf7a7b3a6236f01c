"""Files of each format, written here from the rows of a table, so that the readers can be held against the table."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_MC = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_X = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"'
_O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _relations(targets: dict[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in targets.items()) + "</Relationships>"


# --- Word -----------------------------------------------------------------------------------------
def run(text: str, style: str = "") -> str:
    return f"<w:r>{f'<w:rPr>{style}</w:rPr>' if style else ''}<w:t>{escape(text)}</w:t></w:r>"


def p(*runs: str, style: str = "", num: int = 0, level: int = 0) -> str:
    """A paragraph of runs; a text without a mark is a run."""
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(r if r.startswith('<') else run(r) for r in runs)}</w:p>"


def box(*paragraphs: str) -> str:
    """A text box, as a run."""
    return f"<w:r><w:pict><w:txbxContent>{''.join(paragraphs)}</w:txbxContent></w:pict></w:r>"


def either(choice: str, fallback: str) -> str:
    return f"<mc:AlternateContent><mc:Choice>{choice}</mc:Choice><mc:Fallback>{fallback}</mc:Fallback></mc:AlternateContent>"


def picture(relation: str) -> str:
    return f'<w:r><w:drawing><a:blip r:embed="{relation}"/></w:drawing></w:r>'


def table(rows: list[list[str]]) -> str:
    """A table; a cell is a text or paragraphs (and tables)."""
    cells = ["".join(f"<w:tc>{c if c.startswith('<') else p(c)}</w:tc>" for c in row) for row in rows]
    return "<w:tbl>" + "".join(f"<w:tr>{c}</w:tr>" for c in cells) + "</w:tbl>"


def docx(*body: str, images: dict[str, str] | None = None, missing: dict[str, str] | None = None) -> bytes:
    """A Word package; ``images`` are relation -> path of pictures that are there, ``missing`` of ones that are not."""
    parts: dict[str, str | bytes] = {"word/document.xml": f"<w:document {_W} {_R} {_MC} {_A}><w:body>{''.join(b if b.startswith('<') else p(b) for b in body)}</w:body></w:document>"}
    if images or missing:
        parts["word/_rels/document.xml.rels"] = _relations((images or {}) | (missing or {}))
        parts |= {f"word/{t}": b"picture" for t in (images or {}).values()}
    return package(parts)


# --- Excel and OpenDocument -----------------------------------------------------------------------
def _letters(col: int) -> str:
    return (_letters((col - 1) // 26) if col > 26 else "") + chr(65 + (col - 1) % 26)


def xlsx(rows: list[list], hidden: list[list] | None = None, shared: bool = True, anchors: dict[tuple[int, int], str] | None = None, named: dict[str, str] | None = None) -> bytes:
    """A workbook: texts as shared or inline strings, numbers, truth values, ("=", formula) cells; pictures anchored at
    (row, col), and named ones that a formula shows."""
    strings: list[str] = []

    def cell(r: int, c: int, v) -> str:
        at = f'r="{_letters(c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c {at}><v>{v}</v></c>"
        if isinstance(v, tuple):
            return f"<c {at}><f>{escape(v[1])}</f></c>"
        if not shared:
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if v not in strings:
            strings.append(v)
        return f'<c {at} t="s"><v>{strings.index(v)}</v></c>'

    def sheet(data: list[list]) -> str:
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(data, 1))
        return f"<worksheet {_S}><sheetData>{body}</sheetData></worksheet>"

    parts: dict[str, str | bytes] = {
        "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="Questions" r:id="r1"/>' + ('<sheet name="Hidden" state="hidden" r:id="r2"/>' if hidden else "") + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _relations({"r1": "worksheets/one.xml"} | ({"r2": "worksheets/two.xml"} if hidden else {})),
        "xl/worksheets/one.xml": sheet(rows),
    }
    if hidden:
        parts["xl/worksheets/two.xml"] = sheet(hidden)
    if shared:
        parts["xl/sharedStrings.xml"] = f"<sst {_S}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    if anchors:
        parts["xl/worksheets/_rels/one.xml.rels"] = _relations({"d1": "../drawings/d.xml"})
        made = "".join(f"<xdr:oneCellAnchor><xdr:from><xdr:col>{c - 1}</xdr:col><xdr:row>{r - 1}</xdr:row></xdr:from><xdr:pic><a:blip r:embed='i{k}'/></xdr:pic></xdr:oneCellAnchor>" for k, (r, c) in enumerate(anchors))
        parts["xl/drawings/d.xml"] = f"<xdr:wsDr {_X} {_A} {_R}>{made}</xdr:wsDr>"
        parts["xl/drawings/_rels/d.xml.rels"] = _relations({f"i{k}": f"../media/{name}" for k, name in enumerate(anchors.values())})
        parts |= {f"xl/media/{name}": b"picture" for name in anchors.values()}
    if named:
        made = "".join(f'<etc:cellImage><xdr:pic><xdr:cNvPr name="{n}"/><a:blip r:embed="n{k}"/></xdr:pic></etc:cellImage>' for k, n in enumerate(named))
        parts["xl/cellimages.xml"] = f'<etc:cellImages xmlns:etc="etc" {_X} {_A} {_R}>{made}</etc:cellImages>'
        parts["xl/_rels/cellimages.xml.rels"] = _relations({f"n{k}": f"media/{name}" for k, name in enumerate(named.values())})
    return package(parts)


def odt(paragraphs: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(t)}</text:p>" for t in paragraphs)
    return package({"content.xml": f"<office:document-content {_O}>{body}</office:document-content>"})


def ods(rows: list[tuple[list[str], int]], name: str = "Questions") -> bytes:
    """A sheet of (cells, how often the row is repeated); an empty text is a gap."""
    made = "".join(f'<table:table-row table:number-rows-repeated="{n}">' + "".join("<table:table-cell/>" if not c else f"<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>" for c in cells) + "</table:table-row>" for cells, n in rows)
    return package({"content.xml": f'<office:document-content {_O}><table:table table:name="{name}">{made}</table:table></office:document-content>'})


# --- text formats ---------------------------------------------------------------------------------
def rtf(lines: list[str]) -> bytes:
    def coded(text: str) -> str:
        return "".join(c if c.isascii() and c not in "\\{}" else "\\" + c if c in "\\{}" else f"\\u{ord(c) - 65536 if ord(c) > 32767 else ord(c)}?" for c in text)

    return ("{\\rtf1\\ansi\\ansicpg936{\\fonttbl{\\f0 Arial;}}{\\info{\\title hidden}}" + "".join(f"\\pard {coded(line)}\\par " for line in lines) + "}").encode("ascii")


def csv(rows: list[list[str]], delimiter: str = ",") -> str:
    return "\n".join(delimiter.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (delimiter, '"', "\n")) else c for c in row) for row in rows) + "\n"


# --- PDF ------------------------------------------------------------------------------------------
def pdf(pages: list[bytes], fonts: dict[str, bytes] | None = None, streams: dict[int, tuple[bytes, bytes]] | None = None, objects: dict[int, bytes] | None = None, xobjects: dict[str, int] | None = None, packed: bool = False) -> bytes:
    """A PDF of content streams; ``fonts`` are dictionaries by name, ``streams`` (entries, data) by number."""
    fonts = fonts or {"F1": b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"}
    faces = {name: 40 + k for k, name in enumerate(fonts)}
    made = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = b" ".join(b"%d 0 R" % (100 + 2 * k) for k in range(len(pages)))
    resources = b"/Font << " + b" ".join(b"/%s %d 0 R" % (n.encode(), i) for n, i in faces.items()) + b" >>"
    if xobjects:
        resources += b" /XObject << " + b" ".join(b"/%s %d 0 R" % (n.encode(), i) for n, i in xobjects.items()) + b" >>"
    made[2] = b"<< /Type /Pages /Kids [" + kids + b"] /Resources << " + resources + b" >> >>"
    made |= {faces[n]: body for n, body in fonts.items()} | (objects or {})
    made |= {100 + 2 * k: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (101 + 2 * k) for k in range(len(pages))}
    data = {101 + 2 * k: (b"", content) for k, content in enumerate(pages)} | (streams or {})
    out = b"%PDF-1.7\n"
    if packed:
        heads, body = [], b""
        for n, o in made.items():
            heads.append(b"%d %d" % (n, len(body)))
            body += o + b" "
        head = b" ".join(heads) + b" "
        z = zlib.compress(head + body)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(made), len(head), len(z)) + z + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % (n, o) for n, o in made.items())
    for n, (entries, body) in data.items():
        z = body if b"/Filter" in entries else zlib.compress(body)
        kind = entries if b"/Filter" in entries else entries + b" /Filter /FlateDecode"
        out += b"%d 0 obj << %s /Length %d >> stream\n" % (n, kind, len(z)) + z + b"\nendstream endobj\n"
    return out + b"trailer << /Root 1 0 R >>"


def shown(x: float, y: float, text: str | bytes, font: str = "F1", size: int = 10) -> bytes:
    raw = b"<" + text.hex().encode() + b">" if isinstance(text, bytes) else b"(" + text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    return b"BT /%s %d Tf 1 0 0 1 %g %g Tm %s Tj ET " % (font.encode(), size, x, y, raw)


def truetype(codes: dict[int, int], form: int = 4) -> bytes:
    """A font file with nothing but a character table: code -> glyph, in format 4, 6 or 12."""
    items = sorted(codes.items())
    if form == 4:
        n = len(items) + 1
        ends, starts = [c for c, _ in items] + [0xFFFF], [c for c, _ in items] + [0xFFFF]
        deltas = [(g - c) & 0xFFFF for c, g in items] + [1]
        body = struct.pack(f">HHHH{n}HH{n}H{n}H{n}H", n * 2, 0, 0, 0, *ends, 0, *starts, *deltas, *([0] * n))
        table = struct.pack(">HHH", 4, 6 + len(body), 0) + body
    elif form == 6:
        first, last = items[0][0], items[-1][0]
        table = struct.pack(f">HHHHH{last - first + 1}H", 6, 0, 0, first, last - first + 1, *(codes.get(c, 0) for c in range(first, last + 1)))
    else:
        table = struct.pack(">HHIII", 12, 0, 16 + 12 * len(items), 0, len(items)) + b"".join(struct.pack(">III", c, c, g) for c, g in items)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10 if form == 12 else 1, 12) + table
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


# --- compound files -------------------------------------------------------------------------------
def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, each padded to 4096 bytes at least."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first, n = len(sectors), -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    def entry(name: str, kind: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", first, size, 0)

    entries = [entry(name, 2, put(data.ljust(4096, b"\0")), max(4096, len(data))) for name, data in streams.items()]
    directory = put(b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *entries]).ljust(512, b"\0"))
    place, need = len(sectors), 1
    while 128 * need < len(fat) + need:
        need += 1
    fat += [0xFFFFFFFD] * need
    for k in range(need):
        part = fat[128 * k : 128 * (k + 1)]
        sectors.append(struct.pack("<128I", *(part + [0xFFFFFFFF] * (128 - len(part)))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", need, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, place) + b"".join(struct.pack("<I", place + k) for k in range(1, need))
    return head.ljust(512, b"\xff") + b"".join(sectors)


def doc(pieces: list[tuple[str, bool]], table: bool = True) -> bytes:
    """A Word 97 file of pieces (text, whether in one byte a character); without its piece table if asked."""
    main, raw, places, ends = bytearray(1024), b"", [], [0]
    struct.pack_into("<H", main, 0, 0xA5EC)
    for text, small in pieces:
        data = text.encode("cp1252" if small else "utf-16-le")
        places.append((1024 + len(raw)) * 2 | 0x40000000 if small else 1024 + len(raw))
        raw += data
        ends.append(ends[-1] + len(text))
    struct.pack_into("<II", main, 24, 1024, 1024 + len(raw))
    body = struct.pack(f"<{len(ends)}I", *ends) + b"".join(struct.pack("<HIH", 0, at, 0) for at in places)
    clx = b"\x02" + struct.pack("<I", len(body)) + body if table else b""
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(main) + raw, "0Table": clx})


def _record(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def xls(rows: list[list]) -> bytes:
    """An Excel 97 file: texts as shared strings, whole numbers packed, others as doubles, truth values."""
    strings = list(dict.fromkeys(v for row in rows for v in row if isinstance(v, str)))
    shared = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 1) + s.encode("utf-16-le") for s in strings)

    def cell(r: int, c: int, v) -> bytes:
        at = struct.pack("<HHH", r, c, 0)
        if isinstance(v, bool):
            return _record(0x205, at + bytes((v, 0)))
        if isinstance(v, int):
            return _record(0x27E, at + struct.pack("<I", v << 2 | 2))
        if isinstance(v, float):
            return _record(0x203, at + struct.pack("<d", v))
        return _record(0xFD, at + struct.pack("<I", strings.index(v)))

    head = _record(0x809, b"\0" * 16)

    def book(at: int) -> bytes:
        return head + _record(0x85, struct.pack("<IBBBB", at, 0, 0, 9, 0) + b"Questions") + _record(0xFC, shared) + _record(0x0A, b"")

    cells = b"".join(cell(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None)
    return compound({"Workbook": book(len(book(0))) + head + cells + _record(0x0A, b"")})
