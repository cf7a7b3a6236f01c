"""Office packages (zip with XML): Word paragraphs, Excel cells, OpenDocument text and sheets."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_B = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_A, _M, _V = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/math}", "{urn:schemas-microsoft-com:vml}"
_X = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
#: What one part may unpack to; a package that claims more is hostile.
MOST_BYTES = 512 << 20
#: How many copies of a repeated row or cell an OpenDocument sheet may ask for.
REPEAT_ROWS, REPEAT_CELLS = 5000, 200


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str):
        if name not in self.names or self.zip.getinfo(name).file_size > MOST_BYTES:
            return None
        return ElementTree.fromstring(self.zip.read(name))

    def relations(self, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        found = {} if root is None else {r.get("Id"): r.get("Target", "") for r in root if r.get("TargetMode") != "External"}
        return {k: v.lstrip("/") if v.startswith("/") else posixpath.normpath(posixpath.join(folder, v)) for k, v in found.items()}


def _dropped(node) -> bool:
    """Deleted and moved text, field codes, hidden runs."""
    if node.tag in (_W + "del", _W + "moveFrom", _W + "instrText"):
        return True
    return node.tag == _W + "r" and any(node.find(f"{_W}rPr/{_W}{name}") is not None for name in ("vanish", "webHidden"))


def branch_quality(text: str) -> int:
    """How much a branch of alternative content says: its text, its different lines, marks of options; repeated lines count against it."""
    if not text.strip():
        return -100_000
    rows = [re.sub(r"\s+", "", line).lower() for line in text.split("\n") if line.strip()]
    again = sum(a == b for a, b in zip(rows, rows[1:], strict=False))
    marks = sum(bool(re.search(rf"\b{key}\s*[.、．:：)）]", text)) for key in "ABCD")
    #: What a different line, a repeated one and a mark weigh beside a character.
    return min(len(text), 2000) + 80 * len(set(rows)) - 240 * again + 25 * marks


def chosen_branch(node):
    """Of alternative content the branch that says most; the first of equals."""
    branches = [b for b in node if b.tag in (_MC + "Choice", _MC + "Fallback")]
    return max(branches, key=lambda b: branch_quality(_visible(b)), default=None)


def _visible(node, boxes: bool = True) -> str:
    """Text of a node that a reader sees; without text boxes' text, if asked."""
    if _dropped(node) or not boxes and node.tag == _W + "txbxContent":
        return ""
    if node.tag == _MC + "AlternateContent":
        branch = chosen_branch(node)
        return "" if branch is None else _visible(branch, boxes)
    if node.tag == _W + "t":
        return node.text or ""
    if node.tag == _W + "tab":
        return "\t"
    if node.tag in (_W + "br", _W + "cr"):
        return "\n"
    return "".join(_visible(child, boxes) for child in node)


def _boxed(node, found: list) -> list:
    """The paragraphs of text boxes inside a paragraph, each once: of alternative content one branch."""
    if node.tag == _MC + "AlternateContent":
        branch = chosen_branch(node)
        return found if branch is None else _boxed(branch, found)
    for child in node:
        if _dropped(child):
            continue
        if child.tag == _W + "txbxContent":
            found += [p for p in child.iter(_W + "p")]
        else:
            _boxed(child, found)
    return found


def _alternatives(p, text: str) -> list[str]:
    """What else a paragraph might say: each branch of its alternative content, and text drawn in its pictures."""
    found = [_visible(branch) for block in p.iter(_MC + "AlternateContent") for branch in block]
    found += [t.text or "" for t in p.iter() if t.tag in (_A + "t", _M + "t")]
    found += [t.get("string", "") for t in p.iter(_V + "textpath")]
    return [x for x in dict.fromkeys(v.strip() for v in found) if x and x != text.strip()]


def _marked(p) -> tuple[list[str], list[str]]:
    """Texts of runs that stand out as answers: underlined, highlighted, shaded or reddish (strong); bold ones beside
    enough plain text (weak)."""
    strong, weak, plain = [], [], 0
    for run in p.iter(_W + "r"):
        text, style = _visible(run), run.find(_W + "rPr")
        if not text.strip():
            continue

        def of(name: str, style=style) -> str | None:
            found = None if style is None else style.find(_W + name)
            return None if found is None else found.get(_W + "val") or found.get(_W + "fill") or ""

        value, line, light, shade, bold = of("color") or "", of("u"), of("highlight"), of("shd"), of("b")
        r, g, b = (int(value[k : k + 2], 16) for k in (0, 2, 4)) if re.fullmatch("[0-9a-fA-F]{6}", value) else (0, 0, 0)
        #: How red a red is.
        red = r >= 150 and r >= 1.35 * g and r >= 1.35 * b
        shaded = shade is not None and re.fullmatch("[0-9a-fA-F]{6}", shade) and shade.upper() != "FFFFFF"
        if red or light not in (None, "none", "auto") or shaded or line not in (None, "none", "0"):
            strong.append(text)
        elif bold not in (None, "false", "0", "off"):
            weak.append(text)
        else:
            plain += len(text)
    return list(dict.fromkeys(strong)), list(dict.fromkeys(weak)) if plain >= 4 and sum(map(len, weak)) <= max(80, plain) else []


def option_of(text: str) -> tuple[str, str, str] | None:
    """(key, body, signature) of a line that is an option."""
    m = re.match(r"^([A-L])\s*(?:[.、．:：)）]\s*|\s+)(.+)$", " ".join(text.split()), re.I)
    return (m[1].upper(), m[2].strip(), re.sub(r"[\s，。；、,.!！?？:：()（）\[\]【】]", "", m[2]).lower()) if m else None


def without_overlays(rows: list[dict]) -> list[dict]:
    """Options that repeat the one before, mended by what covers them on the page.

    A converter may keep a wrong text under a visible one, which is an alternative of the same
    paragraph, a later line with the same key, or a text box near by; a line that is used so goes.
    """
    gone = set()
    for k, p in enumerate(rows):
        before, own = option_of(rows[k - 1]["text"]) if k else None, option_of(p["text"])
        if k in gone or not before or not own or ord(own[0]) != ord(before[0]) + 1 or not own[2] or own[2] != before[2]:
            continue

        def body(text: str, key=own[0], other=own[2], named: bool = False) -> str:
            """What a text says under the key, if it differs from what is there."""
            found = option_of(text)
            if found and found[0] == key:
                says = found[1]
            elif named or found:
                return ""
            else:
                says = text.strip()
            sign = re.sub(r"[\s，。；、,.!！?？:：()（）\[\]【】]", "", says).lower()
            return says if sign and sign != other and len(says) <= 500 else ""

        said = next((x for named in (True, False) for a in p.get("alternatives", ()) if (x := body(a, named=named))), "")
        for j in range(k + 1, min(len(rows), k + 5)) if not said else ():
            if re.match(r"^\s*(?:(?:答案|参考答案|解析|正确答案)\s*[:：]|\d{1,4}\s*[.、．)）])", rows[j]["text"]):
                break
            if said := body(rows[j]["text"], named=not rows[j].get("boxed")):
                gone.add(j)
                break
        if said:
            p["text"] = f"{own[0]}. {said}"
    return [p for k, p in enumerate(rows) if k not in gone]


_PICTURE = re.compile(r"\.(png|jpe?g|gif|bmp|tiff?|emf|wmf)$", re.I)


def _walked(package: Package) -> list[dict]:
    """Paragraphs in document order, with list level, style, images, and the innermost table cell they stand in."""
    root, relations = package.xml("word/document.xml"), package.relations("word/document.xml")
    out: list[dict] = []
    tables = 0

    def pictures(nodes) -> list[str]:
        found = [relations.get(i, "") for b in nodes if (i := b.get(_R + "embed") or b.get(_R + "link") or b.get(_R + "id"))]
        return [t for t in dict.fromkeys(found) if _PICTURE.search(t) and t in package.names]

    def paragraph(p, cell, boxed: bool, text: str, images: list[str]):
        style, num, level = (p.find(f"{_W}pPr/{_W}{path}") for path in ("pStyle", f"numPr/{_W}numId", f"numPr/{_W}ilvl"))
        strong, weak = _marked(p)
        if text.strip() or images:
            out.append({
                "text": text, "style": style.get(_W + "val") if style is not None else None, "num_id": num.get(_W + "val") if num is not None else None, "level": int(level.get(_W + "val")) if level is not None else None,
                "images": images, "strong": strong, "weak": weak, "table_id": cell[0], "table_row": cell[1], "table_col": cell[2], "boxed": boxed, "alternatives": _alternatives(p, text),
            })

    def walk(node, cell):
        nonlocal tables
        for child in node:
            if child.tag == _W + "p":
                boxes = _boxed(child, [])
                inside = {id(b) for box in boxes for b in box.iter()}
                paragraph(child, cell, False, _visible(child, boxes=False), pictures(b for b in child.iter() if id(b) not in inside))
                for box in boxes:
                    paragraph(box, cell, True, _visible(box), pictures(box.iter()))
            elif child.tag == _W + "tbl":
                tables += 1
                own = tables
                for r, row in enumerate(child.findall(_W + "tr")):  # a table inside a cell is a table of its own
                    for c, td in enumerate(row.findall(_W + "tc")):
                        walk(td, (own, r, c))
            elif child.tag == _MC + "AlternateContent":
                if (branch := chosen_branch(child)) is not None:
                    walk(branch, cell)
            elif child.tag in (_W + "sdt", _W + "sdtContent", _W + "body", _W + "ins", _W + "smartTag", _W + "customXml"):
                walk(child, cell)

    if root is not None:
        walk(root.find(_W + "body"), (None, None, None))
    return out


def docx(data: bytes) -> list[dict]:
    """Paragraphs of a Word package: what covers a repeated option stands in its place, list items have their ordinal."""
    out = without_overlays(_walked(Package(data)))
    ordinals: dict[tuple, int] = {}
    for k, p in enumerate(out):
        p["index"] = k
        key = (p["num_id"], p["level"])
        if p["num_id"] and p["num_id"] != "0":
            ordinals[key] = ordinals.get(key, 0) + 1
        p["list_ordinal"] = ordinals.get(key)
    return out


def docx_cells(rows: list[dict]) -> list[dict]:
    """Cells of the tables in a Word package's paragraphs as :func:`xlsx` gives cells, one sheet a table, with their images."""
    out: dict[tuple, dict] = {}
    for p in rows:
        if p["table_id"]:
            at = (p["table_id"], p["table_row"] + 1, p["table_col"] + 1)
            cell = out.setdefault(at, {"sheet": f"Word表格{at[0]}", "row": at[1], "col": at[2], "value": "", "formula": None, "images": []})
            cell["value"] = " ".join(x for x in (cell["value"], " ".join(p["text"].split())) if x)
            cell["images"] += p["images"]
    return list(out.values())


#: Labels of the left column of a table that is one question.
_LABELS = ("题目", "题干", "问题", "答案", "正确答案", "标准答案", "参考答案", "解析", "答案解析", "难度", "分类", "知识点", "考点", "题型", *"ABCDEFGH")


def labelled_rows(rows: list[dict]) -> tuple[list[dict], set[int]]:
    """(rows, tables used): in tables whose left column labels what stands beside it, or numbers it, at least twice, a
    row of cells is one line ("答案：B", "A. x", "1. y"); other rows stay."""
    tables: dict[int, dict[int, list[dict]]] = {}
    for p in rows:
        if p["table_id"]:
            tables.setdefault(p["table_id"], {}).setdefault(p["table_row"], []).append(p)
    lines, used = {}, set()
    for table, by_row in tables.items():
        made, known = {}, 0
        for r, cells in by_row.items():
            columns: dict[int, str] = {}
            for p in cells:
                columns[p["table_col"]] = " ".join(x for x in (columns.get(p["table_col"], ""), " ".join(p["text"].split())) if x)
            first, rest = columns.get(0, ""), " ".join(t for c, t in sorted(columns.items()) if c and t)
            mark = f"{first}. " if re.fullmatch(r"[A-H]|\d{1,4}", first) else f"{first}：" if first in _LABELS else None
            known += bool(mark and rest)
            made[r] = cells[0] | {"text": f"{mark}{rest}" if mark and rest else " ".join(x for x in (first, rest) if x), "images": [i for p in cells for i in p["images"]]}
        if known >= 2:
            used.add(table)
            lines |= {id(by_row[r][0]): made[r] for r in by_row}
    return [lines.get(id(p), p) for p in rows if p["table_id"] not in used or id(p) in lines], used


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference.upper())[0]:
        n = 26 * n + ord(c) - 64
    return n


def _placed(package: Package, part: str) -> dict[tuple[int, int], list[str]]:
    """(row, col) of a sheet -> pictures anchored there."""
    out: dict[tuple[int, int], list[str]] = {}
    for drawing in package.relations(part).values():
        root = package.xml(drawing) if "/drawings/" in f"/{drawing}" and drawing.endswith(".xml") else None
        relations = package.relations(drawing) if root is not None else {}
        for anchor in root if root is not None else ():
            row, col = (anchor.find(f"{_X}from/{_X}{name}") for name in ("row", "col"))
            for blip in anchor.iter(_A + "blip") if row is not None and col is not None else ():
                if (target := relations.get(blip.get(_R + "embed"))) and target in package.names:
                    out.setdefault((int(row.text) + 1, int(col.text) + 1), []).append(target)
    return out


def _named_pictures(package: Package) -> dict[str, str]:
    """name -> picture of those that a cell shows by a formula."""
    root, relations = package.xml("xl/cellimages.xml"), package.relations("xl/cellimages.xml")
    out = {}
    for one in root if root is not None else ():
        name, blip = next(one.iter(_X + "cNvPr"), None), next(one.iter(_A + "blip"), None)
        if name is not None and blip is not None and blip.get(_R + "embed") in relations:
            out[name.get("name")] = relations[blip.get(_R + "embed")]
    return out


def xlsx(data: bytes) -> list[dict]:
    """Cells of visible sheets: (sheet, row, col, value, formula, images), values as text.

    A cell's images are those anchored at it and the one that its formula names; a cell may hold nothing else.
    """
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        return []
    relations = package.relations("xl/workbook.xml")
    root = package.xml("xl/sharedStrings.xml")
    shared = [] if root is None else ["".join(t.text or "" for t in si.iter(_S + "t")) for si in root.findall(_S + "si")]
    named = _named_pictures(package)
    out = []
    for sheet in book.iter(_S + "sheet"):
        if sheet.get("state") in ("hidden", "veryHidden"):
            continue
        path = relations.get(sheet.get(_R + "id"), "")
        part, placed = package.xml(path), _placed(package, path)
        for r, row in enumerate(part.iter(_S + "row") if part is not None else (), 1):
            number = int(row.get("r", r))
            for k, c in enumerate(row.findall(_S + "c"), 1):
                v, f = c.find(_S + "v"), c.find(_S + "f")
                raw, kind, col = v.text or "" if v is not None else "", c.get("t"), _column(c.get("r", "")) or k
                if kind == "s" and raw.isdigit() and int(raw) < len(shared):
                    value = shared[int(raw)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(_S + "t"))
                elif kind == "b":
                    value = "TRUE" if raw == "1" else "FALSE"
                else:
                    value = raw
                formula = f.text if f is not None else None
                shown = re.search(r"DISPIMG\s*\(\s*[\"']([^\"']+)[\"']", formula or "", re.I)
                images = placed.pop((number, col), []) + ([named[shown[1]]] if shown and shown[1] in named else [])
                if value or f is not None or images:
                    out.append({"sheet": sheet.get("name"), "row": number, "col": col, "value": value, "formula": formula, "images": list(dict.fromkeys(images))})
        out += [{"sheet": sheet.get("name"), "row": r, "col": c, "value": "", "formula": None, "images": list(dict.fromkeys(i))} for (r, c), i in sorted(placed.items())]
    return out


def raw_row(cells: list[dict], headers: dict[int, str]) -> list[str]:
    """A row's non-empty cells as "header：value", in order of columns; a column without header by its number."""
    return [f"{headers.get(c['col']) or '第%d列' % c['col']}：{c['value'] or c['formula']}" for c in sorted(cells, key=lambda c: c["col"]) if c["value"] or c["formula"]]


def _odf_text(node) -> str:
    out = [node.text or ""]
    for child in node:
        if child.tag == _T + "s":
            out.append(" " * int(child.get(_T + "c", 1)))
        elif child.tag == _T + "tab":
            out.append("\t")
        elif child.tag == _T + "line-break":
            out.append("\n")
        elif child.tag not in (_T + "tracked-changes", _T + "note"):
            out.append(_odf_text(child))
        out.append(child.tail or "")
    return "".join(out)


def odt(data: bytes) -> list[str]:
    root = Package(data).xml("content.xml")
    return [] if root is None else [t for n in root.iter() if n.tag in (_T + "p", _T + "h") and (t := _odf_text(n)).strip()]


def ods(data: bytes) -> list[dict]:
    """Cells as :func:`xlsx` gives them; repeated rows and cells are written out, within the caps."""
    root = Package(data).xml("content.xml")
    out = []
    for sheet in root.iter(_B + "table") if root is not None else ():
        number = 0
        for row in sheet.iter(_B + "table-row"):
            cells, col = [], 0
            for c in row:
                if c.tag not in (_B + "table-cell", _B + "covered-table-cell"):
                    continue
                text = "\n".join(_odf_text(p) for p in c.findall(_T + "p"))
                times = int(c.get(_B + "number-columns-repeated", 1))
                if text:
                    cells += [(col + k + 1, text) for k in range(min(times, REPEAT_CELLS))]
                col += times
            times = int(row.get(_B + "number-rows-repeated", 1))
            for k in range(min(times, REPEAT_ROWS) if cells else 0):
                out += [{"sheet": sheet.get(_B + "name"), "row": number + k + 1, "col": c, "value": t, "formula": None} for c, t in cells]
            number += times
    return out
