"""Compound files of older office programs: streams, Excel 97 cells, Word 97 text."""

from __future__ import annotations

import re
import struct

from lectern.functions.lines import MOJIBAKE

_FREE = 0xFFFFFFFA


def compound(data: bytes) -> dict[str, bytes]:
    """Named streams of a compound file: allocation chains in large and small sectors."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    root_at, cutoff, small_at = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    more_at = struct.unpack_from("<I", data, 68)[0]
    size = 1 << shift
    if shift not in (9, 12):
        raise ValueError("odd sector size")

    def sector(k: int) -> bytes:
        return data[512 + k * size : 512 + (k + 1) * size] if shift == 9 else data[(k + 1) * size : (k + 2) * size]

    places = [p for p in struct.unpack_from("<109I", data, 76) if p < _FREE]
    hops = 0
    while more_at < _FREE and hops < 100_000:
        block = struct.unpack(f"<{size // 4}I", sector(more_at).ljust(size, b"\xff"))
        places += [p for p in block[:-1] if p < _FREE]
        more_at, hops = block[-1], hops + 1
    table = [x for p in places for x in struct.unpack(f"<{size // 4}I", sector(p).ljust(size, b"\xff"))]

    def chain(first: int, fat, read) -> bytes:
        out, k, seen = [], first, set()
        while k < _FREE and k < len(fat) and k not in seen:
            seen.add(k)
            out.append(read(k))
            k = fat[k]
        return b"".join(out)

    directory = chain(root_at, table, sector)
    entries = [directory[k : k + 128] for k in range(0, len(directory) - 127, 128)]
    raw = chain(small_at, table, sector)
    small = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    mini, out = b"", {}
    for e in entries:
        n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
        name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
        first, length = struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]
        if kind == 5:
            mini = chain(first, table, sector)[:length]
        elif kind == 2:
            if length < cutoff:
                out[name] = chain(first, small, lambda k: mini[k << small_shift : (k + 1) << small_shift])[:length]
            else:
                out[name] = chain(first, table, sector)[:length]
    return out


def _number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def rk(v: int) -> float:
    """A number in 30 bits: an integer or the head of a double, maybe in hundredths."""
    x = float((v ^ 0x80000000) - 0x80000000 >> 2 if v & 0x80000000 else v >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


class _Strings:
    """Shared strings, which run over from record to record; a run may change its width there."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 8

    def _take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n]
            out += piece
            self.at += len(piece)
            n -= len(piece)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def next(self) -> str:
        if self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        n, flags = struct.unpack("<HB", self._take(3))
        runs = struct.unpack("<H", self._take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self._take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n > 0 and self.k < len(self.parts):
            room = (len(self.parts[self.k]) - self.at) // (2 if wide else 1)
            m = min(n, room)
            raw = self._take(m * (2 if wide else 1))
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= m
            if n:
                self.k, self.at = self.k + 1, 0
                if self.k < len(self.parts):
                    wide, self.at = self.parts[self.k][0] & 1, 1
        self._take(4 * runs + extra)
        return "".join(out)


def _text(d: bytes, at: int) -> str:
    n, flags = struct.unpack_from("<HB", d, at)
    return d[at + 3 : at + 3 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def xls(data: bytes) -> list[dict]:
    """Cells of visible sheets of an Excel 97 workbook, as the newer format's reader gives them."""
    streams = compound(data)
    book = streams.get("Workbook") or streams.get("Book")
    if book is None:
        raise ValueError("no workbook")
    records, at = [], 0
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        records.append((at, kind, book[at + 4 : at + 4 + n]))
        at += 4 + n
    sheets, shared = {}, []
    for k, (_, kind, d) in enumerate(records):
        if kind == 0x85:
            place, hidden, n, wide = *struct.unpack_from("<IB", d), d[6], d[7]
            if not hidden & 3:
                sheets[place] = d[8 : 8 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
        elif kind == 0xFC:
            parts = [d]
            for _, more, e in records[k + 1 :]:
                if more != 0x3C:
                    break
                parts.append(e)
            reader = _Strings(parts)
            try:
                shared = [reader.next() for _ in range(struct.unpack_from("<I", d, 4)[0])]
            except struct.error:
                pass
    out, sheet, pending = [], None, None

    def add(row: int, col: int, value: str, formula: str | None = None) -> None:
        if sheet is not None and value != "":
            out.append({"sheet": sheet, "row": row + 1, "col": col + 1, "value": value, "formula": formula})

    for place, kind, d in records:
        if kind == 0x809:
            sheet = sheets.get(place)
        elif kind == 0xFD:
            r, c, _, i = struct.unpack_from("<HHHI", d)
            add(r, c, shared[i] if i < len(shared) else "")
        elif kind == 0x204:
            add(*struct.unpack_from("<HH", d), _text(d, 6))
        elif kind == 0x203:
            add(*struct.unpack_from("<HH", d), _number(struct.unpack_from("<d", d, 6)[0]))
        elif kind == 0x27E:
            add(*struct.unpack_from("<HH", d), _number(rk(struct.unpack_from("<I", d, 6)[0])))
        elif kind == 0xBD:
            r, c = struct.unpack_from("<HH", d)
            for k in range((len(d) - 6) // 6):
                add(r, c + k, _number(rk(struct.unpack_from("<I", d, 6 + 6 * k)[0])))
        elif kind == 0x205:
            add(*struct.unpack_from("<HH", d), ("#ERR" if d[7] else "TRUE" if d[6] else "FALSE"))
        elif kind == 0x06:
            r, c = struct.unpack_from("<HH", d)
            if d[12:14] == b"\xff\xff":
                pending = (r, c) if d[6] == 0 else None
                if d[6] == 1:
                    add(r, c, "TRUE" if d[8] else "FALSE", "")
            else:
                add(r, c, _number(struct.unpack_from("<d", d, 6)[0]), "")
        elif kind == 0x207 and pending:
            add(*pending, _text(d, 0), "")
            pending = None
    return out


_CONTROLS = {1: "【图片】", 7: "\t", 11: "\n", 12: "\n", 13: "\n", 30: "-", 31: "", 160: " "}
#: What characters speak for or against a reading of bytes as text.
_POINTS = ((re.compile("[ -~　-鿿豈-﫿]"), 1), (re.compile("[㐀-鿿]"), 3), (re.compile("�"), -120), (re.compile("[\x00-\x08\x0e-\x1f]"), -40), (re.compile(MOJIBAKE), -20))


def text_quality(text: str) -> int:
    return sum(points * len(p.findall(text)) for p, points in _POINTS) if text else -100_000


def best_reading(data: bytes, *encodings: str) -> str:
    """Bytes as strict UTF-8, else as the encoding that reads best; the first of equals."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return max((data.decode(e, "replace") for e in encodings or ("gb18030", "cp1252")), key=text_quality)


def without_controls(text: str) -> str:
    """Word's control characters as text: cells end in tabs, rows and pages in line ends; pictures are named, fields keep their results."""
    text = re.sub("\x13[^\x14\x15]*\x14?", "", text).replace("\x15", "")
    return re.sub("\n{4,}", "\n\n\n", re.sub("[\x00-\x08\x0e-\x1f]", "", text.translate(_CONTROLS)))


def _pieces(main: bytes, streams: dict[str, bytes]) -> str | None:
    """The text by the piece table, or None without one."""
    table = streams.get("1Table" if struct.unpack_from("<H", main, 10)[0] & 0x200 else "0Table", b"")
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, k, pieces = table[at : at + size], 0, b""
    while k + 5 <= len(clx) and clx[k] in (1, 2):
        if clx[k] == 2:
            pieces = clx[k + 5 : k + 5 + struct.unpack_from("<I", clx, k + 1)[0]]
            break
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    count = (len(pieces) - 4) // 12
    if count < 1:
        return None
    ends, out = struct.unpack_from(f"<{count + 1}I", pieces), []
    for k in range(count):
        place, n = struct.unpack_from("<I", pieces, 4 * (count + 1) + 8 * k + 2)[0], ends[k + 1] - ends[k]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(main[start : start + n].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * n].decode("utf-16-le", "replace"))
    return "".join(out)


def doc(data: bytes) -> str:
    """Text of a Word 97 document by its piece table; without one, the stream's text in the encoding that reads best."""
    streams = compound(data)
    main = streams.get("WordDocument", b"")
    if len(main) < 0x1AA or struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ValueError("no Word document")
    text = _pieces(main, streams)
    if text is None or not text.strip():
        first, last = struct.unpack_from("<II", main, 24)
        raw = main[first:last] if 0 < first < last <= len(main) else main
        text = max((raw.decode("utf-16-le", "replace"), best_reading(raw)), key=text_quality)
    return without_controls(text)
