"""What the codes of a PDF's fonts mean: Unicode maps, encodings, embedded TrueType tables, widths."""

from __future__ import annotations

import re
import struct
import unicodedata
from dataclasses import dataclass, field

#: Names of glyphs that no rule gives (ASCII signs and common punctuation).
_SIGNS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(),
    " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", strict=True,
)) | dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)) | {
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "degree": "°", "plusminus": "±",
    "multiply": "×", "divide": "÷", "mu": "µ", "Omega": "Ω", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "Euro": "€", "sterling": "£", "section": "§", "periodcentered": "·",
    "guillemotleft": "«", "guillemotright": "»", "fi": "fi", "fl": "fl", "minus": "−", "lessequal": "≤", "greaterequal": "≥", "notequal": "≠", "infinity": "∞", "radical": "√", "dotlessi": "ı", "nbspace": " ",
}
_ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON"}
#: Fixed value: private codes that some exporters give the figures 0 to 9.
_FIGURES = 0xF6B1


def glyph_text(name: str) -> str:
    """The text of a glyph's name, or an empty text."""
    name = name.split(".")[0]
    if name in _SIGNS:
        return _SIGNS[name]
    if re.fullmatch("[A-Za-z]", name):
        return name
    if re.fullmatch("uni(?:[0-9A-Fa-f]{4})+", name):
        return "".join(chr(int(h, 16)) for h in re.findall("....", name[3:]))
    if re.fullmatch("u[0-9A-Fa-f]{4,6}", name) and int(name[1:], 16) < 0x110000:
        return chr(int(name[1:], 16))
    if m := re.fullmatch(f"([A-Za-z])({'|'.join(_ACCENTS)})", name):
        return unicodedata.lookup(f"LATIN {'CAPITAL' if m[1].isupper() else 'SMALL'} LETTER {m[1].upper()} WITH {_ACCENTS[m[2]]}")
    return ""


def base_encoding(name: str) -> dict[int, str]:
    """Code to text of a named single-byte encoding; of an unnamed one only what all share."""
    page = "mac_roman" if "MacRoman" in name else "cp1252"
    codes = range(32, 256) if "WinAnsi" in name or "MacRoman" in name else [*range(32, 127), *range(160, 256)]
    return {c: t for c in codes if c != 127 and (t := bytes([c]).decode(page, "ignore"))}


def differences(parts: list) -> dict[int, str]:
    """Code to text of a list of codes, each followed by the glyphs that go on from there."""
    out, code = {}, None
    for part in parts:
        if isinstance(part, int | float):
            code = int(part)
        elif code is not None:
            if text := glyph_text(str(part)):
                out[code] = text
            code += 1
    return out


def gid_texts(font: bytes) -> dict[int, str]:
    """Glyph number to text by a TrueType font's character table: of several codes of a glyph the least."""

    def u16(at: int) -> int:
        return struct.unpack_from(">H", font, at)[0]

    def u32(at: int) -> int:
        return struct.unpack_from(">I", font, at)[0]

    try:
        base = u32(12) if font[:4] == b"ttcf" else 0
        tables = {font[k : k + 4]: u32(k + 8) for k in range(base + 12, base + 12 + 16 * u16(base + 4), 16)}
        cmap = tables.get(b"cmap")
        if cmap is None:
            return {}
        wanted = {(3, 10): 0, (3, 1): 2, (3, 0): 3}
        kinds = [((u16(k), u16(k + 2)), cmap + u32(k + 4)) for k in range(cmap + 4, cmap + 4 + 8 * u16(cmap + 2), 8)]
        for _, at in sorted(kinds, key=lambda t: (wanted.get(t[0], 1 if t[0][0] == 0 else 9), t[1])):
            if pairs := list(_pairs(font, at, u16, u32)):
                out: dict[int, str] = {}
                for gid, code in sorted(pairs, key=lambda p: p[1]):
                    if gid and 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
                        out.setdefault(gid, chr(code))
                return out
    except struct.error:
        pass
    return {}


def _pairs(font: bytes, at: int, u16, u32):
    """(glyph, code) of a subtable of format 4, 6 or 12."""
    form = u16(at)
    if form == 4:
        n = u16(at + 6) // 2
        ends, starts, deltas, offsets = (at + 14 + k * 2 * n + (2 if k else 0) for k in range(4))
        for s in range(n):
            first, last, delta, offset = u16(starts + 2 * s), u16(ends + 2 * s), u16(deltas + 2 * s), u16(offsets + 2 * s)
            for code in range(first, min(last, 0xFFFE) + 1):
                place = offsets + 2 * s + offset + 2 * (code - first)
                glyph = code if not offset else u16(place) if place + 2 <= len(font) else 0
                yield (glyph + delta) & 0xFFFF if glyph or not offset else 0, code
    elif form == 6:
        first = u16(at + 6)
        yield from ((u16(at + 10 + 2 * k), first + k) for k in range(u16(at + 8)))
    elif form == 12:
        for k in range(at + 16, at + 16 + 12 * min(u32(at + 12), 65536), 12):
            first, last, glyph = u32(k), u32(k + 4), u32(k + 8)
            yield from ((glyph + code - first, code) for code in range(first, min(last, first + 0xFFFF, 0x10FFFF) + 1))


def plausible(code: int) -> bool:
    """Whether a two-byte code without a map may be the character itself: ASCII and what Chinese texts use."""
    return any(a <= code <= b for a, b in ((0x20, 0x7E), (0x3000, 0x303F), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFFEF)))


@dataclass
class Font:
    map: dict[bytes, str] = field(default_factory=dict)
    sizes: tuple[int, ...] = (1,)
    wide: bool = False
    simple: dict[int, str] = field(default_factory=lambda: base_encoding("WinAnsi"))
    cids: dict[bytes, int] = field(default_factory=dict)
    gids: bytes = b""
    embedded: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    width: float = 500.0

    def _one(self, raw: bytes) -> str | None:
        """The text of one code: by the font's own map, its embedded table, its encoding, or as the character itself."""
        if raw in self.map:
            return self.map[raw]
        code = int.from_bytes(raw)
        if self.embedded:
            cid = self.cids.get(raw, code)
            gid = int.from_bytes(self.gids[2 * cid : 2 * cid + 2]) if 2 * cid + 2 <= len(self.gids) else cid
            text = self.embedded.get(gid, "")
            if text and not "" <= text <= "":
                return text
        if len(raw) == 1 and not self.wide:
            return self.simple.get(code)
        if len(raw) == 2 and self.wide:
            if _FIGURES <= code < _FIGURES + 10:
                return str(code - _FIGURES)
            if plausible(code):
                return chr(code)
        return None

    def glyphs(self, raw: bytes) -> list[tuple[str, float]]:
        """(text, width in thousandths) of each code; a code that means nothing is one replacement character."""
        out, at = [], 0
        while at < len(raw):
            for n in self.sizes:
                if at + n <= len(raw) and (text := self._one(raw[at : at + n])) is not None:
                    break
            else:
                n, byte = (2 if self.wide and at + 2 <= len(raw) else 1), raw[at]
                text = "�" if self.wide or byte < 9 or 13 < byte < 32 else bytes([byte]).decode("cp1252", "replace")
            code = int.from_bytes(raw[at : at + n])
            out.append((text, self.widths.get(self.cids.get(raw[at : at + n], code), self.width)))
            at += n
        return out

    def decode(self, raw: bytes) -> str:
        return "".join(t for t, _ in self.glyphs(raw))
