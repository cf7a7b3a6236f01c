"""PDF, Excel 97 and Word 97 files made here, read back."""

import struct
import zlib

import pytest

from lectern.sources import files, legacy, pdf

CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <9898> <0002> <76ee> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"


def make_pdf(pages, packed=False):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"}
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))) + b"] /Resources << /Font << /F1 3 0 R /F2 5 0 R >> >> >>"
    objects[5] = b"<< /Type /Font /Subtype /Type1 >>"
    streams = {4: CMAP}
    for k, content in enumerate(pages):
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        streams[11 + 2 * k] = content
    out = b"%PDF-1.7\n"
    if packed:
        body = b" ".join(objects.values())
        heads, at = [], 0
        for n, o in objects.items():
            heads.append(b"%d %d" % (n, at))
            at += len(o) + 1
        head = b" ".join(heads) + b" "
        z = zlib.compress(head + body)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(objects), len(head), len(z)) + z + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % (n, o) for n, o in objects.items())
    for n, s in streams.items():
        z = zlib.compress(s)
        out += b"%d 0 obj << /Filter /FlateDecode /Length %d >> stream\n" % (n, len(z)) + z + b"\nendstream endobj\n"
    return out + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(packed):
    page = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm <00010002> Tj /F2 12 Tf (\\(1\\) plain) Tj 0 -20 Td [(next) -200 (line)] TJ ET"
    got = [p["text"] for p in pdf.paragraphs(make_pdf([page], packed))]
    assert got == ["题目(1) plain", "nextline"]


def test_pdf_margins_and_columns():
    pages = [b"BT /F2 10 Tf 1 0 0 1 50 780 Tm (Common header) Tj 1 0 0 1 50 700 Tm (%d. Text) Tj 1 0 0 1 50 20 Tm (- %d -) Tj ET" % (k, k) for k in range(1, 5)]
    assert [p["text"] for p in pdf.paragraphs(make_pdf(pages))] == ["1. Text", "2. Text", "3. Text", "4. Text"]
    two = b"BT /F2 10 Tf " + b"".join(b"1 0 0 1 %d %d Tm (%s%d) Tj " % (x, 700 - 20 * k, n, k) for k in range(6) for x, n in ((50, b"L"), (350, b"R"))) + b"ET"
    assert [p["text"] for p in pdf.paragraphs(make_pdf([two]))] == [f"{c}{k}" for c in "LR" for k in range(6)]
    with pytest.raises(ValueError):
        pdf.paragraphs(b"nothing")


def make_compound(streams):
    """A compound file of streams of 4096 bytes or more."""
    sectors, fat, entries = [], [], []

    def put(data):
        first, n = len(sectors), -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    def entry(name, kind, first, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", first, size, 0)

    for name, data in streams.items():
        entries.append(entry(name, 2, put(data.ljust(4096, b"\0")), max(4096, len(data))))
    directory = put(b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *entries]).ljust(512, b"\0"))
    place = len(sectors)
    fat += [0xFFFFFFFD]
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, place)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def record(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def test_xls():
    strings = struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 1) + "题干".encode("utf-16-le") + struct.pack("<HB", 3, 0) + b"abc"
    head = record(0x809, b"\0" * 16)
    sheet = record(0x85, struct.pack("<IBBBB", 0, 0, 0, 2, 0) + b"S1")
    globals_ = head + sheet + record(0xFC, strings) + record(0x0A, b"")
    sheet = record(0x85, struct.pack("<IBBBB", len(globals_), 0, 0, 2, 0) + b"S1")
    globals_ = head + sheet + record(0xFC, strings) + record(0x0A, b"")
    cells = record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2))
    cells += record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, (1234 << 2) | 3, 0, (5 << 2) | 2, 1)) + record(0x205, struct.pack("<HHHBB", 3, 0, 0, 1, 0))
    cells += record(0x06, struct.pack("<HHH", 4, 0, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x207, struct.pack("<HB", 2, 0) + b"ok")
    data = make_compound({"Workbook": globals_ + head + cells + record(0x0A, b"")})
    assert [(c["row"], c["col"], c["value"]) for c in legacy.xls(data)] == [(1, 1, "题干"), (1, 2, "abc"), (2, 1, "2.5"), (2, 2, "7"), (3, 1, "12.34"), (3, 2, "5"), (4, 1, "TRUE"), (5, 1, "ok")]


def test_doc():
    a, b = "1. 题目\r".encode("utf-16-le"), b"answer \x13 code \x14shown\x15\r"
    main = bytearray(b"\0" * 1024)
    struct.pack_into("<H", main, 0, 0xA5EC)
    pieces = struct.pack("<III", 0, len(a) // 2, len(a) // 2 + len(b)) + struct.pack("<HIH", 0, 1024, 0) + struct.pack("<HIH", 0, (1024 + len(a)) * 2 | 0x40000000, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    data = make_compound({"WordDocument": bytes(main) + a + b, "0Table": clx})
    assert legacy.doc(data).split("\n")[:2] == ["1. 题目", "answer shown"]
    assert [p["text"] for p in files.paragraphs_of("doc", data)][:2] == ["1. 题目", "answer shown"]
    with pytest.raises(ValueError):
        legacy.compound(b"no")
