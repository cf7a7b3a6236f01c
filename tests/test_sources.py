import io
import zipfile

import pytest

from lectern.operators import parser, tabular
from lectern.operators.storage import Store
from lectern.sources import archive, files, office, texts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*paragraphs):
    body = "".join(p if p.startswith("<") else f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx(rows, state=""):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
    return package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>",
    })


def test_docx_parts():
    got = office.docx(docx(
        "one", "<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>no</w:t></w:r><w:del><w:r><w:t>no</w:t></w:r></w:del><w:r><w:t>yes</w:t></w:r></w:p>",
        '<w:p><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t>red</w:t></w:r></w:p>',
        "<w:p><mc:AlternateContent><mc:Choice/><mc:Fallback><w:r><w:t>fall</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>",
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>i</w:t></w:r></w:p>',
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    ))
    assert [p["text"] for p in got] == ["one", "yes", "red", "fall", "i", "a", "b"]
    assert got[2]["strong"] == ["red"] and got[4]["list_ordinal"] == 1 and (got[6]["table_row"], got[6]["table_col"]) == (0, 1)


def test_text_kinds():
    assert texts.decode_auto("中文 text".encode("gb18030")) == "中文 text"
    assert texts.decode_auto(b"\xff\xfe" + "ä".encode("utf-16-le")) == "ä"
    assert texts.sniff_delimiter("a;b;c\n1;2;3\n") == ";" and texts.sniff_delimiter("plain") == ","
    assert texts.table('a,"b,""c"""\n1,2\n') == [["a", 'b,"c"'], ["1", "2"]]
    assert texts.html_blocks("<p>a&amp;b</p><script>x</script><table><tr><td>1</td><th>2</th></tr></table>")[1] == [["1", "2"]]
    assert texts.markdown_plain("# T\n- item **b** [l](u) ![i](p)") == "T\nitem b l i【图片】"
    rtf = rb"{\rtf1\ansi\ansicpg936{\fonttbl{\f0 Arial;}}\f0 1. " + b"\\" + rb"u39064? \'cc\'e2\par A\\B\par}"
    assert texts.rtf_text(rtf).strip() == "1. 题 题\nA\\B"


@pytest.mark.parametrize("text", ["Das\nist für Sie\n" * 9, "ab the\nthe\nthe", "ab" + " the\nthe" * 60, "broken � mark", "private \ue123\ue124 use", "한국어 텍스트", "国語の対応", "繁體中文題目", "🙂🙃", "Привет, мир", "na\u0001me", ""])
def test_texts_come_back_from_gb18030(text):
    for more in ("", "x", "\ncafé"):
        assert texts.decode_auto((text + more + " 中文题目，答案如下。").encode("gb18030")) == text + more + " 中文题目，答案如下。"


def test_encodings_without_marks():
    assert [texts.decode_auto("café, naïve – “Müller” don’t".encode("cp1252")), texts.decode_auto("中文题目，答案如下。".encode("utf-16-le")), texts.decode_auto("繁體中文題目\n答案".encode("utf-16-be"))] == ["café, naïve – “Müller” don’t", "中文题目，答案如下。", "繁體中文題目\n答案"]


def test_opendocument():
    content = f'<office:document-content {O}><text:p>a<text:s text:c="2"/>b</text:p><table:table table:name="T"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell></table:table-row></table:table></office:document-content>'
    assert office.odt(package({"content.xml": content}))[0] == "a  b"
    assert [(c["row"], c["col"]) for c in office.ods(package({"content.xml": content}))] == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_archive():
    data = archive.pack({"a": 1}, {"x": b"1", "y": b""})
    assert archive.unpack(data) == ({"a": 1}, {"x": b"1", "y": b""})
    for bad in (data[:-1], b"no" + data, data + b"!"):
        with pytest.raises(ValueError):
            archive.unpack(bad)


def parsed(*lines):
    return parser.parse([{"index": k, "text": x} if isinstance(x, str) else {"index": k, "text": x[0], **x[1]} for k, x in enumerate(lines)])


CASES = {
    "mixed": (
        ["一、基础知识", "14 题", "题目：每一个端子都有唯一的编号。（）", "A. 正确", "B. 错误", "A", "15[题]（简答题）为什么要定时检查？", "答案：为了及时发现故障。", "16 题（单选）下列说法正确的是（）。", "A. 甲", "B. 乙", "B",
         ("17 题", {"images": ["i.png"]}), "18 题（判断）设备接地有利于安全。", "A", "19/20[题]（多选）原则有哪些？", "A. 快速报警", "B. 冷静应对", "A/B", "201 20[单选题]最后一道题的答案是（）。", "A. 甲", "B. 乙", "A"],
        [("14", "judge", "A"), ("15", "short", "为了及时发现故障。"), ("16", "single", "B"), ("17", "single", ""), ("18", "judge", "A"), ("19", "multiple", "AB"), ("20", "single", "A")],
    ),
    "numbers alone": ([x for i in range(1, 4) for x in (str(i), f"题 测试题号 {i} 的答案是（）。", "A. 正确", "A")], [(str(i), "judge", "A") for i in range(1, 4)]),  # the only option is a truth value
    "no punctuation": (
        ["故障判断与处理", "37、安全栅是关键仪表。", "答案：（正确）", "38更换安全栅时，应注意以下事项:", "A.确认型号。", "B.先切断电源", "C提前断开信号线", "D螺丝应拧紧", "答案：ABCD", "39、指示灯闪烁含义", "参考答案：表示故障。"],
        [("37", "judge", "A"), ("38", "multiple", "ABCD"), ("39", "short", "表示故障。")],
    ),
    "inline answers": (["一、简答题（共 2 题）", "1.题目：原因有哪些？答案：1、探头损坏；2、电缆断路。", "2.题目：需要哪些工具？答案：扳手。"], [("1", "short", "1、探头损坏；2、电缆断路。"), ("2", "short", "扳手。")]),
    "answer key": (["一、单选题（共2题）", "1. 第一题？", "A.甲", "B.乙", "2. 第二题？", "A.甲", "B.乙", "参考答案", "1-2 AB"], [("1", "single", "A"), ("2", "single", "B")]),
    "short answer key": (["一、简答题（共2题）", "1. 甲是什么？", "2. 乙是什么？", "简答题答案", "1. 一", "2. 二"], [("1", "short", "一"), ("2", "short", "二")]),
    "leading and compact": (["一、单选题", "答案：B", "1. 原理基于（）。", "A.热", "B.电", "2. 单位是（）。答案 C；A.安 B.伏 C.瓦 D.欧"], [("1", "single", "B"), ("2", "single", "C")]),
    "styled": (["一、单选题", "1. 哪一个？", "A. 甲", ("B. 乙", {"strong": ["乙"]}), "C. 丙"], [("1", "single", "B")]),
    "truth marks": (["一、判断题", "1. 孔板是节流装置。（☑）", "2. 气体可测量。（☒）"], [("1", "judge", "A"), ("2", "judge", "B")]),
    "declared": (["一、简答题（共 3 题）", "1. 甲是什么？", "答案：一", "2. 乙是什么？", "答案：二"], [("1", "short", "一"), ("2", "short", "二"), ("3", "short", "")]),
    "fill": (["一、填空题", ("中文名称是集散控制系统。", {"strong": ["集散控制系统"]}), "分别表示____、____。", "答案：比例；积分"], [("", "short", "集散控制系统"), ("", "short", "比例；积分")]),
}


@pytest.mark.parametrize("name", CASES)
def test_parser(name):
    lines, want = CASES[name]
    assert [(q["number"], q["type"], q["answer_text"] or "".join(q["answer"])) for q in parsed(*lines)] == want


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("一、单选题", "1. 下列哪一个？", "A. 甲", "B. 乙", "答案：B"))
    (tmp_path / "b.txt").write_text("一、判断题\n1. 正确的说法。（√）\n", "utf-8")
    (tmp_path / "c.xlsx").write_bytes(xlsx([["题库"], ["题型", "题干", "选项A", "选项B", "答案", "级别"], ["单选题", "第一个问题", "甲", "乙", "B", "易"], ["判断题", "第二个问题", "", "", "对", "难"], ["", "第三个问题", "甲", "乙", "AB", "中"], ["简答题", "第四个问题", "", "", "文字", "易"]]))
    (tmp_path / "d.csv").write_text("题目;答案\n为什么;因为\n", "utf-8")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "e.bin").write_bytes(b"")
    scanned = files.scan(spark, str(tmp_path))
    lines = files.paragraphs(scanned).cache()
    assert [r["path"].rsplit("/", 1)[1] for r in lines.filter("error IS NOT NULL").collect()] == ["broken.docx"]
    qs = parser.questions(lines.filter("error IS NULL")).orderBy("doc_id").collect()
    assert [(q["type"], q["answer"], q["status"]) for q in qs] == [("single", ["B"], "normal"), ("judge", ["A"], "normal")]
    rows = tabular.questions(files.cells(scanned).filter("error IS NULL")).orderBy("path", "ord").collect()
    assert [(r["type"], "".join(r["answer"]) or r["answer_text"], r["difficulty"]) for r in rows] == [("single", "B", "简单"), ("judge", "A", "困难"), ("multiple", "AB", "中等"), ("short", "文字", "简单"), ("short", "因为", "")]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(b, f"q{i}", f"text {i}", "旧") for b in ("b1", "b2") for i in range(5)]
    schema = "bank_id string, question_id string, question string, display_label string"
    assert store.save(spark.createDataFrame(rows, schema)) == 10
    store.update(spark.createDataFrame([("b1", "q2", "changed", "旧")], schema), at=1)
    assert store.load("b1").filter("question = 'changed'").count() == 1 and store.load("b2").count() == 5
    assert store.undo("b1", "q2") and not store.undo("b1", "q2")
    assert store.load("b1").filter("question_id = 'q2'").first()["question"] == "text 2"
    store.retype("b2", "旧", "新")
    assert {r["display_label"] for r in store.load("b2").collect()} == {"新"}
    data = store.export("b2")
    store.delete("b2")
    assert store.load().count() == 5
    with pytest.raises(ValueError):
        store.restore(data[:-3])
    assert store.restore(data) == 5 and store.load("b2").count() == 5
    with pytest.raises(ValueError):
        store.save(spark.createDataFrame([rows[0], rows[0]], schema))
    assert store.orphans(spark.createDataFrame([("b1", "q1"), ("b1", "gone")], "bank_id string, question_id string")).count() == 1
