"""Sources and formats (survey sections 2.1 and 2.11): files written from table rows, read by the library's readers.

Each query writes a file per row with :mod:`lectern.plans.fixtures`, reads it as any file of that
kind, and its SQL says from the table alone what must come back.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import tabular, word
from lectern.plans import fixtures as X
from lectern.plans import views as v
from lectern.plans.registry import query
from lectern.sources import archive, files, fonts, legacy, office, pdf, texts


def nations(spark, d) -> DataFrame:
    return v.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))


def written(rows: DataFrame, kind: str, build: Callable[[dict], bytes]) -> DataFrame:
    """Files (path, kind, content) as :func:`lectern.sources.files.scan` gives them, one for each row."""

    def run(batches):
        for pdf_ in batches:
            records = pdf_.to_dict("records")
            yield pd.DataFrame({"path": [r["path"] for r in records], "kind": kind, "content": [build(r) for r in records]})

    return rows.mapInPandas(run, "path string, kind string, content binary")


def each(rows: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that a reader's function gives for each row of a table."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf_ in batches:
            yield pd.DataFrame([o for r in pdf_.to_dict("records") for o in f(r)], columns=names)

    return rows.mapInPandas(run, schema)


def listed(*values: str, more: str = "", table: str = "nation", key: str = "n_nationkey::VARCHAR") -> str:
    """SQL of the rows (path, index, text) that values make of each row."""
    return f"SELECT {key} AS path, unnest(range({len(values)}))::INT AS index, unnest([{', '.join(values)}]) AS text{more} FROM {table}"


def paragraphs(found: DataFrame, *more: str) -> DataFrame:
    return files.paragraphs(found).select("path", "index", "text", *more)


# --- dispatch -------------------------------------------------------------------------------------
_KINDS = ("docx", "odt", "rtf", "txt", "html", "md", "pdf", "doc")


def _of_kind(r: dict) -> bytes:
    lines = [f"{r['name']} one", f"{r['name']} two"]
    kind = _KINDS[r["k"] % len(_KINDS)]
    if kind == "docx":
        return X.docx(*lines)
    if kind in ("odt", "rtf"):
        return getattr(X, kind)(lines)
    if kind == "html":
        return "".join(f"<p>{t}</p>" for t in lines).encode()
    if kind == "pdf":
        return X.pdf([b"".join(X.shown(50, 700 - 20 * k, t) for k, t in enumerate(lines))])
    return X.doc([("\r".join(lines) + "\r", False)]) if kind == "doc" else "\n".join(lines).encode()


@query("src_dispatch", listed("n_name || ' one'", "n_name || ' two'", more=", (['docx','odt','rtf','txt','html','md','pdf','doc'])[n_nationkey % 8 + 1] AS kind"))
def src_dispatch(spark, d):
    """One file a nation, of eight kinds: each goes to its kind's reader."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("k") % len(_KINDS) + 1).cast("int"))
    made = written(nations(spark, d), "", _of_kind).drop("kind").join(nations(spark, d).select("path", kind.alias("kind")), "path")
    return paragraphs(made, "kind").filter("trim(text) <> ''")


# --- Word -----------------------------------------------------------------------------------------
@query("src_docx", listed("n_name", "'second of ' || n_name", "'<&> third'"))
def src_docx(spark, d):
    return paragraphs(written(nations(spark, d), "docx", lambda r: X.docx(r["name"], f"second of {r['name']}", X.p(X.run("<&> third")))))


_LISTED = "SELECT n_nationkey::VARCHAR AS path, unnest(range(6))::INT AS index, unnest(['head', n_name, 'sub', 'second', 'plain', 'third']) AS text, unnest(['Heading2', NULL, NULL, NULL, NULL, NULL]) AS style, unnest([NULL, '5', '5', '5', NULL, '5']) AS num_id, unnest([NULL, 0, 1, 0, NULL, 0])::INT AS level, unnest([NULL, 1, 1, 2, NULL, 3])::INT AS list_ordinal FROM nation"


@query("src_docx_paragraphs", _LISTED)
def src_docx_paragraphs(spark, d):
    made = written(nations(spark, d), "docx", lambda r: X.docx(X.p("head", style="Heading2"), X.p(r["name"], num=5), X.p("sub", num=5, level=1), X.p("second", num=5), "plain", X.p("third", num=5)))
    return paragraphs(made, "style", "num_id", "level", "list_ordinal")


@query("src_docx_altcontent", listed("n_name || ' says more than one word'", "'A. one' || chr(10) || 'B. two'"))
def src_docx_altcontent(spark, d):
    """Of alternative content the branch that says more; repeated lines count against one."""
    longer = "<w:r><w:t>{} says more than one word</w:t></w:r>"
    options = X.run("A. one") + "<w:r><w:br/></w:r>" + X.run("B. two")
    again = X.run("A. one") + "<w:r><w:br/></w:r>" + X.run("A. one")
    return paragraphs(written(nations(spark, d), "docx", lambda r: X.docx(f"<w:p>{X.either(X.run('short'), longer.format(r['name']))}</w:p>", f"<w:p>{X.either(again, options)}</w:p>")))


@query("src_docx_leaf", "SELECT n_nationkey::VARCHAR AS path, unnest(range(4))::INT AS index, unnest(['outside ' || n_name, 'boxed', 'also boxed', 'after']) AS text FROM nation")
def src_docx_leaf(spark, d):
    """Text beside a box stays, a box's paragraphs come once though both branches hold them."""
    def build(r):
        inside = X.box(X.p("boxed"), X.p("also boxed"))
        return X.docx(f"<w:p>{X.run('outside ' + r['name'])}{X.either(inside, inside)}</w:p>", "after")

    return paragraphs(written(nations(spark, d), "docx", build))


@query("src_docx_text", listed("n_name || chr(9) || 'seen' || chr(10) || 'kept'"))
def src_docx_text(spark, d):
    gone = X.run("hidden", "<w:vanish/>") + f"<w:del>{X.run('deleted')}</w:del><w:moveFrom>{X.run('moved')}</w:moveFrom><w:r><w:instrText>PAGE</w:instrText></w:r>" + X.run("web", "<w:webHidden/>")
    return paragraphs(written(nations(spark, d), "docx", lambda r: X.docx(X.p(r["name"], "<w:r><w:tab/></w:r>", X.run("seen"), gone, "<w:r><w:br/></w:r>", f"<w:ins>{X.run('kept')}</w:ins>"))))


@query("src_docx_style", """SELECT n_nationkey::VARCHAR AS path, 'under;lit;red;shaded' AS strong, CASE WHEN n_nationkey % 2 = 0 THEN 'bold' ELSE '' END AS weak FROM nation""")
def src_docx_style(spark, d):
    """Strong and weak marks of answers; a paragraph that is bold throughout has none."""
    marks = [("under", '<w:u w:val="single"/>'), ("lit", '<w:highlight w:val="yellow"/>'), ("red", '<w:color w:val="D01010"/>'), ("shaded", '<w:shd w:fill="FFFF00"/>'), ("black", '<w:color w:val="202020"/>'), ("none", '<w:u w:val="none"/>'), ("bold", "<w:b/>")]

    def build(r):
        runs = [X.run(t, s) for t, s in marks]
        return X.docx(X.p(*runs, "plain text") if r["k"] % 2 == 0 else X.p(*runs[:4], runs[6]))

    return files.paragraphs(written(nations(spark, d), "docx", build)).select("path", F.array_join("strong", ";").alias("strong"), F.array_join("weak", ";").alias("weak"))


@query("src_docx_tables", """SELECT n_nationkey::VARCHAR AS path, unnest(['before', n_name, 'b', 'inner', 'd', 'after']) AS text, unnest([NULL, 1, 1, 2, 1, NULL])::INT AS table_id, unnest([NULL, 0, 0, 0, 1, NULL])::INT AS table_row, unnest([NULL, 0, 1, 0, 1, NULL])::INT AS table_col FROM nation""")
def src_docx_tables(spark, d):
    """A table inside a cell is a table of its own."""
    made = written(nations(spark, d), "docx", lambda r: X.docx("before", X.table([[r["name"], "b"], [X.table([["inner"]]), "d"]]), "after"))
    return files.paragraphs(made).select("path", "text", "table_id", "table_row", "table_col")


@query("src_docx_overlay", listed("'1. question'", "'A. ' || n_name", "'B. covered'", "'C. seen'", "'D. from the box'", "'答案：A'"))
def src_docx_overlay(spark, d):
    """Options that repeat the one before are mended from a later line of their key, or from a text box."""
    def build(r):
        name = r["name"]
        return X.docx("1. question", f"A. {name}", f"B. {name}", "B. covered", "C. seen", "D. seen", f"<w:p>{X.box(X.p('from the box'))}</w:p>", "答案：A")

    return paragraphs(written(nations(spark, d), "docx", build))


@query("join_image_rel", "SELECT n_nationkey::VARCHAR AS path, 'word/media/' || n_nationkey || '.png' AS images FROM nation")
def join_image_rel(spark, d):
    """Relations to pictures that are there; one to a missing file joins nothing."""
    made = written(nations(spark, d), "docx", lambda r: X.docx(X.p("q", X.picture("r1"), X.picture("r2"), X.picture("r9")), images={"r1": f"media/{r['k']}.png"}, missing={"r2": "media/gone.png"}))
    return files.paragraphs(made).select("path", F.array_join("images", ";").alias("images"))


@query("fmt_rels", "SELECT n_nationkey::VARCHAR AS path, unnest(['r1', 'r2']) AS id, unnest(['word/media/' || n_name || '.png', 'shared/x.png']) AS target FROM nation")
def fmt_rels(spark, d):
    def read(r):
        package = office.Package(X.docx("x", images={"r1": f"media/{r['name']}.png", "r2": "../shared/x.png"}))
        return [(r["path"], i, t) for i, t in package.relations("word/document.xml").items()]

    return each(nations(spark, d), read, "path string, id string, target string")


@query("fmt_option_line", "SELECT n_nationkey::VARCHAR AS path, unnest(['A', 'B', 'C']) AS key, unnest([n_name, 'x y', 'z。']) AS body, unnest([lower(n_name), 'xy', 'z']) AS signature FROM nation")
def fmt_option_line(spark, d):
    return each(nations(spark, d), lambda r: [(r["path"], *found) for line in (f"A. {r['name']}", " b)  x  y", "C z。", "no option", "1. no") if (found := office.option_of(line))], "path string, key string, body string, signature string")


_TABLE_ROWS = "SELECT n_nationkey::VARCHAR AS path, unnest([1, 2])::INT AS ord, unnest(['单选题', '判断题']) AS display_label, unnest(['which is ' || n_name, n_name || ' is right']) AS question, unnest(['B', 'A']) AS answer, unnest(['yes|' || n_name, '正确|错误']) AS options FROM nation"


def _answered(q: DataFrame, *more) -> DataFrame:
    return q.select("path", "ord", "display_label", "question", F.array_join("answer", "").alias("answer"), F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), *more)


def _question_table(r: dict) -> str:
    return X.table([["题型", "题干", "选项A", "选项B", "答案"], ["单选题", f"which is {r['name']}", "yes", r["name"], "B"], ["判断题", f"{r['name']} is right", "", "", "对"]])


@query("src_word_table_questions", _TABLE_ROWS + " UNION ALL SELECT 'one ' || n_nationkey, 1, '单选题', 'pick ' || n_name, 'A', n_name || '|other' FROM nation")
def src_word_table_questions(spark, d):
    """A table with a header row, and a table that is one question with labels in its left column."""
    n = nations(spark, d)
    many = written(n, "docx", lambda r: X.docx(_question_table(r)))
    one = written(n.withColumn("path", F.concat(F.lit("one "), F.col("path"))), "docx", lambda r: X.docx(X.table([["题型", "单选题"], ["题目", f"pick {r['name']}"], ["A", r["name"]], ["B", "other"], ["答案", "A"]])))
    made = many.unionByName(one)
    return _answered(word.questions(files.paragraphs(made).filter("error IS NULL"), files.cells(made)))


@query("src_word_merge", """SELECT n_nationkey::VARCHAR AS path, unnest([1, 2, 3, 4])::INT AS ord, unnest(['first of ' || n_name, 'which is ' || n_name, n_name || ' is right', 'last of ' || n_name]) AS question, unnest(['A', 'B', 'A', 'B']) AS answer FROM nation""")
def src_word_merge(spark, d):
    """Questions of the text and of a table in between, in the document's order."""
    def build(r):
        return X.docx(f"1. first of {r['name']}", "A. x", "B. y", "答案：A", _question_table(r), f"2. last of {r['name']}", "A. x", "B. y", "答案：B")

    made = written(nations(spark, d), "docx", build)
    q = word.questions(files.paragraphs(made), files.cells(made))
    return q.select("path", "ord", "question", F.array_join("answer", "").alias("answer"))


@query("set_word_union", """SELECT n_nationkey::VARCHAR AS path, unnest([1, 2, 3])::INT AS ord, unnest(['text', 'table', 'text']) AS kind, unnest([n_nationkey, n_nationkey + 5, n_nationkey + 9]) AS place FROM nation""")
def set_word_union(spark, d):
    """Text and table questions by place, numbered anew in each document; columns that one side lacks are null."""
    n = nations(spark, d)
    text = n.select("path", F.explode(F.array(F.col("k"), F.col("k") + 9)).alias("place")).withColumns({"start": F.col("place"), "ord": F.lit(7), "kind": F.lit("text")})
    table = n.select("path", (F.col("k") + 5).alias("place")).withColumns({"start": F.col("place"), "ord": F.lit(1), "kind": F.lit("table"), "sheet": F.lit("s")})
    return word.by_place(text, table).select("path", "ord", "kind", "place")


# --- Excel ----------------------------------------------------------------------------------------
def cells(found: DataFrame, *more: str) -> DataFrame:
    return files.cells(found).select("path", "sheet", "row", "col", "value", *more)


def _grid(rows: str, sheet: str = "Questions") -> str:
    return f"SELECT n_nationkey::VARCHAR AS path, '{sheet}' AS sheet, unnest([{', '.join(x.split('=', 1)[0].split(',')[0] for x in rows.split(';'))}])::INT AS row, unnest([{', '.join(x.split('=', 1)[0].split(',')[1] for x in rows.split(';'))}])::INT AS col, unnest([{', '.join(x.split('=', 1)[1] for x in rows.split(';'))}]) AS value FROM nation"


@query("src_xlsx", _TABLE_ROWS)
def src_xlsx(spark, d):
    """A workbook of questions, read to validated questions."""
    made = written(nations(spark, d), "xlsx", lambda r: X.xlsx([["题型", "题干", "选项A", "选项B", "答案"], ["单选题", f"which is {r['name']}", "yes", r["name"], "B"], ["判断题", f"{r['name']} is right", None, None, "对"]]))
    return _answered(tabular.questions(files.cells(made)))


@query("src_xlsx_cells", _grid("1,1=n_name;1,3='12';2,1='TRUE';2,2='0.5';4,28='far'"))
def src_xlsx_cells(spark, d):
    return cells(written(nations(spark, d), "xlsx", lambda r: X.xlsx([[r["name"], None, 12], [True, 0.5], [], [None] * 27 + ["far"]], shared=False)))


@query("src_xlsx_sst", _grid("1,1=n_name;1,2='same';2,1='same';2,2=n_name"))
def src_xlsx_sst(spark, d):
    return cells(written(nations(spark, d), "xlsx", lambda r: X.xlsx([[r["name"], "same"], ["same", r["name"]]])))


@query("src_xlsx_sheets", _grid("1,1=n_name"))
def src_xlsx_sheets(spark, d):
    return cells(written(nations(spark, d), "xlsx", lambda r: X.xlsx([[r["name"]]], hidden=[["never"]])))


def _pictured(r: dict) -> bytes:
    k = r["k"]
    return X.xlsx([["题干", "选项A", "选项B", "答案"], [r["name"], ("=", f'DISPIMG("ID_{k}",1)'), "text", "A"]], anchors={(2, 1): f"q{k}.png", (2, 3): f"b{k}.png", (3, 2): "alone.png"}, named={f"ID_{k}": f"a{k}.png"})


@query("src_xlsx_images", """SELECT n_nationkey::VARCHAR AS path, unnest([2, 2, 2, 3])::INT AS row, unnest([1, 2, 3, 2])::INT AS col, unnest(['xl/media/q' || n_nationkey || '.png', 'xl/media/a' || n_nationkey || '.png', 'xl/media/b' || n_nationkey || '.png', 'xl/media/alone.png']) AS images FROM nation""")
def src_xlsx_images(spark, d):
    """Pictures anchored at cells, one where nothing is written, and one that a formula names."""
    return files.cells(written(nations(spark, d), "xlsx", _pictured)).filter(F.size("images") > 0).select("path", "row", "col", F.array_join("images", ";").alias("images"))


@query("join_cell_image", """SELECT n_nationkey::VARCHAR AS path, n_name AS question, 'xl/media/q' || n_nationkey || '.png' AS images, 'A:xl/media/a' || n_nationkey || '.png|B:xl/media/b' || n_nationkey || '.png' AS options FROM nation""")
def join_cell_image(spark, d):
    """A question's pictures by the cells that its text and options stand in."""
    q = tabular.questions(files.cells(written(nations(spark, d), "xlsx", _pictured))).filter("question <> ''")
    return q.select("path", "question", F.array_join("images", ";").alias("images"), F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["key"], F.array_join(o["images"], ";"))), "|").alias("options"))


@query("fmt_xlsx_rows", "SELECT n_nationkey::VARCHAR AS path, '题干：' || n_name || '|第3列：SUM(A1)|答案：B' AS raw FROM nation")
def fmt_xlsx_rows(spark, d):
    def read(r):
        rows = office.xlsx(X.xlsx([["题干", None, None, "答案"], [r["name"], None, ("=", "SUM(A1)"), "B"]]))
        heads = {c["col"]: c["value"] for c in rows if c["row"] == 1}
        return [(r["path"], "|".join(office.raw_row([c for c in rows if c["row"] == 2], heads)))]

    return each(nations(spark, d), read, "path string, raw string")


@query("tab_context_questions", "SELECT n_nationkey::VARCHAR AS path, unnest(['Questions', 'Sheet1']) AS sheet, unnest([n_name || ' of a book', n_name || ' of a list']) AS question FROM nation")
def tab_context_questions(spark, d):
    """Every sheet of every file that has a header gives its questions."""
    n = nations(spark, d)
    book = written(n, "xlsx", lambda r: X.xlsx([["题干", "答案"], [f"{r['name']} of a book", "x"]], hidden=[["题干", "答案"], ["no", "x"]]))
    lists = written(n, "csv", lambda r: X.csv([["no header", ""], ["题目", "参考答案"], [f"{r['name']} of a list", "y"]]).encode())
    return tabular.questions(files.cells(book.unionByName(lists))).select("path", "sheet", "question")


@query("tab_declared_counts", "SELECT n_nationkey::VARCHAR AS path, unnest(['单选题', '判断题']) AS label, unnest([1000 + n_nationkey, n_nationkey + 1])::BIGINT AS declared FROM nation")
def tab_declared_counts(spark, d):
    made = written(nations(spark, d), "xlsx", lambda r: X.xlsx([["题型", "单选题", "判断题", "合计"], [None], ["数量", f"1,{r['k']:03d}", r["k"] + 1, 0]]))
    return tabular.declared_counts(files.cells(made))


# --- older and other formats ----------------------------------------------------------------------
@query("src_doc", listed("'1. ' || n_name", "'shown'", "'题目 plain'"))
def src_doc(spark, d):
    """Pieces of two encodings, a field whose code goes and whose result stays, and controls."""
    return paragraphs(written(nations(spark, d), "doc", lambda r: X.doc([(f"1. {r['name']}\r", False), ("\x13 PAGE \x14shown\x15\r", True), ("题目\x07plain\r", False)])).select("path", "kind", "content")).select("path", "index", F.translate("text", "\t", " ").alias("text"))


@query("fmt_doc_quality", listed("'没有片段表的文档 ' || n_name"))
def fmt_doc_quality(spark, d):
    """Without a piece table the stream's text is read in the encoding that reads best."""
    return paragraphs(written(nations(spark, d), "doc", lambda r: X.doc([(f"没有片段表的文档 {r['name']}\r", False)], table=False)))


@query("fmt_doc_controls", "SELECT n_nationkey::VARCHAR AS path, n_name || chr(9) || 'cell' || chr(10) || '【图片】' AS text FROM nation")
def fmt_doc_controls(spark, d):
    return each(nations(spark, d), lambda r: [(r["path"], legacy.without_controls(f"{r['name']}\x07cell\x0b\x01\x02\x05"))], "path string, text string")


@query("src_cfb", "SELECT n_nationkey::VARCHAR AS path, unnest(['Long', 'Short']) AS stream, unnest([9000, 4096])::BIGINT AS size, n_name AS begins FROM nation")
def src_cfb(spark, d):
    """Streams of a compound file, whole over many sectors."""
    def read(r):
        name = r["name"].encode()
        found = legacy.compound(X.compound({"Long": (name + b" ").ljust(9000, b"x"), "Short": name}))
        return [(r["path"], s, len(data), data[: len(name)].decode()) for s, data in found.items() if s != "Root Entry"]

    return each(nations(spark, d), read, "path string, stream string, size long, begins string")


@query("src_xls", _grid("1,1=n_name;1,2='题干';2,1=n_nationkey::VARCHAR;2,2='2.5';3,1='TRUE'"))
def src_xls(spark, d):
    return cells(written(nations(spark, d), "xls", lambda r: X.xls([[r["name"], "题干"], [r["k"], 2.5], [True]])))


@query("src_rtf", listed("'1. 题目 ' || n_name", "'{braces} \\ and ä'"))
def src_rtf(spark, d):
    return paragraphs(written(nations(spark, d), "rtf", lambda r: X.rtf([f"1. 题目 {r['name']}", "{braces} \\ and ä"])))


@query("src_odt", listed("n_name", "'second'"))
def src_odt(spark, d):
    return paragraphs(written(nations(spark, d), "odt", lambda r: X.odt([r["name"], " ", "second"])))


@query("src_ods", _grid("1,1=n_name;1,3='x';2,1='twice';3,1='twice';5,1='last'"))
def src_ods(spark, d):
    return cells(written(nations(spark, d), "ods", lambda r: X.ods([([r["name"], "", "x"], 1), (["twice"], 2), ([""], 1), (["last"], 1)])))


_CELLS = "SELECT n_nationkey::VARCHAR AS path, unnest([1, 1, 2, 2])::INT AS row, unnest([1, 2, 1, 2])::INT AS col, unnest(['题干', '答案', n_name || '%s \"q\"', 'a' || chr(10) || 'b']) AS value FROM nation"


@query("src_csv", _CELLS % ",")
def src_csv(spark, d):
    """Quoted cells with delimiters, quotation marks and line ends; the delimiter is found."""
    return cells(written(nations(spark, d), "csv", lambda r: X.csv([["题干", "答案"], [f"{r['name']}, \"q\"", "a\nb"]]).encode())).drop("sheet")


@query("src_csv_parse", "SELECT c_custkey, unnest([1, 1, 2, 2])::INT AS row, unnest([1, 2, 1, 2])::INT AS col, unnest([c_name, c_mktsegment || '; \"x\"', '', ' y ']) AS value FROM customer")
def src_csv_parse(spark, d):
    def read(r):
        rows = texts.table(X.csv([[r["c_name"], f"{r['c_mktsegment']}; \"x\""], ["", " y "]], ";"), ";")
        return [(r["c_custkey"], i, j, c) for i, row in enumerate(rows, 1) for j, c in enumerate(row, 1)]

    return each(v.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), read, "c_custkey long, row int, col int, value string")


@query("src_delim_sniff", "SELECT c_custkey, ([',', chr(9), ';', '|'])[(c_custkey % 4 + 1)::INT] AS delimiter FROM customer")
def src_delim_sniff(spark, d):
    def read(r):
        mark = texts.DELIMITERS[r["c_custkey"] % 4]
        return [(r["c_custkey"], texts.sniff_delimiter(X.csv([[r["c_name"], r["c_mktsegment"], "1"]] * 3 + [["plain line", "", ""]], mark)))]

    return each(v.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), read, "c_custkey long, delimiter string")


@query("src_html", "SELECT page_id, unnest(range(3))::INT AS idx, unnest([trim(split_part(url, '://', 2)), 'a & b', '• item']) AS text FROM pages WHERE url IS NOT NULL")
def src_html(spark, d):
    """Visible lines of pages: blocks end lines, entities are read, scripts and styles are not shown."""
    rows = v.table(spark, d, "pages").filter("url IS NOT NULL").select("page_id", F.trim(F.split("url", "://")[1]).alias("t"))
    html = "<html><style>p {{}}</style><script>var x = '<p>no</p>';</script><div>{}</div><p>a &amp; b<br></p><ul><li>item</li></ul></html>"
    return each(rows, lambda r: [(r["page_id"], k, t) for k, (_, t) in enumerate(texts.lines(texts.html_blocks(html.format(X.escape(r["t"])))[0]))], "page_id long, idx int, text string")


@query("src_md", """SELECT doc_id, 'Head' || chr(10) || '1. ' || replace(text, chr(10), ' ') || chr(10) || 'item bold code link pic【图片】' AS text FROM documents WHERE NOT regexp_matches(text, '[`*_#>\\[\\]!-]')""")
def src_md(spark, d):
    """Marks of Markdown go, numbers and texts stay."""
    rows = v.table(spark, d, "documents").filter(~F.col("text").rlike(r"[`*_#>\[\]!-]")).select("doc_id", F.translate("text", "\n", " ").alias("t"))
    return each(rows, lambda r: [(r["doc_id"], texts.markdown_plain(f"## Head\n1. {r['t']}\n- item **bold** `code` [link](u) ![pic](p)"))], "doc_id long, text string")


_ENCODINGS = ("utf-8", "utf-16-le", "utf-16-be", "gb18030")


@query("src_text_auto", "SELECT doc_id, strlen(text || ' 中文题目，答案如下。')::BIGINT AS bytes, text || ' 中文题目，答案如下。' AS text FROM documents")
def src_text_auto(spark, d):
    """Texts written in four encodings, two of them with byte-order marks, come back.

    The others get a mark only where a text itself begins with one, or with another encoding's declaration.
    """
    marks = {"utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "gb18030": b"\x84\x31\x95\x33"}

    def read(r):
        if r["text"] is None:
            return [(r["doc_id"], None, None)]
        text, code = r["text"] + " 中文题目，答案如下。", _ENCODINGS[int(r["doc_id"] or 0) % 4]
        marked = code.startswith("utf-16") or text.startswith("\ufeff") or text.lstrip().startswith("<?xml")
        back = texts.decode_auto((marks[code] if marked else b"") + text.encode(code))
        return [(r["doc_id"], str(len(back.encode())), back)]

    rows = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # longs beside nulls would become doubles
    back = each(rows, read, "doc_id string, bytes string, text string")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("bytes").cast("long").alias("bytes"), "text")


@query("src_archive", "SELECT n_nationkey::VARCHAR AS path, unnest(['package', 'json', 'backup']) AS kind, n_name AS name, 2::BIGINT AS questions, n_name || '?' AS first, n_name AS asset FROM nation")
def src_archive(spark, d):
    """Banks in a package, in a JSON file with Base64 assets, and in a backup of several."""
    import base64
    import json

    def read(r):
        name, qs = r["name"], [{"question": f"{r['name']}?"}, {"question": "second"}]
        packed = archive.pack({"name": name}, {"questions.json": json.dumps(qs).encode(), "a.png": name.encode()})
        plain = {"name": name, "questions": qs, "assets": {"a.png": base64.b64encode(name.encode()).decode()}}
        held = {"package": packed, "json": json.dumps(plain).encode(), "backup": json.dumps({"banks": [plain]}).encode()}
        return [(r["path"], kind, b["name"], len(b["questions"]), b["questions"][0]["question"], b["assets"]["a.png"].decode()) for kind, data in held.items() for b in archive.banks(data)]

    return each(nations(spark, d), read, "path string, kind string, name string, questions long, first string, asset string")


# --- PDF ------------------------------------------------------------------------------------------
def _page(*lines: str, top: int = 700) -> bytes:
    return b"".join(X.shown(50, top - 20 * k, t) for k, t in enumerate(lines))


@query("src_pdf", listed("'1. ' || n_name || ' (x)?'", "'A.one'", "'B.two'", "'second page'"))
def src_pdf(spark, d):
    """Text of all pages in order; options in a line become lines."""
    return paragraphs(written(nations(spark, d), "pdf", lambda r: X.pdf([_page(f"1. {r['name']} (x)?", "A. one B. two"), _page("second page")])))


@query("src_pdf_objects", listed("n_name", "'packed'"))
def src_pdf_objects(spark, d):
    """Objects inside a compressed object stream."""
    return paragraphs(written(nations(spark, d), "pdf", lambda r: X.pdf([_page(r["name"], "packed")], packed=True)))


@query("src_pdf_pages", "SELECT n_nationkey::VARCHAR AS path, unnest([1, 2, 3])::INT AS page, unnest([n_name || ' 1', n_name || ' 2', n_name || ' 3']) AS text FROM nation")
def src_pdf_pages(spark, d):
    """Pages in the order of their tree, with the resources that they inherit."""
    return files.paragraphs(written(nations(spark, d), "pdf", lambda r: X.pdf([_page(f"{r['name']} {k}") for k in (1, 2, 3)]))).select("path", "page", "text")


_UNICODE = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <9898> <0002> <76ee> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"


def _faces() -> dict:
    """Fonts of each kind, the streams and objects they need."""
    fonts_ = {
        "F1": b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>",
        "U": b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 60 0 R >>",
        "D": b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /uni9898 /u76EE /eacute /quoteright 200 /A] >> >>",
        "E": b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [70 0 R] >>",
        "C": b"<< /Type /Font /Subtype /Type0 /Encoding 62 0 R /DescendantFonts [71 0 R] >>",
        "I": b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H >>",
    }
    objects = {70: b"<< /Subtype /CIDFontType2 /FontDescriptor 72 0 R /DW 1000 /W [5 [250 500] 7 9 600] >>", 71: b"<< /Subtype /CIDFontType2 /FontDescriptor 72 0 R /CIDToGIDMap 63 0 R >>", 72: b"<< /FontFile2 61 0 R >>"}
    cid = b"1 begincodespacerange <00> <ff> endcodespacerange 1 begincidrange <41> <43> 1 endcidrange"
    gids = b"\0\0" + b"".join((5 + k).to_bytes(2) for k in range(3))
    streams = {60: (b"", _UNICODE), 61: (b"", X.truetype({0x9898: 5, 0x76EE: 6, 0x58: 7})), 62: (b"/Type /CMap", cid), 63: (b"", gids)}
    return {"fonts": fonts_, "objects": objects, "streams": streams}


@query("src_pdf_fonts", listed("n_name", "'题目ABC'", "'题目é’A'", "'题目X'", "'题目X'", "'36试'"))
def src_pdf_fonts(spark, d):
    """Unicode maps, glyph names, embedded character tables behind identity and own encodings, and codes that are characters."""
    def build(r):
        lines = [("F1", r["name"]), ("U", b"\0\1\0\2\0\x10\0\x11\0\x12"), ("D", b"\1\2\3\4\xc8"), ("E", b"\0\5\0\6\0\7"), ("C", b"ABC"), ("I", (0xF6B1 + 3).to_bytes(2) + (0x36).to_bytes(2) + "试".encode("utf-16-be"))]
        return X.pdf([b"".join(X.shown(50, 700 - 20 * k, t, f) for k, (f, t) in enumerate(lines))], **_faces())

    return paragraphs(written(nations(spark, d), "pdf", build))


@query("src_pdf_glyphs", "SELECT n_nationkey::VARCHAR AS path, n_name || '“a”' AS plain, '题�' AS known, '�' AS unknown, 3::BIGINT AS forms FROM nation")
def src_pdf_glyphs(spark, d):
    """Each code by the font's own means; one that means nothing is a replacement character."""
    def read(r):
        plain = fonts.Font().decode(r["name"].encode() + b"\x93a\x94")
        known = fonts.Font(map={b"\0\1": "题"}, sizes=(2,), wide=True).decode(b"\0\1\0\2")
        forms = {tuple(sorted(fonts.gid_texts(X.truetype({65: 1, 67: 3}, form)).items())) for form in (4, 6, 12)}
        return [(r["path"], plain, known, fonts.Font(sizes=(2,), wide=True).decode(b"\0\2"), 3 if forms == {((1, "A"), (3, "C"))} else 0)]

    return each(nations(spark, d), read, "path string, plain string, known string, unknown string, forms long")


@query("src_pdf_content", listed("n_name || ' moved'", "'scaled'", "'inside a form'", "'said aloud'", "'ab'"))
def src_pdf_content(spark, d):
    """Matrices nest, forms are followed, marked content may say its text, widths place what goes on in a line."""
    def build(r):
        body = b"q 1 0 0 1 0 300 cm " + X.shown(50, 400, f"{r['name']} moved") + b"Q q 2 0 0 2 0 0 cm " + X.shown(25, 340, "scaled") + b"Q q 1 0 0 1 0 60 cm /X1 Do Q "
        body += b"/Span << /ActualText (said aloud) >> BDC " + X.shown(50, 640, "glyphs") + b"EMC BT /F1 10 Tf 50 620 Td (a) Tj 0 0 Td T* ET BT /F1 10 Tf 57 620 Td (b) Tj ET"
        return X.pdf([body], streams={80: (b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 0]", X.shown(50, 600, "inside a form"))}, xobjects={"X1": 80})

    return paragraphs(written(nations(spark, d), "pdf", build))


@query("src_pdf_lines", listed("n_name || ' and more'", "'next'"))
def src_pdf_lines(spark, d):
    """Fragments within 2.2 of one height are one line, from left to right whatever their order."""
    def build(r):
        return X.pdf([X.shown(300, 700.9, " and more") + X.shown(50, 700, r["name"]) + X.shown(50, 697, "next")])

    return paragraphs(written(nations(spark, d), "pdf", build)).select("path", "index", "text")


@query("src_pdf_columns", "SELECT n_nationkey::VARCHAR AS path, unnest(range(18))::INT AS index, unnest(['Title'] || list_transform(range(8), lambda k: 'L' || k || n_name) || list_transform(range(8), lambda k: 'R' || k) || ['End']) AS text FROM nation")
def src_pdf_columns(spark, d):
    """Two columns are read one after the other, between the page's top and bottom."""
    def build(r):
        rows = [X.shown(200, 780, "Title")] + [X.shown(x, 700 - 60 * k, f"{c}{k}{r['name'] if c == 'L' else ''}") for k in range(8) for x, c in ((50, "L"), (350, "R"))] + [X.shown(200, 200, "End")]
        return X.pdf([b"".join(rows)])

    return paragraphs(written(nations(spark, d), "pdf", build))


@query("src_pdf_margins", "SELECT n_nationkey::VARCHAR AS path, unnest([1, 1, 2, 2, 3, 3, 4, 4])::INT AS page, unnest(list_transform(range(8), lambda k: CASE WHEN k % 2 = 0 THEN (k // 2 + 1) || '. ' || n_name ELSE 'A. same' END)) AS text FROM nation")
def src_pdf_margins(spark, d):
    """Page numbers and recurring headers go; options that recur at the edge stay."""
    def build(r):
        return X.pdf([X.shown(50, 780, "Training Exam Company") + X.shown(50, 400, f"{k}. {r['name']}") + X.shown(50, 40, "A. same") + X.shown(300, 20, f"- {k} -") for k in range(1, 5)])

    return files.paragraphs(written(nations(spark, d), "pdf", build)).select("path", "page", "text")


@query("src_pdf_image", "SELECT n_nationkey::VARCHAR AS path, unnest(['page_0001_image_0001.jpg', 'page_0001_image_0002.png', 'page_0001_image_0003.png']) AS image, unnest([7, 4, 12])::BIGINT AS bytes FROM nation")
def src_pdf_image(spark, d):
    """JPEG data as it is, grey and RGB samples as PNG; the samples come back."""
    import zlib

    def read(r):
        streams = {
            80: (b"/Subtype /Image /Width 2 /Height 2 /Filter /DCTDecode", b"\xff\xd8jpeg\xd9"),
            81: (b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\1\2\3\4"),
            82: (b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB", bytes(range(12))),
            83: (b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 1 /ColorSpace /DeviceGray", b"\1"),
        }
        drawn = b"".join(b"q 10 0 0 10 50 %d cm /I%d Do Q " % (700 - 50 * k, k) for k in range(4))
        found = pdf.read(X.pdf([drawn], streams=streams, xobjects={f"I{k}": 80 + k for k in range(4)}))
        shown = [p["images"][0] for p in found[0]]

        def samples(data: bytes) -> int:
            if not data.startswith(b"\x89PNG"):
                return len(data)
            raw = zlib.decompress(data[data.index(b"IDAT") + 4 : -16])
            wide = len(raw) // 2
            return len(raw[1:wide] + raw[wide + 1 :])

        return [(r["path"], name, samples(found[1][name])) for name in shown]

    return each(nations(spark, d), read, "path string, image string, bytes long")


@query("fmt_pdf_inline_options", "SELECT n_nationkey::VARCHAR AS path, unnest(range(4))::INT AS index, unnest(['A.' || n_name, 'B.two', 'C.three', 'text A. x B. y']) AS text FROM nation")
def fmt_pdf_inline_options(spark, d):
    return each(nations(spark, d), lambda r: [(r["path"], k, t) for k, t in enumerate(x for line in (f"A. {r['name']} B、two C）three", "text A. x B. y") for x in pdf.split_options(line))], "path string, index int, text string")


@query("fmt_pdf_clean", "SELECT n_nationkey::VARCHAR AS path, '题目文字 ' || n_name AS text FROM nation")
def fmt_pdf_clean(spark, d):
    return each(nations(spark, d), lambda r: [(r["path"], pdf.clean_text(f" 题 目\x02 文 字 {r['name']}\x1f "))], "path string, text string")


@query("fmt_pdf_order", "SELECT n_nationkey::VARCHAR AS path, n_name || '>left>right>low' AS texts FROM nation")
def fmt_pdf_order(spark, d):
    """From the top down; within a height of 2 from left to right."""
    return each(nations(spark, d), lambda r: [(r["path"], ">".join(t for *_, t in pdf.by_place([(10.0, 5.0, "low"), (50.0, 90.0, "right"), (51.5, 20.0, "left"), (90.0, 40.0, r["name"])])))], "path string, texts string")


@query("fmt_pdf_string", "SELECT n_nationkey::VARCHAR AS path, unnest(['utf-16-be', 'utf-16-le', 'utf-8', 'bytes']) AS form, unnest(['题' || n_name, '题' || n_name, '题' || n_name, 'é' || n_name]) AS text FROM nation")
def fmt_pdf_string(spark, d):
    def read(r):
        t = "题" + r["name"]
        held = {"utf-16-be": b"\xfe\xff" + t.encode("utf-16-be"), "utf-16-le": b"\xff\xfe" + t.encode("utf-16-le"), "utf-8": t.encode(), "bytes": ("é" + r["name"]).encode("latin-1")}
        return [(r["path"], form, pdf.string_text(data)) for form, data in held.items()]

    return each(nations(spark, d), read, "path string, form string, text string")


@query("fmt_pdf_font_rules", "SELECT n_nationkey::VARCHAR AS path, unnest(['Adieresis', 'A.alt', 'uni98980041', 'u1F600', 'notdef', 'emdash', 'win 0x80', 'mac 0x8A', 'plain 0x80', 'width 5', 'width 8', 'width 99']) AS rule, unnest(['Ä', 'A', '题A', '😀', '', '—', '€', 'ä', '', '250.0', '600.0', '']) AS text FROM nation")
def fmt_pdf_font_rules(spark, d):
    """Glyph names, base encodings, and widths by character number."""
    def read(r):
        names = {n: fonts.glyph_text(n) for n in ("Adieresis", "A.alt", "uni98980041", "u1F600", "notdef", "emdash")}
        codes = {"win 0x80": fonts.base_encoding("WinAnsiEncoding").get(0x80, ""), "mac 0x8A": fonts.base_encoding("MacRomanEncoding").get(0x8A, ""), "plain 0x80": fonts.base_encoding("").get(0x80, "")}
        doc = pdf.Document(X.pdf([b""]))
        wide = pdf.cid_widths(doc, [5, [250, 500], 7, 9, 600])
        return [(r["path"], k, t) for k, t in (names | codes | {f"width {n}": str(wide.get(n, "")) for n in (5, 8, 99)}).items()]

    return each(nations(spark, d), read, "path string, rule string, text string")


@query("src_native_fs", "SELECT n_nationkey::VARCHAR AS path, unnest(['a/b.txt', 'c.txt', '../out.txt', '/root.txt', 'C:/x']) AS name, unnest(['a/b.txt', 'c.txt', '', '', '']) AS inside FROM nation")
def src_native_fs(spark, d):
    """Entries of a package that stay in their folder; others are refused."""
    from lectern.sources.fs import safe_name

    def inside(name: str) -> str:
        try:
            return safe_name(name)
        except ValueError:
            return ""

    return each(nations(spark, d), lambda r: [(r["path"], n, inside(n)) for n in ("a/b.txt", "c.txt", "../out.txt", "/root.txt", "C:/x")], "path string, name string, inside string")
