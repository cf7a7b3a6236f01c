"""Column functions against their plain forms, and operators against brute force."""

import random
import string

import pytest
from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.functions import text as T
from lectern.operators import options, parser, sequence, sessions
from lectern.operators import validate as V
from lectern.operators.parser import Line
from lectern.operators.storage import Conflict, Store
from lectern.sources import files, fs, office, texts

PIECES = ["答案", "【答案】", "参 考 答 案：", "（解析）", "答案（A）", "正确答案为:", "：：", "Ａ", "９", " ", "  ", "\t", "\n", "\r\n", "\n\n\n", "　", "\xa0", "​", "﻿", "，", "。", "（ x ）", "( y )", "[ ", " ]", "中文".encode().decode("latin-1"), "é".encode().decode("latin-1"), "é", "“q”", "&amp;#65;", "&#20013;", "&lt;", "&#0;", "a", "Bc", "1.", "-", "_", "😀", "Ã", "½", "解 析 :"]


def texts_of(rnd, n):
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize(("column", "plain"), [(T.normalize, L.tidy), (T.one_line, L.one_line), (T.compact, L.compact), (T.repair_mojibake, L.repair_mojibake), (T.option_signature, options.signature), (T.half_width, L.half_width)])
def test_column_functions_equal_the_plain_ones(spark, column, plain):
    given = texts_of(random.Random(column.__name__), 1500)
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", column(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r["x"] == plain(r["t"]), repr(r["t"])


def test_entities(spark):
    given = {"&amp;#65;&lt;&#x42;": "A<B", "&#x1F600;": "😀", "&#0;&#xD800;&#99999999;": "&#0;&#xD800;&#99999999;", "a & b; &nope;": "a & b; &nope;", "": ""}
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", T.xml_entities(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == given


def test_joined_lines(spark):
    rnd = random.Random(3)
    given = [[rnd.choice(["第一行，", "续写", "1. 要点", "abc", "def", "", "（x）", "和其他", "- item", "两行\n三行"]) for _ in range(rnd.randint(0, 6))] for _ in range(400)]
    df = spark.createDataFrame([(g,) for g in given], "g array<string>")
    for mode in ("question", "answer", "analysis"):
        for r in df.select("g", T.smart_join(F.col("g"), mode).alias("x")).collect():
            assert r["x"] == L.joined(r["g"], mode), (mode, r["g"])


def test_grades_equal_the_validation(spark):
    rnd = random.Random(4)
    words = ["甲", "乙", "正确", "错误", "图形", "", "对", "a b", "a  b", "A.甲", "很长的选项内容"]
    rows = []
    for k in range(400):
        n = rnd.choice((0, 1, 2, 2, 3, 4))
        opts = [(key, rnd.choice(words), rnd.choice(([], [], ["i.png"]))) for key in "ABCD"[:n]]
        raw = rnd.choice(([], ["\n".join(f"{key}. {t}" for key, t, _ in opts)], [f"({key}) {rnd.choice(words)}" for key, _, _ in opts]))
        rows.append((k, rnd.choice(("题", "四个字的题干", "答案：在此处题干", "x" * 1001, "乱码�题干")), rnd.choice(("single", "multiple", "judge", "short")), opts, rnd.sample("ABCDE", rnd.randint(0, 2)), rnd.choice(("", " ", "文字", "y" * 3001)), rnd.random() < 0.3, rnd.choice((None, "1")), raw))
    schema = "id int, question string, type string, options array<struct<key:string,text:string,images:array<string>>>, answer array<string>, answer_text string, inferred_boundary boolean, duplicate_of string, raw_texts array<string>"
    for r in V.validate(spark.createDataFrame(rows, schema)).collect():
        row = r.asDict(recursive=True) | {"images": [], "answer_images": [], "analysis": ""}
        assert options.graded(row) == (r["confidence_x100"], r["status"]), row


# --- parser ---------------------------------------------------------------------------------------
def document(rnd):
    """Lines of a document as people write them, with some that belong nowhere."""
    out = []
    for n in range(1, rnd.randint(3, 12)):
        kind = rnd.choice(("single", "judge", "short", "fill", "noise", "heading", "lone", "bare answer"))
        if kind == "single":
            out += [f"{n}. 下列哪个是第{n}个（）。", "A. 甲", "B. 乙", rnd.choice(("答案：A", "B", "参考答案：B"))]
        elif kind == "judge":
            out += [f"{n}、第{n}个说法是对的。（{rnd.choice('√×')}）"]
        elif kind == "short":
            out += [f"{n}.什么是第{n}个？", "答案：这是答案", "第二行"]
        elif kind == "fill":
            out += [f"{n}. 第{n}个是（答案词）。"]
        elif kind == "noise":
            out += [rnd.choice(("- 3 -", "第 4 页", "目录........12", ""))]
        elif kind == "heading":
            out += [rnd.choice(("一、单选题", "二、判断题（共2题）", "第三章 概述", "三、简答题"))]
        elif kind == "lone":
            out += [str(n), f"第{n}个编号单独成行（）", "A. 甲", "B. 乙", "答案：B"]
        else:
            out += [f"{n}. 第{n}个是多少？", "答案：", str(rnd.randint(1, 99))]
    return out


@pytest.mark.parametrize("kind", ["", "docx", "pdf"])
def test_every_line_is_accounted_for(kind):
    rnd = random.Random(kind)
    for _ in range(150):
        given = document(rnd)
        rows, counts = parser.adapted([Line(k, t) for k, t in enumerate(given)], "", kind)
        assert counts["assigned"] + counts["noise"] + counts["structure"] + counts["unassigned"] == len(given), given
        assert sorted({a for r in rows for a in r["paragraphs"]}) == sorted(a for r in rows for a in r["paragraphs"])
        for r in rows:
            assert r["type"] in L.CORE_LABELS and (r["type"] != "short" or not r["options"])
        lone = [k for k, t in enumerate(given) if t == "答案："]
        for k in lone:  # a number after a bare label is its answer
            assert any(k + 1 in r["paragraphs"] for r in rows), given


def test_bare_labels_and_lone_numbers():
    def read(*lines):
        return [(r["number"], r["type"], "".join(r["answer"]) or r["answer_text"]) for r in parser.parse([{"index": k, "text": t} for k, t in enumerate(lines)])]

    assert read("3", "stem", "A. one", "B. two", "答案：B") == [("3", "single", "B")]
    assert read("1. 第一题？", "答案：", "42", "2. 第二题？", "答案：文字", "3. 选（）", "A. x", "B. y", "答案：", "B") == [("1", "short", "42"), ("2", "short", "文字"), ("3", "single", "B")]
    assert read("1. 甲是什么？", "参考答案：", "1、一。", "2、二。", "2. 乙是什么？", "参考答案：丙") == [("1", "short", "1、一。\n2、二。"), ("2", "short", "丙")]


# --- rows and keys --------------------------------------------------------------------------------
def test_numbers_equal_a_window(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(("a", "a", "a", "b", None)), rnd.randint(0, 9000), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "bank string, ord int, id int").repartition(5)
    got = {r["id"]: r["n"] for r in sequence.numbered(df, ["bank"], [F.asc("ord"), F.asc("id")], "n", sequence.runs("ord", 64)).collect()}
    want = {}
    for bank in ("a", "b", None):
        want |= {k: n for n, (_, k) in enumerate(sorted((o, k) for b, o, k in rows if b == bank), 1)}
    assert got == want
    whole = sequence.numbered(df, [], [F.asc("ord"), F.asc("id")], "n", sequence.runs("ord")).collect()
    assert [r["id"] for r in sorted(whole, key=lambda r: r["n"])] == [k for _, k in sorted((o, k) for _, o, k in rows)]


def test_nearest_states_by_brute_force(spark):
    rnd = random.Random(6)
    qs = [(k, rnd.choice(("hot", "hot", "x", "y", f"own{k}")), rnd.randint(1, 20_000)) for k in range(600)]
    states = [(k, rnd.choice((-1, -1, rnd.randint(0, 700))), rnd.choice(("hot", "x", "y", "", "none", f"own{rnd.randint(0, 700)}")), rnd.choice((0, -5, rnd.randint(1, 20_000)))) for k in range(800)]
    got = {r["state_id"]: (r["matched"], r["how"]) for r in sessions.nearest_state(spark.createDataFrame(states, "state_id int, question_id int, key string, ord int"), spark.createDataFrame(qs, "question_id int, key string, ord int")).collect()}
    ids, want = {q[0] for q in qs}, {}
    for s, qid, key, ord_ in states:
        if qid in ids:
            want[s] = (qid, 0)
        elif key and (own := [(abs(o - ord_) if ord_ > 0 else 0, o, k) for k, kk, o in qs if kk == key]):
            want[s] = (min(own)[2], 1)
    assert got == want


def test_first_spans_and_duplicates(spark):
    points = spark.createDataFrame([(1, "k", 5), (2, "k", 9), (3, "z", 5)], "id int, key string, at int")
    spans = spark.createDataFrame([("k", 0, 8, "one"), ("k", 4, 10, "two"), ("k", 9, 12, "three")], "key string, a int, b int, name string")
    assert {r["id"]: r["name"] for r in sessions.interval_join(points, spans, "at", "a", "b", "key").collect()} == {1: "one", 2: "two"}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["long enough", "short", "short", "long enough", "long enough", None])], "id int, t string")
    assert {r["id"]: r["duplicate_of"] for r in sequence.first_duplicates(rows, F.col("t"), F.col("id"), "id").collect()} == {0: None, 1: None, 2: None, 3: 0, 4: 0, 5: None}


def test_equal_points_stay(spark):
    points = spark.createDataFrame([(1, "k", 5), (1, "k", 5), (1, "k", 9)], "id int, key string, at int")
    spans = spark.createDataFrame([("k", 0, 8, "one"), ("k", 0, 8, "one"), ("k", 4, 10, "two")], "key string, a int, b int, name string")
    names = [sorted(r["name"] for r in sessions.interval_join(points, spans, "at", "a", "b", "key", first=f).collect()) for f in (True, False)]
    assert names == [["one", "one", "two"], ["one"] * 4 + ["two"] * 3]


def test_spans_of_equal_lines(spark, tmp_path):
    from datetime import datetime

    from lectern.plans import matching

    day = [datetime(2020, 1, k) for k in (1, 2, 3)]
    spark.createDataFrame([(1, 1, day[2]), (1, 1, day[2]), (1, 2, day[0])], "l_orderkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, day[1]), (1, day[2])], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in matching.join_table_cell_interval(spark, str(tmp_path)).collect()] == [(1, 1, 1)] * 4


# --- store and files ------------------------------------------------------------------------------
SCHEMA = "bank_id string, question_id string, question string, display_label string"


def test_store_keeps_ids_and_loses_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ids = ["007", "7", "a:b", "a/b", "x=y", "", "  ", "ü%", "1e5", "2020-01-01", "__HIVE_DEFAULT_PARTITION__"]
    rows = [(b, f"q{k}", f"text {b}", "") for b in ids for k in range(2)]
    assert store.save(spark.createDataFrame(rows, SCHEMA)) == len(rows)
    assert sorted(map(tuple, store.load().collect())) == sorted(rows)
    store.update(spark.createDataFrame([("007", "q0", "new", "")], SCHEMA), at=1)
    assert store.load("7").count() == 2 and store.load("007").filter("question = 'new'").count() == 1 and store.load().count() == len(rows)
    for b in ("a:b", "a/b", "007"):
        store.delete(b)
    assert {r["bank_id"] for r in store.load().collect()} == set(ids) - {"a:b", "a/b", "007"}
    before = sorted(map(tuple, store.load().collect()))
    with pytest.raises(ValueError):  # a write that fails leaves the bank
        store.save(spark.createDataFrame([("7", "q0", "bad", ""), ("7", "q0", "bad", "")], SCHEMA))
    broken = spark.createDataFrame([("7", "q0", "bad", "")], SCHEMA).withColumn("question", F.expr("raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        store.update(broken, at=2)
    assert sorted(map(tuple, store.load().collect())) == before and not store.can_undo("7", "q0")
    now = store._pointer()  # a second writer that read the same state
    store.rename("7", "seven")
    with pytest.raises(Conflict):
        store._switch(now, schema=now["schema"])
    assert store.vacuum() > 0 and sorted(map(tuple, store.load().collect())) == before


def test_files_above_their_cap_are_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(files.CAPS_MB, "txt", 0.001)
    (tmp_path / "small.txt").write_text("1. 什么？\n答案：文字\n", "utf-8")
    (tmp_path / "large.txt").write_text("x" * 5000)
    found = files.paragraphs(files.scan(spark, str(tmp_path))).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["error"]) for r in found} == {("small.txt", None), ("large.txt", "ValueError: larger than 0.001 MB")}


def test_files_through_the_file_system(spark, tmp_path):
    f, base = fs.Files(spark), str(tmp_path)
    assert f.create(f"{base}/a", b"one") and not f.create(f"{base}/a", b"two") and f.read(f"{base}/a") == b"one"
    f.write(f"{base}/a", b"three")
    f.copy(f"{base}/a", f"{base}/b")
    assert f.names(base) == ["a", "b"] and f.stat(f"{base}/b")["length"] == f.size(f"{base}/b") == 5
    from lectern.plans.fixtures import package

    assert f.unzip(package({"x/y.txt": "in"}), f"{base}/z") == ["x/y.txt"] and f.read(f"{base}/z/x/y.txt") == b"in"
    with pytest.raises(ValueError):
        f.unzip(package({"../out.txt": "no"}), f"{base}/z")
    assert not f.exists(f"{base}/out.txt")


def test_word_boxes_and_tables():
    from lectern.plans import fixtures as X

    inside = X.box(X.p("boxed"))
    got = [p["text"] for p in office.docx(X.docx(f"<w:p>{X.run('outside')}{X.either(inside, inside)}</w:p>", X.table([[X.table([["x"]]), "y"]])))]
    assert got == ["outside", "boxed", "x", "y"]


def test_random_tables_come_back():
    rnd = random.Random(8)
    from lectern.plans.fixtures import csv

    for _ in range(300):
        rows = [["".join(rnd.choice(string.ascii_letters + ',;"\n |') for _ in range(rnd.randint(0, 6))) or "x" for _ in range(3)] for _ in range(4)]
        for mark in texts.DELIMITERS:
            assert texts.table(csv(rows, mark), mark) == rows
