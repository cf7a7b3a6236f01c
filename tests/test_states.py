from pyspark.sql import functions as F

from lectern.operators import records as R
from lectern.operators import repair, states

OPTIONS = "array<struct<key:string,text:string,images:array<string>>>"


def test_restore_by_text_and_regrade(spark):
    opts = [("A", "乙", []), ("B", "甲", [])]
    rows = [(1, "single", opts, ["B"], ["A"], ["甲"]), (2, "single", opts, ["A"], ["B"], []), (3, "single", opts, ["A"], ["C"], ["别的"]), (4, "short", [], [], [], [])]
    df = spark.createDataFrame(rows, f"id int, type string, options {OPTIONS}, answer array<string>, selected array<string>, selected_texts array<string>")
    got = {r["id"]: (r["now"], r["regraded"]) for r in states.restore(df).collect()}
    assert got == {1: (["B"], True), 2: (["B"], False), 3: ([], None), 4: ([], None)}


def test_remap_and_signature(spark):
    before, after = [("A", "x", []), ("B", "y", ["i"]), ("C", "z", [])], [("A", "y", ["i"]), ("B", "new", []), ("C", "x", [])]
    df = spark.createDataFrame([(["A", "B", "C", "D"], before, after)], f"s array<string>, b {OPTIONS}, a {OPTIONS}")
    assert df.select(states.remap_options(F.col("s"), F.col("b"), F.col("a")).alias("r")).first()["r"] == ["C", "A"]
    sig = lambda a: states.edit_signature(F.lit("single"), F.lit("q"), F.array().cast("array<string>"), F.col("b"), a, F.lit(None).cast("string"))
    row = df.select(sig(F.array(F.lit("B"), F.lit("A"))).alias("x"), sig(F.array(F.lit("A"), F.lit("B"))).alias("y")).first()
    assert row["x"] == row["y"] and '"answer":["A","B"]' in row["x"]


def test_states_kept_and_cursors(spark):
    df = spark.createDataFrame([(1, ["A"], False, [("A", "x", [])]), (2, [], True, []), (3, [], False, [])], f"id int, selected array<string>, revealed boolean, options {OPTIONS}")
    assert {r["id"]: r["selected_texts"] for r in states.build(df).collect()} == {1: ["x"], 2: []}
    scoped = spark.createDataFrame([("b1", "all|0", 5), ("b1", "judge|0", 2)], "bank_id string, scope_key string, last_order int")
    old = spark.createDataFrame([("b1", 9), ("b2", 3)], "bank_id string, last_order int")
    assert {r["bank_id"]: r["last_order"] for r in states.cursor_for(scoped, old, "all|0").collect()} == {"b1": 5, "b2": 3}
    assert states.clear_scope(scoped, "all|0").count() == 1


def test_repairs(spark):
    schema = f"id int, type string, question string, options {OPTIONS}, answer array<string>, answer_text string"
    rows = [
        (1, "short", "什么是它？因为它是一个很好的东西", [], [], ""), (2, "short", "什么是它？还是那一个呢？", [], [], ""), (3, "judge", "这是一个说法", [("A", "错误", [])], [], ""),
        (4, "choice_error", "选哪一个", [("A", "甲", []), ("B", "乙", [])], ["A", "B"], ""), (5, "multiple", "选哪一个", [("A", "对", []), ("B", "错", [])], ["A"], ""),
    ]
    df = spark.createDataFrame(rows, schema)
    split = {r["id"]: (r["question"], r["answer_text"]) for r in repair.short_answers(df).collect()}
    assert split[1] == ("什么是它？", "因为它是一个很好的东西") and split[2][1] == ""
    fixed = {r["id"]: (r["type"], r["answer"], r["status"]) for r in repair.choices(df).collect()}
    assert fixed[3] == ("judge", ["B"], "normal") and fixed[4][0] == "multiple" and fixed[5][0] == "judge"


def test_images_and_settings(spark):
    df = spark.createDataFrame([("b", ["a.png"], ["m.png"], [("A", "x", ["o.png", "a.png"])])], f"bank_id string, images array<string>, material_images array<string>, options {OPTIONS}")
    moved = repair.images(df, lambda p: F.concat(F.lit("new/"), p))
    assert {r["image"] for r in repair.referenced_images(moved).collect()} == {"new/a.png", "new/m.png", "new/o.png"}
    stored = spark.createDataFrame([("dark", 99, None)], "theme string, size int, count int")
    got = R.settings(stored, {"theme": "light", "size": 16, "count": 20, "extra": True}, choices={"theme": ["light"]}, ranges={"size": (12, 24)}).first()
    assert tuple(got) == ("light", 24, 20, True)


def test_saved_sequence(spark):
    from lectern.operators import sessions

    qs = spark.createDataFrame([("b", f"q{i}", "k" if i in (3, 5) else f"k{i}", i) for i in range(1, 7)], "bank_id string, question_id string, key string, ord int")
    saved = spark.createDataFrame([("b", 1, "q4", "", 0), ("b", 2, "gone", "k", 6), ("b", 3, "gone", "k", 6), ("b", 4, "gone", "no", 2), ("b", 5, "gone", "no", 4)], "bank_id string, pos int, question_id string, key string, ord int")
    got = [r["question_id"] for r in sessions.saved_sequence(qs, saved, "s").orderBy("position").collect()]
    assert got[:4] == ["q4", "q5", "q3", "q2"] and sorted(got[4:]) == ["q1", "q6"]


def test_tables(spark):
    from lectern.functions import question as Q
    from lectern.operators import tabular

    rows = [("p", "S", 1, 1, "题型"), ("p", "S", 1, 2, "单选题"), ("p", "S", 1, 3, "判断题"), ("p", "S", 3, 1, "数量"), ("p", "S", 3, 2, "1,200"), ("p", "S", 3, 3, "5"), ("p", "T", 1, 1, "题型"), ("p", "T", 2, 1, "单选题")]
    cells = spark.createDataFrame(rows, "path string, sheet string, row int, col int, value string")
    declared = tabular.declared_counts(cells)
    assert {(r["label"], r["declared"]) for r in declared.collect()} == {("单选题", 1200), ("判断题", 5)}
    qs = spark.createDataFrame([("p", "单选题"), ("p", "单选题")], "path string, display_label string")
    assert {r["label"]: r["missing"] for r in tabular.reconcile(declared, qs).collect()} == {"单选题": 1198, "判断题": 5}
    df = spark.createDataFrame([("D. x A. 甲 B、乙；C)丙 E.丁",)], "t string")
    assert [(o["key"], o["text"]) for o in df.select(Q.combined_options(F.col("t")).alias("o")).first()["o"]] == [("A", "甲"), ("B", "乙；"), ("C", "丙 E.丁")]
    c = spark.createDataFrame([("S", "章", True), ("S", "s", True), ("S", "", False)], "s string, e string, m boolean")
    assert [r["c"] for r in c.select(tabular.category(F.col("s"), F.col("e"), F.col("m"), F.lit("单选题")).alias("c")).collect()] == ["S · 章", "S", "单选题"]
