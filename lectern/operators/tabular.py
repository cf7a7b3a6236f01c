"""Question tables: cells (path, sheet, row, col, value, and images if there are) to questions, by column expressions.

Header rows are found by scoring the roles of their cells, then each row below becomes a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import question as Q
from lectern.functions.text import normalize, one_line
from lectern.operators.validate import validate

KEY = ["path", "sheet"]
#: Points of a header's roles, and how many rows are looked at.
POINTS, OTHER, OPTION, TWO_OPTIONS, HEADER_ROWS = {"question": 5.0, "answer": 3.0, "type": 2.0}, 1.0, 1.1, 2.0, 35


def headers(cells: DataFrame) -> DataFrame:
    """``(path, sheet, row, roles)`` of each sheet's best header row: a map of role to column; the earliest of equals."""
    position = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("row"))
    head = cells.withColumn("position", position).filter(F.col("position") <= HEADER_ROWS)
    roles = head.select(*KEY, "row", "col", Q.header_class(F.col("value")).alias("role")).filter("role IS NOT NULL")
    first = roles.groupBy(*KEY, "row", "role").agg(F.min("col").alias("col"))
    points = F.lit(OTHER)
    for role, n in POINTS.items():
        points = F.when(F.col("role") == role, n).otherwise(points)
    points = F.when(F.col("role").startswith("option:"), OPTION).otherwise(points)
    rows = first.groupBy(*KEY, "row").agg(F.sum(points).alias("points"), F.count_if(F.col("role").startswith("option:")).alias("options"), F.map_from_entries(F.collect_list(F.struct("role", "col"))).alias("roles"))
    has = lambda role: F.map_contains_key("roles", role)
    rows = rows.filter(has("question") & (has("answer") | has("type") | (F.col("options") >= 2)))
    score = F.col("points") + F.when(F.col("options") >= 2, TWO_OPTIONS).otherwise(0.0)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("row", "roles"), F.struct(F.round(score, 4), -F.col("row"))).alias("h")).select(*KEY, F.col("h.row").alias("row"), F.col("h.roles").alias("roles"))


def difficulty_column(cells: DataFrame, found: DataFrame) -> DataFrame:
    """The unmapped column with three or more values of which 60 % are words of difficulty, in the 80 rows below."""
    words = [w for ws in Q.DIFFICULTY_WORDS.values() for w in ws]
    below = cells.join(found.select(*KEY, F.col("row").alias("head"), F.map_values("roles").alias("used")), KEY).filter((F.col("row") > F.col("head")) & ~F.array_contains("used", F.col("col")))
    near = below.withColumn("k", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("row"))).filter("k <= 80")
    counts = near.groupBy(*KEY, "col").agg(F.count("*").alias("n"), F.count_if(one_line(F.col("value")).isin(*words)).alias("d")).filter("n >= 3 AND d / n >= 0.6")
    return counts.groupBy(*KEY).agg(F.max_by("col", F.struct(F.col("d") / F.col("n"), F.col("d"), -F.col("col"))).alias("difficulty_col"))


def answer_keys(raw: Column, keys: Column, truths: Column, kind: Column) -> Column:
    """Keys an answer cell names: all of them, a truth value's option, or letters among the options."""
    clean = F.upper(one_line(raw))
    letters = F.array_distinct(F.filter(F.split(F.regexp_replace(clean, "[^A-L]", ""), ""), lambda c: c != ""))
    value = Q.truth(raw, table=True)
    own = F.coalesce(F.get(F.filter(F.arrays_zip(keys.alias("k"), truths.alias("t")), lambda z: z["t"] == value), F.lit(0))["k"], F.when(value, "A").otherwise("B"))
    named = F.filter(letters, lambda c: F.array_contains(keys, c))
    return F.when(clean.isin("全选", "全部", "全部正确", "以上都是", "均正确", "ALL"), keys).when((kind == "judge") & value.isNotNull(), F.array(own)).otherwise(named)


def questions(cells: DataFrame) -> DataFrame:
    """Validated questions of all sheets that have a header; rows without a question are left out."""
    found = headers(cells).join(difficulty_column(cells, headers(cells)), KEY, "left")
    none = F.expr("cast(array() as array<string>)")
    shown = F.coalesce(F.col("images"), none) if "images" in cells.columns else none
    rows = cells.groupBy(*KEY, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("c"), F.map_from_entries(F.collect_list(F.struct("col", shown.alias("images")))).alias("i"))
    j = rows.join(found.withColumnRenamed("row", "head"), KEY).filter(F.col("row") > F.col("head"))

    def cell(role: str) -> Column:
        return F.coalesce(F.try_element_at("c", F.try_element_at("roles", F.lit(role))), F.lit(""))

    def pictures(role: str) -> Column:
        return F.coalesce(F.try_element_at("i", F.try_element_at("roles", F.lit(role))), none)

    options = F.array(*(F.struct(F.lit(k).alias("key"), normalize(cell(f"option:{k}")).alias("text"), pictures(f"option:{k}").alias("images")) for k in "ABCDEFGHIJKL"))
    options = F.filter(options, lambda o: (o["text"] != "") | (F.size(o["images"]) > 0))
    kind, label = Q.type_of_label(cell("type"))
    j = j.withColumn("options", options).withColumn("answer_cell", cell("answer")).withColumn("kind", kind).withColumn("display_label", F.coalesce(label, F.lit("")))
    truths = F.transform("options", lambda o: Q.truth(o["text"], table=True))
    # without a type: truth values are judgements, two letters or more a multiple choice, options a single one
    value = Q.truth(F.col("answer_cell"), table=True)
    several = F.length(F.regexp_replace(F.upper("answer_cell"), "[^A-L]", "")) > 1
    guess = F.when(value.isNotNull() & (F.size("options") <= 2), "judge").when(F.size("options") == 0, "short").when(several, "multiple").otherwise("single")
    j = j.withColumn("type", F.coalesce("kind", guess))
    judged = F.from_json(F.lit('[{"key":"A","text":"正确","images":[]},{"key":"B","text":"错误","images":[]}]'), "array<struct<key:string,text:string,images:array<string>>>")
    j = j.withColumn("options", F.when((F.col("type") == "judge") & (F.size("options") == 0), judged).when(F.col("type") == "short", F.slice("options", 1, 0)).otherwise(F.col("options")))
    answer = F.when(F.col("type") == "short", F.expr("cast(array() as array<string>)")).otherwise(answer_keys(F.col("answer_cell"), F.transform("options", lambda o: o["key"]), F.transform("options", lambda o: Q.truth(o["text"], table=True)), F.col("type")))
    hard = Q.difficulty(F.coalesce(F.when(cell("difficulty") != "", cell("difficulty")), F.try_element_at("c", F.col("difficulty_col")), F.lit("")))
    out = j.select(
        *KEY, "row", cell("number").alias("number"), "type", "display_label", normalize(cell("question")).alias("question"), "options", answer.alias("answer"),
        F.when(F.col("type") == "short", normalize(F.col("answer_cell"))).otherwise("").alias("answer_text"), normalize(cell("analysis")).alias("analysis"), hard.alias("difficulty"), normalize(cell("category")).alias("category"),
        pictures("question").alias("images"), pictures("answer").alias("answer_images"), pictures("analysis").alias("analysis_images"),
    ).filter("question <> '' OR size(images) > 0")
    order = F.row_number().over(Window.partitionBy("path").orderBy("sheet", "row"))
    return validate(out.withColumn("ord", order))


def category(sheet: Column, explicit: Column, several: Column, label: Column) -> Column:
    """A row's category: its own, after the sheet's name where the book has several sheets, else the type's label."""
    from lectern.functions.text import compact

    own, name = one_line(F.coalesce(explicit, F.lit(""))), one_line(F.coalesce(sheet, F.lit("")))
    alone = F.coalesce(F.when(own != "", own), label)
    both = F.when((own != "") & (compact(own) != compact(name)), F.concat(name, F.lit(" · "), own)).otherwise(F.coalesce(F.when(name != "", name), F.when(own != "", own), label))
    return F.when(several, both).otherwise(alone)


def declared_counts(cells: DataFrame) -> DataFrame:
    """``(path, label, declared)`` of summary tables: a header row with the word for type, then a row of counts."""
    value = one_line(F.col("value"))
    rows = cells.select(*KEY, "row", "col", value.alias("v"))
    heads = rows.filter(F.col("v").isin("题型", "类型")).select(*KEY, F.col("row").alias("head")).distinct()
    # the next row that has cells
    after = rows.join(heads, KEY).filter(F.col("row") > F.col("head")).groupBy(*KEY, "head").agg(F.min("row").alias("next"))
    labels = rows.join(after, KEY).filter(F.col("row") == F.col("head")).select(*KEY, "head", "next", "col", F.col("v").alias("label"))
    first = labels.groupBy(*KEY, "head").agg(F.min("col").alias("first"))
    counts = rows.join(after, KEY).filter(F.col("row") == F.col("next")).select(*KEY, "head", "col", "v")
    named = counts.join(first, [*KEY, "head"]).filter((F.col("col") == F.col("first")) & F.col("v").isin("数量", "题数", "合计")).select(*KEY, "head")
    number = F.expr("try_cast(replace(v, ',', '') AS double)")
    return labels.join(named, [*KEY, "head"]).join(counts, [*KEY, "head", "col"]).withColumn("declared", number).filter("label <> '' AND declared > 0").select("path", "label", F.col("declared").cast("long").alias("declared"))


def reconcile(declared: DataFrame, questions: DataFrame) -> DataFrame:
    """Declared against found counts per label; labels that differ only in punctuation count as one."""
    from lectern.functions.text import compact

    found = questions.groupBy("path", compact(F.col("display_label")).alias("mark")).agg(F.count("*").alias("found"))
    d = declared.filter(~F.col("label").isin("合计", "总计")).withColumn("mark", compact(F.col("label")))
    return d.join(found, ["path", "mark"], "left").select("path", "label", "declared", F.coalesce("found", F.lit(0)).alias("found"), (F.col("declared") - F.coalesce("found", F.lit(0))).alias("missing"))
