"""Sources, tables and the parser over the test tables (survey sections 2.1 and 2.8.2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import tabular
from lectern.plans import views as v
from lectern.plans.registry import query


def cells(spark, d):
    """The parts as question tables: a sheet per brand, a header row, then a part per row."""
    labels = F.element_at(F.array(*map(F.lit, ("单选题", "多选题", "判断题", "简答题"))), (F.col("p_size") % 4 + 1).cast("int"))
    words = F.split("p_type", " ")
    value = {1: F.col("p_partkey").cast("string"), 2: labels, 3: F.col("p_name"), 4: F.get(words, F.lit(0)), 5: F.get(words, F.lit(1)), 6: F.when(F.col("p_size") % 4 == 2, "对").when(F.col("p_size") % 4 == 1, "AB").otherwise("B"), 7: F.when(F.col("p_size") < 20, "易").otherwise("难")}
    part = v.table(spark, d, "part").withColumn("row", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1)
    body = part.select(F.lit("part").alias("path"), F.col("p_brand").alias("sheet"), "row", F.explode(F.array(*(F.struct(F.lit(k).alias("col"), x.alias("value")) for k, x in value.items()))).alias("c")).select("path", "sheet", "row", "c.col", "c.value").filter("value IS NOT NULL")
    heads = F.explode(F.array(*(F.struct(F.lit(k).alias("col"), F.lit(t).alias("value")) for k, t in enumerate(("序号", "题型", "题干", "选项A", "选项B", "答案"), 1))))
    head = part.select("p_brand").distinct().select(F.lit("part").alias("path"), F.col("p_brand").alias("sheet"), F.lit(1).alias("row"), heads.alias("c")).select("path", "sheet", "row", "c.col", "c.value")
    return head.unionByName(body)


@query("tab_header_detect", "SELECT DISTINCT p_brand AS sheet, 1 AS row, 6::BIGINT AS roles FROM part")
def tab_header_detect(spark, d):
    return tabular.headers(cells(spark, d)).select("sheet", "row", F.size("roles").cast("long").alias("roles"))


@query("tab_difficulty_col", "SELECT p_brand AS sheet, 7 AS difficulty_col FROM part GROUP BY 1 HAVING count(*) >= 3")
def tab_difficulty_col(spark, d):
    c = cells(spark, d)
    return tabular.difficulty_column(c, tabular.headers(c)).select("sheet", "difficulty_col")


@query("tab_row_question", "SELECT p_partkey::VARCHAR AS number, p_name AS question, (['single','multiple','judge','short'])[(p_size % 4 + 1)::INT] AS type, CASE WHEN p_size < 20 THEN '简单' ELSE '困难' END AS difficulty FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 3)")
def tab_row_question(spark, d):
    c = cells(spark, d)
    q = tabular.questions(c)
    large = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("sheet")).count().filter("count >= 3").select("sheet")
    return q.join(large, "sheet", "left_semi").select("number", "question", "type", "difficulty")
