"""Questions of Word files: from their text and from their tables, in the order of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import parser, tabular


def by_place(*questions: DataFrame, key: str = "path") -> DataFrame:
    """Questions of several readings of a document in the order of where they start (column ``start``), numbered anew."""
    out = questions[0]
    for other in questions[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col("start").asc_nulls_last(), "ord")
    return out.withColumn("ord", F.row_number().over(order)).drop("start")


def questions(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """Validated questions of Word files' paragraphs and cells; a table that gave questions is not read as text."""
    of_tables = tabular.questions(cells)
    used = of_tables.select("path", F.regexp_extract("sheet", r"([0-9]+)\z", 1).cast("int").alias("table_id")).distinct()
    places = paragraphs.filter("table_id IS NOT NULL").groupBy("path", "table_id", (F.col("table_row") + 1).alias("row")).agg(F.min("index").alias("start"))
    of_tables = of_tables.withColumn("table_id", F.regexp_extract("sheet", r"([0-9]+)\z", 1).cast("int")).join(places, ["path", "table_id", "row"], "left").drop("table_id")
    of_text = parser.questions(paragraphs.join(used, ["path", "table_id"], "left_anti")).withColumnRenamed("doc_id", "path")
    return by_place(of_text.withColumn("start", F.array_min("paragraphs")), of_tables)
