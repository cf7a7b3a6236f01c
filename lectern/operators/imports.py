"""Files of any known kind to questions, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import parser, tabular, word
from lectern.sources import files


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Validated questions of all files under a path: of their text, of their tables, and of Word files of both."""
    found = files.scan(spark, path)
    words = F.col("kind").isin(*files.WORD)
    texts, cells = files.paragraphs(found).filter("error IS NULL"), files.cells(found).filter("error IS NULL")
    of_word = word.questions(texts.filter(words), cells.filter(words))
    of_text = parser.questions(texts.filter(~words).withColumn("source_name", F.regexp_extract("path", r"([^/\\\\]+)\z", 1))).withColumnRenamed("doc_id", "path")
    of_tables = tabular.questions(cells.filter(~words))
    return of_word.unionByName(of_text, allowMissingColumns=True).unionByName(of_tables, allowMissingColumns=True)


def errors(spark: SparkSession, path: str) -> DataFrame:
    """Files that could not be read, and why."""
    found = files.scan(spark, path)
    return files.paragraphs(found).select("path", "kind", "error").unionByName(files.cells(found).select("path", "kind", "error")).filter("error IS NOT NULL").distinct()
