"""Counts, accuracies and rankings over questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(correct: Column, answered: Column) -> Column:
    """Per cent, halves rounded up; 0 where nothing was answered."""
    return F.when(answered > 0, F.floor(100.0 * correct / answered + 0.5)).otherwise(0).cast("long")


def with_accuracy(counts: DataFrame) -> DataFrame:
    return counts.withColumn("accuracy", accuracy(F.col("correct"), F.col("answered")))


def metric(rows: DataFrame, by: str, correct: Column) -> DataFrame:
    return with_accuracy(rows.groupBy(by).agg(F.count("*").alias("answered"), F.sum(correct.cast("long")).alias("correct")))


def seeded_counts(rows: DataFrame, by: Column, seed: tuple[str, ...], name: str) -> DataFrame:
    """Counts by a column, with zeros for the seed's values that don't occur."""
    counts = rows.groupBy(by.alias(name)).agg(F.count("*").alias("n"))
    zeros = rows.sparkSession.createDataFrame([(s,) for s in seed], f"{name} string").withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(zeros).groupBy(name).agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """Answered buckets, most answered first, then the least accurate, then by key."""
    return with_accuracy(counts.filter("answered > 0"))


def ranking(counts: DataFrame) -> DataFrame:
    """All answered buckets with their rank: most answered first, then the least accurate, then by key."""
    from lectern.operators.sequence import numbered

    return numbered(ranked(counts), [], [F.desc("answered"), F.asc("accuracy"), F.asc("key")], "rank", -F.col("answered"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with their rank; Spark keeps n rows a partition."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def manifest(questions: DataFrame) -> DataFrame:
    real = ~F.col("placeholder")
    return questions.groupBy("bank_id").agg(
        F.count("*").alias("question_count"), F.count_if(real & (F.col("status") != "error")).alias("usable_count"), F.count_if(real).alias("content_count"), F.count_if("placeholder").alias("missing_count")
    )


def exam_score(items: DataFrame) -> DataFrame:
    """Per session: objective questions, answered and correct ones, short ones; unanswered ones count in the accuracy."""
    objective = F.col("type") != "short"
    s = items.groupBy("session_id").agg(
        F.count_if(objective).alias("objective_total"), F.count_if(objective & F.col("correct").isNotNull()).alias("answered"),
        F.count_if(objective & F.coalesce("correct", F.lit(False))).alias("correct"), F.count_if(~objective).alias("short_count"),
    )
    return s.withColumn("accuracy", accuracy(F.col("correct"), F.col("objective_total")))


def status_counts(questions: DataFrame) -> DataFrame:
    """One row: questions, normal ones, warnings and errors, those that a session may show, and placeholders."""
    status, gap = F.coalesce("status", F.lit("normal")), F.coalesce("placeholder", F.lit(False))
    return questions.agg(
        F.count("*").alias("total"), *(F.count_if(status == s).alias(s) for s in ("normal", "warning", "error")), F.count_if(~gap & (status != "error")).alias("usable"), F.count_if(gap).alias("missing"),
    )


def merged(first: Column, *later: Column) -> Column:
    """Diagnostics as one map; what a later one says of a counter counts."""
    none = F.expr("cast(map() as map<string,bigint>)")

    def over(below: Column, above: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)

    out = F.coalesce(first, none)
    for m in later:
        out = over(out, F.coalesce(m, none))
    return out


def layouts(paragraphs: DataFrame, key: str = "path") -> DataFrame:
    """Per document: how many of its lines have which form, and the layout they make."""
    from lectern.operators.parser import diagnostics

    return diagnostics(paragraphs, key).select("doc_id", "layout", "paragraphs", "indexed_typed", "indexed", "numbered", "bare_numbered", "labelled", "option_lines", "answer_lines", "type_headings", "table_like")
