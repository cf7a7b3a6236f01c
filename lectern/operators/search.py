"""Search and review: exact matches before subsequences, and facets that narrow in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import subsequence


def search(rows: DataFrame, text: str, keyword: str) -> DataFrame:
    """Rows that hold the keyword (rank 0) or its characters in order (rank 1)."""
    if len(keyword) < 2:
        return rows.limit(0).withColumn("rank", F.lit(0))
    exact = F.col(text).contains(keyword)
    return rows.filter(exact | subsequence(F.col(text), keyword)).withColumn("rank", F.when(exact, 0).otherwise(1))


def facets(rows: DataFrame, status: str = "abnormal", confidence: str = "all", kind: str = "all") -> DataFrame:
    """``(facet, key, n)``: confidence within the status, issue kinds within both, types within all three."""
    base = rows if status == "all" else rows.filter("status <> 'normal'") if status == "abnormal" else rows.filter(F.col("status") == status)
    by_conf = base.groupBy(F.col("bucket").alias("key")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("confidence"))
    held = base if confidence == "all" else base.filter(F.col("bucket") == confidence)
    by_kind = held.select(F.explode("kinds").alias("key")).groupBy("key").agg(F.count("*").alias("n")).withColumn("facet", F.lit("issue"))
    typed = held if kind == "all" else held.filter(F.array_contains("kinds", kind))
    by_type = typed.groupBy(F.col("type_label").alias("key")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("type"))
    return by_conf.unionByName(by_kind).unionByName(by_type).select("facet", "key", "n")


def review(rows: DataFrame, status: str = "abnormal", confidence: str = "all", kind: str = "all", label: str = "all", keyword: str = "") -> DataFrame:
    """Rows that a reviewer looks at: by status, bucket of confidence, kind of issue, type, and a word of the text."""
    out = rows if status == "all" else rows.filter("status <> 'normal'") if status == "abnormal" else rows.filter(F.col("status") == status)
    if confidence != "all":
        out = out.filter(F.col("bucket") == confidence)
    if kind != "all":
        out = out.filter(F.array_contains("kinds", kind))
    if label != "all":
        out = out.filter(F.col("type_label") == label)
    return out.filter(F.lower("question").contains(keyword.lower())) if keyword else out
