"""A small bank to try things with: one question of each core type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.validate import validate

_SCHEMA = "bank_id string, question_id string, ord int, type string, display_label string, question string, options array<struct<key:string,text:string,images:array<string>>>, answer array<string>, answer_text string, placeholder boolean"
_ROWS = [
    ("demo", "demo_1", 1, "single", "单选题", "一周有几天？", [("A", "五天", []), ("B", "七天", [])], ["B"], "", False),
    ("demo", "demo_2", 2, "multiple", "多选题", "下列哪些是偶数？", [("A", "二", []), ("B", "三", []), ("C", "四", [])], ["A", "C"], "", False),
    ("demo", "demo_3", 3, "judge", "判断题", "太阳从东方升起。", [("A", "正确", []), ("B", "错误", [])], ["A"], "", False),
    ("demo", "demo_4", 4, "short", "简答题", "请写出四季的名称。", [], [], "春、夏、秋、冬", False),
]


def bank(spark: SparkSession) -> DataFrame:
    """Its validated questions."""
    return validate(spark.createDataFrame(_ROWS, _SCHEMA))
