"""Views of the test tables as questions, learner events and learning records.

The tables are not the library's own; these views give them its shapes: a document is a question
(its source the bank, its language the category), an event is an answer.  Each has the same view in
SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, ("single", "multiple", "judge", "short"))), (F.col("doc_id") % 4 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("", "填空题", "计算题", "案例题", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.col("source").alias("bank_id"), F.col("doc_id").alias("question_id"), (F.col("doc_id") + 1).alias("ord"), F.col("lang").alias("category"), kind.alias("type"), label.alias("display_label"),
        F.when(F.col("n_chars") < 300, "").when(F.col("n_chars") < 2000, "简单").when(F.col("n_chars") < 8000, "中等").otherwise("困难").alias("difficulty"),
        (F.col("doc_id") % 89 == 0).alias("placeholder"),
        F.when(F.col("quality") == 0, "error").when(F.col("toxic") == 1, "warning").otherwise("normal").alias("status"),
        (100 - F.when(F.col("quality") == 0, 60).otherwise(0) - F.when(F.col("toxic") == 1, 30).otherwise(0) - F.col("n_chars") % 7).cast("int").alias("confidence_x100"),
        F.col("text").alias("question"), F.col("n_chars"),
    )


QUESTIONS = """q AS (SELECT source AS bank_id, d.doc_id AS question_id, d.doc_id + 1 AS ord, lang AS category,
  (['single','multiple','judge','short'])[(d.doc_id % 4 + 1)::INT] AS type, (['','填空题','计算题','案例题',''])[(d.doc_id % 5 + 1)::INT] AS display_label,
  CASE WHEN n_chars < 300 THEN '' WHEN n_chars < 2000 THEN '简单' WHEN n_chars < 8000 THEN '中等' ELSE '困难' END AS difficulty,
  d.doc_id % 89 = 0 AS placeholder,
  CASE WHEN quality = 0 THEN 'error' WHEN toxic = 1 THEN 'warning' ELSE 'normal' END AS status,
  (100 - CASE WHEN quality = 0 THEN 60 ELSE 0 END - CASE WHEN toxic = 1 THEN 30 ELSE 0 END - n_chars % 7)::INT AS confidence_x100,
  text AS question, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log of answers: one row for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("bank_id"), F.col("user_id").alias("learner_id"),
        (F.col("event_id") * 31 % 2000).alias("question_id"), (F.col("value") < 60).alias("correct"), F.col("event_type").alias("type_label"),
        F.when(F.col("value") < 10, "简单").when(F.col("value") < 80, "中等").when(F.col("value") < 200, "困难").otherwise("").alias("difficulty"),
        F.concat(F.lit("c"), (F.col("user_id") % 37).cast("string")).alias("category"), F.col("value"),
    )


ANSWERS = """a AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, 'src' || (user_id % 20) AS bank_id, user_id AS learner_id, event_id * 31 % 2000 AS question_id,
  value < 60 AS correct, event_type AS type_label,
  CASE WHEN value < 10 THEN '简单' WHEN value < 80 THEN '中等' WHEN value < 200 THEN '困难' ELSE '' END AS difficulty, 'c' || (user_id % 37) AS category, value FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Learning records folded from the log: wrong, mastered and favourite questions of each bank."""
    from lectern.operators import records as R

    a = answers(spark, sf_dir)
    return {
        "mastered": R.latest_flag(a.filter("type_label = 'purchase'").select("bank_id", "question_id", "ts", "event_id", F.col("correct").alias("flag"))),
        "favorite": R.latest_flag(a.filter("type_label = 'signup'").select("bank_id", "question_id", "ts", "event_id", F.col("correct").alias("flag"))),
        "wrong": R.wrong(a),
    }


def _latest(name: str, kind: str) -> str:
    return f"""{name} AS (SELECT bank_id, question_id, ts AS since FROM (SELECT *, row_number() OVER (PARTITION BY bank_id, question_id ORDER BY ts DESC, event_id DESC) AS k
  FROM a WHERE type_label = '{kind}') WHERE k = 1 AND correct)"""


MASTERED, FAVORITE = _latest("mastered", "purchase"), _latest("favorite", "signup")
WRONG = "wrong AS (SELECT bank_id, question_id, count(*) AS wrong_count, max(ts) AS last_wrong_at FROM a WHERE NOT correct GROUP BY ALL)"
RECORDS = ", ".join((ANSWERS, MASTERED, FAVORITE, WRONG))


def options(df: DataFrame, text: str = "question") -> DataFrame:
    """Pseudo options, answer and answer text of a question: two to four options share out all its words, and in each
    fifth question the last repeats the first."""
    words, n = F.split(F.col(text), " "), (F.col("question_id") % 3 + 2).cast("int")
    keys, none = F.array(*map(F.lit, "ABCD")), F.expr("cast(array() as array<string>)")
    again = F.col("question_id") % 5 == 0

    def option(j):
        own = F.when(again & (j == n - 1), 0).otherwise(j)
        return F.struct(F.element_at(keys, j + 1).alias("key"), F.array_join(F.filter("__words", lambda w, i: i % n == own), " ").alias("text"), none.alias("images"))

    answer = F.array_distinct(F.array(F.element_at(keys, (F.col("question_id") % 4 + 1).cast("int")), F.element_at(keys, (F.col("question_id") % 2 + 1).cast("int"))))
    out = df.withColumn("__words", words).withColumn("options", F.transform(F.sequence(F.lit(0), n - 1), option)).drop("__words")
    return out.withColumn("answer", answer).withColumn("answer_text", F.when(F.col("question_id") % 7 == 0, "").otherwise(F.col(text)))


OPTIONS = """o AS (SELECT *, list_transform(range(question_id % 3 + 2), lambda j: array_to_string(list_filter(string_split(question, ' '), lambda w, i: (i - 1) % (question_id % 3 + 2) = CASE WHEN question_id % 5 = 0 AND j = question_id % 3 + 1 THEN 0 ELSE j END), ' ')) AS opts,
  CASE WHEN question_id % 4 = question_id % 2 THEN [(['A','B'])[(question_id % 2 + 1)::INT]] ELSE [(['A','B','C','D'])[(question_id % 4 + 1)::INT], (['A','B'])[(question_id % 2 + 1)::INT]] END AS answer,
  CASE WHEN question_id % 7 = 0 THEN '' ELSE question END AS answer_text FROM q)"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their index in the document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


PARAGRAPHS = """p AS (SELECT doc_id, source, (i - 1)::INT AS idx, lines[i] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i))"""
