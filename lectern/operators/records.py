"""Learning records folded from an append-only log of answers, progress and its cursors, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("bank_id", "question_id")


def wrong(answers: DataFrame) -> DataFrame:
    """Questions answered wrongly: how often and when last."""
    return answers.filter(~F.col("correct")).groupBy(*KEY).agg(F.count("*").alias("wrong_count"), F.max("ts").alias("last_wrong_at"))


def latest_flag(actions: DataFrame) -> DataFrame:
    """Keys whose latest action (``flag`` by ``ts``, then ``event_id``) set them, and since when."""
    last = actions.groupBy(*KEY).agg(F.max(F.struct("ts", "event_id", "flag")).alias("l"))
    return last.filter("l.flag").select(*KEY, F.col("l.ts").alias("since"))


def remove(records: DataFrame, gone: DataFrame) -> DataFrame:
    return records.join(gone.select(*KEY).distinct(), list(KEY), "left_anti")


def mirror_mastered(wrong_rows: DataFrame, mastered: DataFrame) -> DataFrame:
    """Wrong rows with the flag whether their question is mastered by now."""
    return wrong_rows.join(mastered.select(*KEY, F.lit(True).alias("m")), list(KEY), "left").withColumn("mastered", F.coalesce("m", F.lit(False))).drop("m")


def settings(stored: DataFrame, defaults: dict, choices: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """Defaults under stored values; values out of their choices or ranges go back or are clamped."""
    cols = []
    for name, default in defaults.items():
        value: Column = F.col(name) if name in stored.columns else F.lit(None)
        if choices and name in choices:
            value = F.when(value.isin(*choices[name]), value)
        if ranges and name in ranges:
            low, high = ranges[name]
            value = F.greatest(F.lit(low), F.least(F.lit(high), value))
        cols.append(F.coalesce(value, F.lit(default)).alias(name))
    return stored.select(*cols)


def bucket(answers: DataFrame, dimension: str) -> DataFrame:
    """Answered and correct by one dimension; blank keys count nowhere."""
    return answers.filter(F.col(dimension).isNotNull() & (F.col(dimension).cast("string") != "")).groupBy(F.col(dimension).cast("string").alias("key")).agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))


def buckets(answers: DataFrame, dimensions: tuple[str, ...] = ("day", "bank_id", "type_label", "difficulty", "category")) -> DataFrame:
    """All dimensions in one pass: each answer counts once for each of its keys."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions)))
    rows = answers.select(pairs.alias("b"), "correct").filter("b.key IS NOT NULL AND b.key <> ''")
    return rows.groupBy("b.dimension", "b.key").agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))


def cursor(progress: DataFrame) -> DataFrame:
    """The most recently updated cursor of each bank."""
    return progress.groupBy("bank_id").agg(F.max_by(F.struct(*[c for c in progress.columns if c != "bank_id"]), F.struct("ts", "event_id")).alias("c")).select("bank_id", "c.*")


def draft(snapshots: DataFrame) -> DataFrame:
    """The latest exam draft of each bank, if it has questions."""
    return cursor(snapshots)


def exams(answers: DataFrame, is_exam: Column) -> DataFrame:
    """How many exams each bank had."""
    return answers.filter(is_exam).groupBy("bank_id").agg(F.count("*").alias("exams"))


# --- progress -------------------------------------------------------------------------------------
def progress(saved: DataFrame) -> DataFrame:
    """Saved progress that may be taken up: the latest of each bank, if it was made in the questions' own order
    (``mode`` sequence) and is not empty."""
    return cursor(saved).filter((F.col("mode") == "sequence") & (F.col("answered") > 0))


def memorized(cursors: DataFrame, scope: str | None = None) -> DataFrame:
    """The latest cursor of each bank and scope, or of one scope."""
    rows = cursors if scope is None else cursors.filter(F.col("scope_key") == scope)
    rest = [c for c in cursors.columns if c not in ("bank_id", "scope_key")]
    return rows.groupBy("bank_id", "scope_key").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("c")).select("bank_id", "scope_key", "c.*")


def cleared(records: DataFrame, banks: list[str] | DataFrame | None = None) -> DataFrame:
    """Records without those of some banks (a list, or a table with bank_id), or without any."""
    if banks is None:
        return records.limit(0)
    if isinstance(banks, DataFrame):
        return records.join(banks.select("bank_id").distinct(), "bank_id", "left_anti")
    return records.filter(~F.col("bank_id").isin(banks)) if banks else records


# --- one payload for all --------------------------------------------------------------------------
def exported(records: dict[str, DataFrame]) -> DataFrame:
    """All records as rows (kind, bank_id, payload): a payload is a row's JSON."""
    from functools import reduce

    rows = [df.select(F.lit(kind).alias("kind"), "bank_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload")) for kind, df in records.items()]
    return reduce(DataFrame.unionByName, rows)


def imported(rows: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The records of such rows again, by kind; rows of other kinds are left out, a payload that is no JSON is an error."""
    out = {}
    for kind, schema in schemas.items():
        own = rows.filter(F.col("kind") == kind).select(F.from_json("payload", schema, {"mode": "FAILFAST"}).alias("r"))
        out[kind] = own.select("r.*")
    return out
