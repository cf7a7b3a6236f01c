"""Sequential logic as windows: ordinals, gaps, first duplicates, context that carries on, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, bucket: Column, first: int = 1) -> DataFrame:
    """Row numbers in order within each key, without one task for a whole key.

    ``bucket`` grows with the order (a range of it): rows are numbered within a bucket, and buckets
    get what the ones before hold from their counts, which are far fewer.
    """
    dealt = rows.withColumn("__bucket", bucket)
    parts = [*keys, "__bucket"]
    counts = dealt.groupBy(*parts).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n").toDF(*(f"__o{k}" for k in range(len(parts))), "__before")
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"__o{k}")) for k, c in enumerate(parts)]
    joined = dealt.withColumn("__place", place).join(offsets, same)
    return joined.withColumn(name, (F.col("__before") + F.col("__place") + (first - 1)).cast("int")).select(*rows.columns, name)


def runs(column: Column | str, size: int = 1024) -> Column:
    """Buckets of an integer order for :func:`numbered`."""
    return F.floor((F.col(column) if isinstance(column, str) else column) / size)


def ordinal(rows: DataFrame, keys: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def number_gaps(rows: DataFrame, keys: list[str], number: str, order: list[Column], most: int = 50) -> DataFrame:
    """Gaps of 1 to ``most`` missing numbers; the count starts anew at 1 or where numbers don't increase."""
    valid = rows.filter(F.col(number).between(1, 9999))
    prev = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    gap = F.col(number) - F.col("previous") - 1
    return valid.withColumn("previous", prev).withColumn("missing", gap).filter((F.col(number) != 1) & (F.col(number) > F.col("previous")) & F.col("missing").between(1, most))


def first_duplicates(rows: DataFrame, signature: Column, order: Column, id_col: str, least: int = 8) -> DataFrame:
    """``duplicate_of``: the first row with the same signature, for later rows; short signatures don't count.

    The first of each signature is an aggregate, so copies without end are one row where they meet.
    """
    signed = rows.withColumns({"__sig": signature, "__order": order})
    first = signed.filter(F.length("__sig") >= least).groupBy(F.md5("__sig").alias("__hash")).agg(F.min_by(id_col, F.struct("__order", id_col)).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    j = signed.withColumn("__hash", F.when(F.length("__sig") >= least, F.md5("__sig"))).join(first, "__hash", "left")
    return j.withColumn("duplicate_of", F.when(F.col("__first") != F.col(id_col), F.col("__first"))).select(*rows.columns, "duplicate_of")


def repeat_counts(rows: DataFrame, keys: list[str], compact: Column) -> DataFrame:
    """How often a paragraph's compact text occurs in its document: counted by aggregation and joined back,
    so that a line which a document repeats without end is a sum, not a group."""
    c = rows.withColumn("compact", compact)
    counts = c.groupBy(*keys, "compact").agg(F.count("*").alias("repeats"))
    return c.join(counts, [*keys, "compact"])


def carry_material(rows: DataFrame, keys: list[str], order: list[Column], starts: Column, ends: Column, value: Column, name: str) -> DataFrame:
    """The value of the last start that no end has followed: material holds up to its range's end or the next heading."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.when(starts, F.struct(value.alias("v"))).when(ends, F.struct(F.lit(None).cast("string").alias("v")))
    return rows.withColumn(name, F.last(state, ignorenulls=True).over(w)["v"])


def carry_forward(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sections(rows: DataFrame, keys: list[str], order: list[Column], starts: Column) -> DataFrame:
    """``section`` counts the headings so far, ``in_section`` numbers the rows after each."""
    w = Window.partitionBy(*keys).orderBy(*order)
    s = rows.withColumn("section", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.withColumn("in_section", F.row_number().over(Window.partitionBy(*keys, "section").orderBy(*order)))


def look_ahead(rows: DataFrame, keys: list[str], order: list[Column], hit: Column, width: int = 13, name: str = "evidence") -> DataFrame:
    """Whether one of the next ``width`` rows is a hit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, width)
    return rows.withColumn(name, F.coalesce(F.max(hit.cast("int")).over(w), F.lit(0)))


def resume(rows: DataFrame, key: str, status: Column, order: str = "ord") -> DataFrame:
    """Where to go on: the first unanswered row after the furthest completed one, else the first unanswered, else the last."""
    s = rows.withColumn("open", status == "unanswered")
    furthest = s.groupBy(key).agg(F.coalesce(F.max(F.when(~F.col("open"), F.col(order))), F.lit(0)).alias("furthest"))
    j = s.join(furthest, key)
    return j.groupBy(key).agg(
        F.max("furthest").alias("furthest"),
        F.coalesce(F.min(F.when(F.col("open") & (F.col(order) > F.col("furthest")), F.col(order))), F.min(F.when(F.col("open"), F.col(order))), F.max(order)).alias("resume_at"),
    )


def stable_order(order: Column, index: Column) -> Column:
    """The positive order, else the position."""
    return F.when(order > 0, order).otherwise(index + 1)
