"""What the operators of this subpackage share: reading tables, staging, ids through Arrow, hashing."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship

#: Rows in one Arrow batch handed to Python.  Texts are long, so this is far below Spark's default
#: of 10,000: a worker holds one batch and its results at a time.
ARROW_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, and see that the executors have this package.

    Spark reads the batch size when a plan runs, so the session's setting stays lowered (a smaller
    one of the user's stays as it is).
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def in_pandas(df: DataFrame, run, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df.mapInPandas(run, schema)`` with exact ids: long columns of ``ids`` cross as text.

    Beside a null, pandas would hold longs as doubles, which part from longs above 2**53.  ``run``
    sees such an id as a string or None and returns it as it came.
    """
    bounded_batches(df.sparkSession)
    longs = [c for c in ids if re.search(rf"\b{c} long\b", schema)]
    there = [F.col(c).cast("string").alias(c) if c in longs else F.col(c) for c in df.columns]
    crossing = re.sub(rf"\b({'|'.join(longs)}) long\b", r"\1 string", schema) if longs else schema
    out = df.select(*there).mapInPandas(run, crossing)
    return out.select(*(F.col(c).cast("long").alias(c) if c in longs else F.col(c) for c in out.columns))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``(doc_id, text)`` with null texts empty, and the type of ``doc_id``: string if it is one, else long."""
    kind = "string" if docs.schema[id_col].dataType.simpleString() == "string" else "long"
    return docs.select(F.col(id_col).cast(kind).alias("doc_id"), text_or_empty(text_col).alias("text")), kind


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and all runs in one process (tests) a local folder
    takes its place; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "lectern-checkpoints"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: folders that :func:`staged` wrote and :func:`unstage` has not deleted yet, with what deletes them
_LEFT: dict[str, tuple] = {}


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read of these files, not of what made them.  What
    nobody deletes by :func:`unstage` goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _LEFT[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete what :func:`staged` wrote, once nothing reads it any more."""
    for df in frames:
        _delete(df.__dict__.get("_staged_at"))


def _delete(path: str | None) -> None:
    if path in _LEFT:
        jvm, conf = _LEFT.pop(path)
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@atexit.register
def _sweep() -> None:
    for path in list(_LEFT):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  (the JVM may be gone, and its folder with it)
            return


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column."""
    while name in df.columns:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc32_id(column: Column) -> Column:
    """crc32 of an id written as text, the split that held-out rows are defined by."""
    return F.crc32(column.cast("string").cast("binary"))
