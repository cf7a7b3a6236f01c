"""A session with the settings this library expects."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python finds it
    wherever the driver was started; on a cluster Spark's own file server carries it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    path = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with open(path, "wb") as file:
        file.write(out.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own where all executors and the driver can write: under ``spark.checkpoint.dir``, or where all
    runs in one process, a temporary one.  Folders go when the driver's Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        shared = tempfile.mkdtemp(prefix="lectern-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        except Exception:  # noqa: BLE001  (the JVM may be gone, and its folder with it)
            return

    atexit.register(drop)
    return path


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g", app: str = "lectern") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
