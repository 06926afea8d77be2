"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and all runs on this machine (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _own:
        _own["folder"] = f"file://{tempfile.mkdtemp(prefix='pointweave-')}"
    return _own["folder"]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, unless the session says otherwise: whole texts are long, and Python workers share an executor's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps whose tables are written.

    Python's handles go, then the JVM's, then the files, each in a thread of its own. The first one looks
    for handles once a second; what the last step ran is often held until the JVM collects a second time;
    the last one asks all executors about one broadcast after the other before it comes to the shuffles.
    """
    gc.collect()
    for wait in (1.5, 0.5):
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        time.sleep(3)


def in_order(df: DataFrame) -> bool:
    """Whether a task that runs again meets its rows in the same order: the plan only reads, picks and computes."""
    nodes = re.findall(r"^[\s:+-]*([A-Za-z]+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return set(nodes) <= {"Project", "Filter", "Relation", "LocalRelation", "Range"}


class Workspace:
    """A folder of written tables: lineage ends there, and a lost executor costs one task at most.

    The tables stay until the session ends, since the DataFrame that an operator returns reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_folder(spark)}/pointweave-{name}-{uuid.uuid4().hex}", 0
        small_batches(spark)
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that is read no more."""
        for path in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
            delete(self.spark, path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):
            delete(self.spark, self.path)
