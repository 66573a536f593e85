"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def _clean(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def shared_root(spark: SparkSession) -> str:
    """A folder of the application in ``spark.checkpoint.dir``, deleted when it ends; only a local master may do without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _roots[app] = f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/veriskill-tables-{app}"
        atexit.register(_clean, spark, _roots[app])
    return _roots[app]


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends there, and it is computed once."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def freed(table: DataFrame, value):
    """``value``, after deleting a table of :func:`written` that nothing reads any more."""
    if path := getattr(table, "_written_to", None):
        _clean(table.sparkSession, path)
    return value
