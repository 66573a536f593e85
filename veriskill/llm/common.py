"""What the text operators share: input coercion, hold-out folds and scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

#: ASCII bytes that separate words of :data:`WORD_TABLE`: everything but 0-9 A-Z a-z; upper case becomes lower.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Lower-cases A-Z and keeps every other byte.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Labels whose counts are broadcast.
LABELS = 100_000
_cleaning: set[str] = set()
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the cluster's ``spark.checkpoint.dir``. Only a local master may do without: it gets a new temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/veriskill-{app}"


def _clean(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if root not in _cleaning:
        _cleaning.add(root)
        atexit.register(_clean, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    _clean(df.sparkSession, df._scratch_path)


def held_out(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id as text, modulo 5, is 0. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots too."""
    names = df.columns
    plain = [f"c{k}" for k in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, plain)

    found = df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, StructType([StructField(n, f.dataType) for n, f in zip(plain, schema, strict=True)]))
    return found.toDF(*(f.name for f in schema))


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def hash_sample(rows: DataFrame, group: str, h: str, most: int) -> DataFrame:
    """Rows of each group's smallest hashes, ``most`` of them at most.

    A hash limit from the group's count leaves about twice as many, so that no group is sorted whole.
    """
    counts = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_count")), "label-counts")
    counts = F.broadcast(counts) if counts.count() <= LABELS else counts
    part = F.pmod(F.xxhash64(h), F.lit(1 << 30)) * F.col("_count") < (most + 200) * 2.0 * (1 << 30)
    few = rows.join(counts, group).where(part).drop("_count")
    w = Window.partitionBy(group).orderBy(F.xxhash64(h), *(c for c in rows.columns if c != group))
    return few.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int, size: int, at: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``rows`` rows and, but for a longer single text, ``size`` bytes of column ``at``."""
    lengths = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (k - start >= rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
