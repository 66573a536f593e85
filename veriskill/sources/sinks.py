"""Sinks: forecasts, metric tables, bundles, run metadata and cached results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriskill.operators.events import tails


def save_forecast(fields: DataFrame, var_dim: DataFrame, path: str, leads: tuple[int, int] | None = None, variables: Sequence[str] | None = None) -> None:
    """[K1, K2] Fields with unit and long name, one partition for each model, initialisation, lead and member; a later save replaces only those it has.

    ``leads`` and ``variables`` limit what is saved. Rows are clustered by partition first, so that each writes few files.
    """
    rows = fields
    if leads:
        rows = rows.where(F.col("lead_hours").between(*leads))
    if variables is not None:
        rows = rows.where(F.col("variable").isin(*variables))
    rows = rows.join(F.broadcast(var_dim), "variable", "left")  # a dictionary of some dozen variables
    parts = [c for c in ("model", "init_time", "lead_hours", "member") if c in rows.columns]
    rows.repartition(*parts).sortWithinPartitions("variable", "level_hpa", "lat_i").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts).parquet(path)


def save_by_init(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    """[K3, K4] Metric rows split by model and initialisation; only partitions that occur are replaced."""
    writer = metrics.repartition("model", "init_time").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("model", "init_time")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def save_bundle(points: DataFrame, tables: Mapping[str, Callable[[DataFrame], DataFrame]], path: str) -> None:
    """[K5] Several tables derived from one, read once: the points are written first and the others read them back."""
    points.write.mode("overwrite").parquet(f"{path}/raw")
    raw = points.sparkSession.read.parquet(f"{path}/raw")
    for name, make in tables.items():
        make(raw).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def save_baseline(baseline: DataFrame, path: str) -> None:
    """[K6] Long percentile rows (``p``) split into heat and cold."""
    tails(baseline).write.mode("overwrite").partitionBy("tail").parquet(path)


def save_cells(cells: DataFrame, path: str, tile: int = 16) -> None:
    """[K7] Masks, ids, counts or scores of cells, clustered by tiles of the grid."""
    tiled = cells.withColumn("tile", F.floor(F.col("lat_i") / tile) * 1000 + F.floor(F.col("lon_i") / tile))
    tiled.repartition("tile").sortWithinPartitions("tile", "lat_i", "lon_i").write.mode("overwrite").parquet(path)


def save_metadata(df: DataFrame, data_path: str, meta_path: str, parameters: Mapping[str, object]) -> None:
    """[K8] ``df`` as Parquet and a JSON row with the parameters, the rows written and the time. The count comes with the write, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(data_path)
    row = df.sparkSession.range(1).select(F.lit(json.dumps(parameters, sort_keys=True, default=str)).alias("parameters"), F.lit(seen.get["rows"]).alias("rows"), F.current_timestamp().alias("written"))
    row.coalesce(1).write.mode("overwrite").json(meta_path)


def save_sorted(table: DataFrame, path: str, order: Sequence[str], fmt: str = "csv") -> None:
    """[T3] A report whose files, taken by name, hold the rows in one total order: ranges of the order columns, each sorted."""
    writer = table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def config_key(config: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark, path: str, config: Mapping[str, object], wanted: DataFrame, keys: Sequence[str], make: Callable[[DataFrame], DataFrame], refresh: Sequence[str] = (), refresh_column: str = "model") -> DataFrame:
    """[K9] Results kept under a hash of the configuration: only wanted keys that are missing, or to be refreshed, are made.

    A run adds a new part and the last part that has a key counts, so that an interrupted run leaves what was there.
    """
    root = f"{path}/{config_key(config)}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    parts = spark.read.parquet(root) if there else None
    last = parts.agg(F.max("part")).first()[0] if there else -1
    todo = wanted
    if there:
        have = parts.where(~F.col(refresh_column).isin(*refresh)) if refresh else parts
        todo = wanted.join(have.select(*keys).distinct(), list(keys), "left_anti")
    if not todo.isEmpty():
        make(todo).withColumn("part", F.lit(last + 1)).write.mode("append").partitionBy("part").parquet(root)
    every = spark.read.parquet(root)
    newest = every.groupBy(*keys).agg(F.max("part").alias("part"))
    return every.join(newest, [*keys, "part"], "left_semi").join(wanted.select(*keys), list(keys), "left_semi").drop("part")
