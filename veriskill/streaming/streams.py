"""Incremental forms: observation slots, new-work upserts and linked paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from veriskill.operators.tracks import keep_last, step_paths


def slot_stream(obs: DataFrame, by: Sequence[str], time: str, values: Sequence[str], hours: int = 6, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """[R3, J8] Means of observations around synoptic times; a slot is final once the watermark has passed it (append mode)."""
    step = hours * 3600
    away = F.pmod(F.unix_micros(time) + minutes * 60_000_000, F.lit(step * 1_000_000))
    rows = obs.withWatermark(time, late).where(away <= 2 * minutes * 60_000_000)
    window = F.window(time, f"{hours} hours", startTime=f"{step - minutes * 60} seconds")
    out = rows.groupBy(window, *by).agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n_obs"))
    return out.select(*by, (F.col("window.start") + F.make_dt_interval(mins=F.lit(minutes))).alias("slot"), *values, "n_obs")


#: Bits of a key in the index of a part, and hashes that set them.
KEY_BITS, HASHES = 16, 4
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed_parts(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches that a target shows."""
    fs, at = _folder(spark, f"{target}/_commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def read_committed(spark: SparkSession, target: str, parts: Sequence[int] | None = None) -> DataFrame:
    """[R2] The rows of committed batches (``parts`` of them); a batch that is being written is not seen."""
    return spark.read.option("basePath", target).parquet(*(f"{target}/batch={n}" for n in (committed_parts(spark, target) if parts is None else parts)))


def _slots(rows: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """``_key`` (its hash), ``_slot``: the bits of each key; ``slots`` is a power of two."""
    hashed = rows.select(F.xxhash64(*keys).alias("_key"))
    return hashed.select("_key", F.explode(F.array_distinct(F.array(*(F.xxhash64("_key", F.lit(k)).bitwiseAND(F.lit(slots - 1)) for k in range(HASHES))))).alias("_slot"))


def parts_that_may_hold(rows: DataFrame, target: str, keys: Sequence[str]) -> list[int]:
    """[R2] Committed batches that may hold a key of ``rows``, by the range of each key column, then by the index bits.

    No key that a batch holds is missed; a batch without any is named for about one of 400 keys. Only commit files and,
    of batches whose ranges meet those of ``rows``, index words are read, not their rows.
    """
    spark = rows.sparkSession
    if not committed_parts(spark, target):
        return []
    bounds = StructType([rows.schema[k] for k in keys])
    commits = spark.read.options(**_TIMES).schema(StructType().add("batch", "long").add("slots", "long").add("low", bounds).add("high", bounds)).json(f"{target}/_commits/*")
    own = rows.agg(*(f(k).alias(f"{n}{j}") for j, k in enumerate(keys) for f, n in ((F.min, "_a"), (F.max, "_b"))), F.max(F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0))).alias("_null"))
    apart = F.lit(False)
    for j, k in enumerate(keys):
        apart = apart | (F.col("high")[k] < F.col(f"_a{j}")) | (F.col("low")[k] > F.col(f"_b{j}"))
    near = commits.crossJoin(F.broadcast(own)).where((F.col("_null") == 1) | ~F.coalesce(apart, F.lit(False)))  # own is one row
    sizes: dict[int, list[int]] = {}
    for batch, slots in near.select("batch", "slots").collect():
        sizes.setdefault(slots, []).append(batch)
    found: list[int] = []
    for slots, batches in sizes.items():
        words = spark.read.option("basePath", f"{target}/_index").parquet(*(f"{target}/_index/batch={n}" for n in batches))
        bits = _slots(rows, keys, slots).distinct()
        bits = bits.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("_key"))).withColumn("word", F.shiftright("_slot", 6))
        hits = bits.join(words, "word").where(F.getbit("bits", (F.col("_slot") % 64).cast("int")) == 1)
        whole = hits.groupBy("batch", "_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all")).where("_n = _all")
        found += [r[0] for r in whole.select("batch").distinct().collect()]
    return sorted(found)


def upsert(batch: DataFrame, number: int, target: str, keys: Sequence[str], within: str | None = None) -> int:
    """[R2, K3] Add the rows of a batch whose key the target lacks, the last of repeats; gives the number of parts that were read.

    A batch that is committed already adds nothing. Else its rows and its key index are written under its number, over
    what a failed attempt left, and one renamed file makes all of them visible at once. Null is a key like any other.
    """
    spark = batch.sparkSession
    if number in committed_parts(spark, target):
        return 0
    new = keep_last(batch.withColumn("_line", F.monotonically_increasing_id()), keys, ["_line"]).drop("_line")
    parts = parts_that_may_hold(new, target, keys)
    if parts:
        there = read_committed(spark, target, parts).select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)))
        same = F.lit(True)
        for j, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
        new = new.join(there, same, "left_anti")
    writer = new.write.mode("overwrite")
    (writer.partitionBy(within) if within else writer).parquet(f"{target}/batch={number}")
    rows = spark.read.schema(new.schema).option("basePath", f"{target}/batch={number}").parquet(f"{target}/batch={number}")
    ends = lambda f: F.struct(*(f(k).alias(k) for k in keys))
    n, low, high = rows.agg(F.count(F.lit(1)), *(F.to_json(ends(f), _TIMES) for f in (F.min, F.max))).first()
    slots = 1 << max(6, (n * KEY_BITS - 1).bit_length())
    words = _slots(rows, keys, slots).groupBy(F.shiftright("_slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_slot") % 64).cast("int"))).alias("bits"))
    words.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{target}/_index/batch={number}")
    fs, final = _folder(spark, f"{target}/_commits/{number}")
    draft = _folder(spark, f"{target}/_commits/.{number}")[1]
    out = fs.create(draft, True)
    out.write(f'{{"batch":{number},"slots":{slots},"low":{low},"high":{high}}}\n'.encode())
    out.close()
    fs.rename(draft, final)
    return len(parts)


def append_new(stream: DataFrame, target: str, keys: Sequence[str], checkpoint: str, within: str | None = None) -> DataStreamWriter:
    """[R2, K3] A writer that upserts each batch (:func:`upsert`); :func:`read_committed` reads the target.

    Only parts whose index may hold a key of the batch are read. ``within`` names a column, such as the initialisation,
    by which each batch's files are partitioned too.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, target, keys, within) and None).option("checkpointLocation", checkpoint)


class LinkPaths(StatefulProcessor):
    """Paths of a run that can still be reached, as a list; how many have begun, the last step and time, as a value."""

    def __init__(self, radius_km: float, memory: int, idle_ms: int | None):
        self.radius_km, self.memory, self.idle_ms = radius_km, memory, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getListState("paths", "id long, at long, lat double, lon double")
        self.run_so_far = handle.getValueState("run_so_far", "begun long, seen long, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        begun, seen, last = self.run_so_far.get() or (0, -(1 << 60), 0)
        paths = [tuple(p) for p in self.paths.get()]
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["step", "lat", "lon"])
        frame = frame[frame.step > seen].reset_index(drop=True)
        ids = np.full(len(frame), -1)
        for now, at in frame.groupby("step", sort=True).indices.items():
            ids[at], begun = step_paths(paths, begun, int(now), frame.lat.to_numpy()[at], frame.lon.to_numpy()[at], self.radius_km, self.memory)
            seen = int(now)
        if self.idle_ms is not None:
            if len(frame):
                last = max(last, int(frame["ms"].max()))
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)
        self.run_so_far.update((begun, seen, last))
        if paths:
            self.paths.put([(int(k), int(at), float(y), float(x)) for k, at, y, x in paths])
        else:
            self.paths.clear()
        yield frame.assign(path_id=ids, run=key[0])[["run", "step", "lat", "lon", "path_id"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.paths.clear()
        self.run_so_far.clear()
        return iter(())

    def close(self) -> None:
        pass


def path_stream(points: DataFrame, run: str, time: str | None = None, idle_hours: float = 48.0, late: str = "12 hours", radius_km: float = 300.0, memory: int = 2) -> DataFrame:
    """[R1, J17] ``run, step, lat, lon, path_id`` of arriving centres (``step, lat, lon``); a run's state is the list of paths that can still be reached.

    Steps must arrive in order: a batch may hold several, but none older than one already seen, which is dropped. With
    ``time``, a run ends once the watermark (``late`` behind the newest time) is ``idle_hours`` past its last point: a
    timer then removes its whole state. Points of the same run that come later still begin it anew, with paths from 0.
    Without ``time`` runs never end. Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
    """
    kind = points.schema[run].dataType.simpleString()
    if time:
        points = points.withWatermark(time, late)
    ms = [F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), F.col(time).alias("time")] if time else []
    rows = points.select(F.col(run).alias("run"), F.col("step").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), *ms)
    links = LinkPaths(radius_km, memory, round(idle_hours * 3_600_000) if time else None)
    return rows.groupBy("run").transformWithStateInPandas(links, f"`{run}` {kind}, step long, lat double, lon double, path_id long", "Append", "EventTime" if time else "None")
