"""Bookkeeping of runs: expected and present forecasts, priorities, fallbacks and time shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.operators.tracks import keep_last


def init_grid(spark: SparkSession, start: str, end: str, hours: Sequence[int]) -> DataFrame:
    """[P8] ``init_time`` for every day and hour in range."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    each = days.select("d", F.explode(F.array(*map(F.lit, hours))).alias("h"))
    return each.select((F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("init_time"))


def missing(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[J19, J20] Expected rows that are not present (or not finished)."""
    return expected.join(present, list(keys), "left_anti")


def unfinished(units: DataFrame, ends: DataFrame, keys: Sequence[str], done: Sequence[str] = ("max_lead_reached", "storm_end")) -> DataFrame:
    """[J20] Units to run: those without an end for one of the reasons that count as done."""
    return missing(units, ends.where(F.col("terminate_reason").isin(*done)), keys)


def coverage(expected: DataFrame, present: DataFrame, model: str, keys: Sequence[str]) -> DataFrame:
    """[A45] Expected, present and missing units for each model and in all (``model`` null)."""
    marked = expected.join(present.select(*keys).distinct().withColumn("_p", F.lit(1)), list(keys), "left")
    out = marked.rollup(model).agg(F.count(F.lit(1)).alias("expected"), F.count("_p").alias("present"))
    return out.withColumn("missing", F.col("expected") - F.col("present"))


def first_root(roots: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """[S14] Union of roots in which the first that has a key wins."""
    every = None
    for rank, df in enumerate(roots):
        df = df.withColumn("_rank", F.lit(-rank))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    return keep_last(every, keys, ["_rank"]).drop("_rank")


def fallback(preferred: DataFrame, other: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """[S6] The preferred value, else the other one, with its ``source``."""
    a, b = preferred.select(*keys, F.col(value).alias("_a")), other.select(*keys, F.col(value).alias("_b"))
    out = a.join(b, list(keys), "full")
    return out.select(*keys, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "preferred").otherwise("fallback").alias("source"))


def preferred_name(rows: DataFrame, keys: Sequence[str], name: str, candidates: Sequence[str]) -> DataFrame:
    """[S7] Of several alternative variable names the first that exists for each key."""
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col(name))
    return keep_last(rows.where(rank > 0).withColumn("_k", -rank), keys, ["_k"]).drop("_k")


def complete_snapshots(catalog: DataFrame, time: str, variable: str, needed: Sequence[str], back_hours: int = 0) -> DataFrame:
    """[S5] Times at which every needed variable exists, and also ``back_hours`` earlier if asked."""
    full = catalog.where(F.col(variable).isin(*needed)).groupBy(time).agg(F.count_distinct(variable).alias("_n")).where(F.col("_n") == len(set(needed))).select(time)
    if not back_hours:
        return full
    earlier = full.select((F.col(time) + F.make_dt_interval(hours=F.lit(back_hours))).alias(time))
    return full.join(earlier, time, "left_semi")


def zero_filled(fields: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str = "value", strict: bool = False) -> DataFrame:
    """[S8] ``wanted`` keys with their value, 0 where there is none; ``strict`` fails on reading instead."""
    out = wanted.join(fields.select(*keys, value), list(keys), "left")
    return out.withColumn(value, F.when(F.col(value).isNull(), F.raise_error("an input field is missing").cast("double")).otherwise(F.col(value)) if strict else F.coalesce(value, F.lit(0.0)))


def shifted(fields: DataFrame, keys: Sequence[str], time: str, hours: int, columns: Sequence[str]) -> DataFrame:
    """[J24, W13] ``fields`` with columns ``<name>_shifted`` taken ``hours`` earlier; null where that time is missing."""
    earlier = fields.select(*keys, (F.col(time) + F.make_dt_interval(hours=F.lit(hours))).alias(time), *(F.col(c).alias(f"{c}_shifted") for c in columns))
    return fields.join(earlier, [*keys, time], "left")


def training_pairs(states: DataFrame, keys: Sequence[str], time: str, interval_hours: int, steps: int, value: str) -> DataFrame:
    """[S25] State now and after ``steps`` intervals; a pair needs both, so that the tail falls out."""
    later = states.select(*keys, (F.col(time) - F.make_dt_interval(hours=F.lit(interval_hours * steps))).alias(time), F.col(value).alias("target"))
    return states.join(later, [*keys, time]).select(*keys, time, F.col(value).alias("input"), "target")


def step_differences(rollout: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """[W14] Difference to the step before; the first step keeps null."""
    return rollout.withColumn("difference", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(step)))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """[J23] ``left`` with the value of the nearest time on the right, the earlier one on ties. A union and one sort per key, no pairs."""
    both = left.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast("timestamp_ntz").alias("_t"), F.lit(None).cast("double").alias("_v")).unionByName(
        right.select(*keys, time, F.lit(1).alias("_side"), F.col(time).alias("_t"), F.col(value).cast("double").alias("_v")))
    near = F.when(F.col("_side") == 1, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(*keys).orderBy(time)
    found = both.select("*", F.last(near, True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("_a"), F.first(near, True).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("_b")).where("_side = 0")
    gap = lambda x: F.abs(F.unix_micros(F.col(f"{x}.t").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")))
    return found.select(*keys, time, F.when(F.col("_b").isNull() | (gap("_a") <= gap("_b")), F.col("_a.v")).otherwise(F.col("_b.v")).alias(value))


def wanted_or_all(wanted: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """[U7] The wanted keys that are available, or all available ones if none is."""
    both = available.select(key).distinct().join(wanted.select(F.col(key), F.lit(1).alias("_w")).distinct(), key, "left")
    some = both.agg(F.count("_w").alias("_n"))  # one row
    return both.crossJoin(F.broadcast(some)).where((F.col("_n") == 0) | F.col("_w").isNotNull()).select(key)


def common_or_union(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """[U6] Keys that both tables have, or those of either if they share none."""
    both = one.select(key).distinct().withColumn("_a", F.lit(1)).join(two.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    shared = both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("_n"))  # one row
    return both.crossJoin(F.broadcast(shared)).where((F.col("_n") == 0) | (F.col("_a").isNotNull() & F.col("_b").isNotNull())).select(key)


def replaced(old: DataFrame, new: DataFrame, variable: str) -> DataFrame:
    """[U4] ``old`` with all rows of the new table's variables taken from it."""
    return old.join(new.select(variable).distinct(), variable, "left_anti").unionByName(new)


def lead_filter(rows: DataFrame, lead: str, most: int, step: int = 6) -> DataFrame:
    """[P6] Leads from the first step to ``most``, on whole steps."""
    return rows.where(F.col(lead).between(step, most) & (F.col(lead) % step == 0))


def init_bounds(rows: DataFrame, init: str, start: str, end: str) -> DataFrame:
    """[P9] Initialisations from 00 h of one day to 18 h of another (``yyyyMMdd``)."""
    bound = lambda day, hour: F.to_timestamp(F.lit(f"{day}{hour:02d}"), "yyyyMMddHH").cast("timestamp_ntz")
    return rows.where(F.col(init).cast("timestamp_ntz").between(bound(start, 0), bound(end, 18)))


def repeated_over(static: DataFrame, times: DataFrame) -> DataFrame:
    """[S9] Static fields at each of a few times."""
    return static.crossJoin(F.broadcast(times))  # the input times of a run


def status_rows(units: DataFrame, results: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """[X5] Every unit with ``status`` and ``reason``: ``missing`` without a result, ``failed`` by the first check that holds, else ``ok``."""
    joined = units.join(results.withColumn("_there", F.lit(True)), list(keys), "left")
    reason = F.when(F.col("_there").isNull(), "no result")
    for name, failed in checks:
        reason = reason.when(failed, name)
    status = F.when(F.col("_there").isNull(), "missing").when(reason.isNotNull(), "failed").otherwise("ok")
    return joined.select(*keys, status.alias("status"), reason.alias("reason"))


def channel_subset(channels: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """[P2] Wanted channels in wanted order (``ord``), the first of duplicates; reading fails on an unknown name."""
    have = keep_last(channels.withColumn("_key", key).withColumn("_o", -F.col("ord")), ["_key"], ["_o"]).select("_key", F.col("name").alias("channel"))
    out = wanted.withColumn("_key", key).join(have, "_key", "left")
    return out.where(F.assert_true(F.col("channel").isNotNull(), "unknown channel").isNull()).groupBy("channel").agg(F.min("ord").alias("ord")).select("ord", "channel")
