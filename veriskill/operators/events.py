"""Heat- and coldwave events: daily extremes, day-of-year baselines, spans, matching and skill."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from veriskill.functions import scalars as S
from veriskill.operators.chunks import in_groups
from veriskill.sources.scratch import written


def daily_extremes(series: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """[A26] Largest and smallest value of each calendar day, nulls skipped."""
    return series.groupBy(*by, F.col(time).cast("date").alias("day")).agg(F.max(value).alias("tmax"), F.min(value).alias("tmin"))


def lead_day_extremes(series: DataFrame, by: Sequence[str], init: str, valid: str, value: str, lead_days: Sequence[int] = (1, 3, 7, 10)) -> DataFrame:
    """[A27, P10] Daily extremes for each lead day, over all initialisation hours of the day."""
    day = S.lead_day(F.col(valid), F.col(init))
    rows = series.withColumn("lead_day", day).where(F.col("lead_day").isin(*lead_days))
    return rows.groupBy(*by, "lead_day", F.col(valid).cast("date").alias("day")).agg(F.max(value).alias("tmax"), F.min(value).alias("tmin"))


class SlidingRanks:
    """Values of several cells in rising order, of which each cell holds some; any place among those held can be asked.

    Marks of held values stand in blocks with counts, so that values come and go by their rank and a place is found by
    the sums of the counts, then within one block. All cells move at once.
    """

    BLOCK = 64

    def __init__(self, ordered: np.ndarray):
        """``ordered``: a row of rising values for each cell, filled up with anything."""
        cells, n = ordered.shape
        self.values = ordered
        self.held = np.zeros((cells, -(-n // self.BLOCK), self.BLOCK), np.int8)
        self.counts = np.zeros(self.held.shape[:2], np.int64)
        self.total = np.zeros(cells, np.int64)

    def change(self, cells: np.ndarray, ranks: np.ndarray, by: int) -> None:
        """Add (1) or drop (-1) values, each at most once."""
        block = ranks // self.BLOCK
        self.held[cells, block, ranks % self.BLOCK] += np.int8(by)
        np.add.at(self.counts, (cells, block), by)
        np.add.at(self.total, cells, by)

    def at(self, cells: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The held value at ``place`` (from 0) of each of the cells."""
        upto = np.cumsum(self.counts[cells], axis=1)
        block = (upto <= place[:, None]).sum(1)
        rows = np.arange(len(cells))
        within = place - (upto[rows, block] - self.counts[cells, block])
        rank = (np.cumsum(self.held[cells, block], axis=1) <= within[:, None]).sum(1)
        return self.values[cells, block * self.BLOCK + rank]


def _doy_quantiles(cell: np.ndarray, doy: np.ndarray, value: np.ndarray, asked: Sequence[float], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, day of year and quantiles (a column each) of all windows that hold a value. Cells are 0, 1, ..."""
    order = np.lexsort([value, cell])
    cell, doy, value = cell[order], doy[order], value[order]
    rank = np.arange(len(cell)) - np.searchsorted(cell, cell)
    cells = int(cell.max(initial=-1)) + 1
    ordered = np.zeros((cells, -(-(int(rank.max(initial=0)) + 1) // SlidingRanks.BLOCK) * SlidingRanks.BLOCK))
    ordered[cell, rank] = value
    ranks = SlidingRanks(ordered)
    days = np.argsort(doy, kind="stable")
    ends = np.searchsorted(doy[days], np.arange(1, 368))
    rows_of = lambda d: days[ends[(d - 1) % 366] : ends[(d - 1) % 366 + 1]]
    near = min(half, 183)  # a window of a year and more holds every day once
    held = {(1 + o - 1) % 366 for o in range(-near, near + 1)}
    for d in held:
        ranks.change(cell[rows_of(d + 1)], rank[rows_of(d + 1)], 1)
    out = []
    for d in range(1, 367):
        some = np.flatnonzero(ranks.total)
        place = np.outer(np.asarray(asked), ranks.total[some] - 1)
        low = np.floor(place)
        found = []
        for p, lo in zip(place, low, strict=True):
            a, b = ranks.at(some, lo.astype(np.int64)), ranks.at(some, np.ceil(p).astype(np.int64))
            found.append(np.where(a == b, a, (np.ceil(p) - p) * a + (p - lo) * b))
        out.append((some, np.full(len(some), d), np.stack(found, axis=1)))
        if len(held) < 366:
            for old, by in ((d - near, -1), (d + near + 1, 1)):
                ranks.change(cell[rows_of(old)], rank[rows_of(old)], by)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def doy_percentile(daily: DataFrame, by: Sequence[str], value: str, percentages: Sequence[float], day: str = "day", window: int = 15) -> DataFrame:
    """[A28, W16] Linear-interpolated percentiles of all days within half a window of each day of year, wrapped at 366.

    One shuffle brings each value once to its cell. There all values are ranked, and as the window moves on, a day's
    values enter and the oldest day's leave the held ranks. Missing values (null and NaN) don't count; a day of year
    whose window is empty has no row.
    """
    if any(not 0 < p < 100 for p in percentages):
        raise ValueError("percentages must lie between 0 and 100")
    asked = list(dict.fromkeys(percentages))
    half, n_keys = window // 2, len(by)
    rows = daily.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.dayofyear(day).cast("int").alias("_doy"), F.col(value).cast("double").alias("_v")).where(F.col("_doy").isNotNull())
    schema = StructType([rows.schema[k] for k in by]).add("doy", "integer")
    for p in asked:
        schema = schema.add(f"p{p:g}".replace(".", "_"), "double")

    def slide(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        cell = np.repeat(np.arange(len(starts)), np.diff([*starts, batch.num_rows]))
        doy, v = (batch.column(n_keys + k).to_numpy(zero_copy_only=False) for k in range(2))
        parts, sizes = [], np.ceil(np.log2(np.bincount(cell))).astype(int)
        for size in np.unique(sizes):  # cells of like size, as they lie in one array
            own = np.flatnonzero(sizes == size)
            number = np.full(len(starts), -1)
            number[own] = np.arange(len(own))
            rows = number[cell] >= 0
            at, days, found = _doy_quantiles(number[cell[rows]], doy[rows], v[rows], [p / 100 for p in asked], half)
            parts.append((own[at], days, found))
        at, days, found = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys = batch.take(pa.array(starts[at])).columns[:n_keys]
        return pa.RecordBatch.from_arrays([*keys, pa.array(days, pa.int32()), *map(pa.array, found.T)], schema.names)

    return in_groups(rows, by, slide, schema, least=200_000)


def tails(baseline: DataFrame, p: str = "p") -> DataFrame:
    """[K6] Percentile rows with their tail: heat from 50 on, cold below."""
    return baseline.withColumn("tail", F.when(F.col(p) >= 50, "heat").otherwise("cold"))


def exceed_mask(daily: DataFrame, baseline: DataFrame, value: str, threshold: str, by: Sequence[str], day: str = "day", cold: bool = False) -> DataFrame:
    """[J13, P27] ``daily`` with ``mask``; a day of year without a threshold, or a missing value, gives null."""
    keyed = daily.withColumn("doy", F.dayofyear(day))
    joined = keyed.join(baseline.select(*by, "doy", threshold), [*by, "doy"], "left")
    return joined.withColumn("mask", (F.col(value) < F.col(threshold)) if cold else (F.col(value) > F.col(threshold)))


def event_spans(masked: DataFrame, by: Sequence[str], day: str = "day", mask: str = "mask", min_days: int = 3) -> DataFrame:
    """[W1] Maximal runs of consecutive true days, inclusive; null and missing days break a run."""
    w = Window.partitionBy(*by).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    runs = masked.where(F.col(mask)).withColumn("_island", island)
    spans = runs.groupBy(*by, "_island").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count(F.lit(1)).cast("long").alias("days"))
    return spans.where(F.col("days") >= min_days).drop("_island")


def event_ids(masked: DataFrame, by: Sequence[str], day: str = "day", mask: str = "mask", min_days: int = 3) -> DataFrame:
    """[W2] Days with the number of their event within the cell, 0 outside events. Two windows, no join."""
    w = Window.partitionBy(*by).orderBy(day)
    on = F.coalesce(F.col(mask), F.lit(False))
    rows = masked.withColumn("_on", on).withColumn("_island", F.when(F.col("_on"), F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*by, on).orderBy(day)))))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "_on", "_island"))
    rows = rows.withColumn("_event", F.col("_on") & (size >= min_days))
    first = rows.withColumn("_first", F.when(F.col("_event") & (F.coalesce(F.lag(F.when(F.col("_event"), F.col("_island"))).over(w) != F.col("_island"), F.lit(True))), 1).otherwise(0))
    return first.withColumn("event_id", F.when(F.col("_event"), F.sum("_first").over(w)).otherwise(0)).drop("_on", "_island", "_event", "_first")


def row_events(masked: DataFrame, by: Sequence[str], day: str = "day", mask: str = "mask", min_rows: int = 3) -> DataFrame:
    """[W3] Runs of consecutive rows instead of days, numbered by start; duration is counted in days."""
    w = Window.partitionBy(*by).orderBy(day)
    on = F.coalesce(F.col(mask), F.lit(False))
    rows = masked.select(*by, day, on.alias("_on"), F.row_number().over(w).alias("_r"))
    runs = rows.where("_on").withColumn("_island", F.col("_r") - F.row_number().over(w))
    spans = runs.groupBy(*by, "_island").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count(F.lit(1)).cast("long").alias("rows"))
    spans = spans.where(F.col("rows") >= min_rows).withColumn("duration", F.datediff("end_day", "start_day") + 1)
    return spans.withColumn("event_id", F.row_number().over(Window.partitionBy(*by).orderBy("start_day"))).drop("_island")


def match_events(pred: DataFrame, truth: DataFrame, by: Sequence[str], min_iou: float = 0.5) -> DataFrame:
    """[J14, J15] One-to-one matches of predicted and true spans of the same cell by temporal overlap.

    Spans meet in month buckets, an equi-join. Down to an overlap of one half each span has one partner at most, and
    the join is the result; below, candidates of a cell are taken greedily by overlap, then start days.
    """
    def bucketed(spans: DataFrame, side: str) -> DataFrame:
        months = F.sequence(F.trunc("start_day", "month"), F.trunc("end_day", "month"), F.expr("interval 1 month"))
        return spans.select(*by, F.col("start_day").alias(f"{side}_start"), F.col("end_day").alias(f"{side}_end"), F.explode(months).alias("_month"))

    both = bucketed(pred, "pred").join(bucketed(truth, "truth"), [*by, "_month"])
    # A pair that meets in several months counts in the month where its overlap starts.
    both = both.where(F.trunc(F.greatest("pred_start", "truth_start"), "month") == F.col("_month")).drop("_month")
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    spans = [day(c) for c in ("pred_start", "pred_end", "truth_start", "truth_end")]
    found = both.withColumn("iou", S.temporal_iou(*spans)).where((S.overlap_days(*spans) > 0) & (F.col("iou") >= min_iou))
    return found if min_iou >= 0.5 else greedy(found, by, ["pred_start"], ["truth_start"], [("iou", False), ("truth_start", True), ("pred_start", True)])


def greedy(pairs: DataFrame, by: Sequence[str], left: Sequence[str], right: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """[J15, J16] Each group's pairs in order, both sides used once, in rounds of locally dominant pairs.

    A pair that comes first among those of its left side and among those of its right side is final, as nothing before
    it can take either; pairs that share a side with it go. Rounds follow until no pair is left, so that groups of any
    size are shared out by their sides. Equal pairs are taken by their sides' values, one of repeated pairs stays. Each
    round writes a table of what is left, about a half or less of the one before; only a chain of pairs that share sides
    in falling order takes a round for each.
    """
    sides = [F.col(c).asc() for c in dict.fromkeys([*left, *right]) if c not in dict(order)]
    ranked = [*(F.col(c).asc() if up else F.col(c).desc() for c, up in order), *sides]
    of_left, of_right = Window.partitionBy(*by, *left), Window.partitionBy(*by, *right)
    rest, done, names = pairs, None, pairs.columns
    while True:
        first = rest.withColumn("_l", F.row_number().over(of_left.orderBy(*ranked))).withColumn("_final", (F.row_number().over(of_right.orderBy(*ranked)) == 1) & (F.col("_l") == 1))
        gone = first.withColumn("_taken", F.max("_final").over(of_right)).withColumn("_taken", F.col("_taken") | F.max("_final").over(of_left))
        now = written(gone.where(F.col("_final") | ~F.col("_taken")).select(*names, "_final"))
        final = now.where("_final").select(*names)
        done = final if done is None else done.unionByName(final)
        if now.where("NOT _final").isEmpty():
            return done
        rest = now.where("NOT _final").select(*names)


def event_counts(pred: DataFrame, truth: DataFrame, matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """[A34] ``tp, fp, fn, pred_total, truth_total`` for each cell that has any event."""
    def n(spans: DataFrame, p: int, t: int, m: int) -> DataFrame:
        return spans.select(*by, F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(m).alias("m"))

    every = n(pred, 1, 0, 0).unionByName(n(truth, 0, 1, 0)).unionByName(n(matches, 0, 0, 1))
    out = every.groupBy(*by).agg(F.sum("p").alias("pred_total"), F.sum("t").alias("truth_total"), F.sum("m").alias("tp"))
    return out.select(*by, "tp", (F.col("pred_total") - F.col("tp")).alias("fp"), (F.col("truth_total") - F.col("tp")).alias("fn"), "pred_total", "truth_total")


def conserved(counts: DataFrame) -> DataFrame:
    """[A34] ``counts``; reading fails if hits and errors do not add up to the totals."""
    ok = (F.col("tp") + F.col("fn") == F.col("truth_total")) & (F.col("tp") + F.col("fp") == F.col("pred_total"))
    return counts.where(F.assert_true(ok, "event counts do not add up").isNull())


def event_skill(counts: DataFrame) -> DataFrame:
    """[A33] Scores of each cell; without events all are null, with events on one side only the ladder's values hold."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    t, p = F.col("truth_total"), F.col("pred_total")
    none, both = (t == 0) & (p == 0), (t > 0) & (p > 0)

    def ladder(no_truth: float | None, no_pred: float | None, full: Column) -> Column:
        lit = lambda x: F.lit(x).cast("double")
        return F.when(none, lit(None)).when(t == 0, lit(no_truth)).when(p == 0, lit(no_pred)).when(both, full)

    return counts.select(
        "*", ladder(0.0, None, tp / F.nullif(tp + fp, F.lit(0.0))).alias("precision"), ladder(None, 0.0, tp / F.nullif(tp + fn, F.lit(0.0))).alias("recall"), ladder(None, 0.0, tp / F.nullif(tp + fn, F.lit(0.0))).alias("pod"),
        ladder(1.0, None, fp / F.nullif(tp + fp, F.lit(0.0))).alias("far"), ladder(None, None, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0))).alias("f1"), ladder(0.0, 0.0, tp / F.nullif(tp + fp + fn, F.lit(0.0))).alias("csi"),
    )


def skill_summary(cells: DataFrame, lat: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """[A35, A29] Cosine-weighted means of the cells' scores over each latitude band and the globe, nulls skipped."""
    w = F.cos(F.radians(lat))
    rows = cells.withColumn("band", S.band(F.col(lat)))
    means = [(F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w)))).alias(c) for c in names]
    keys = list(map(F.col, by))
    out = rows.groupingSets([[*keys, F.col("band")], keys], *by, "band").agg(F.grouping("band").alias("_g"), *means)
    return out.withColumn("band", F.when(F.col("_g") == 1, "global").otherwise(F.col("band"))).drop("_g")


def gap_free(daily: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """``daily`` with a row for every day between the table's first and last, values null where there was none."""
    ends = daily.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b")).alias(day))
    return daily.select(*by).distinct().crossJoin(F.broadcast(calendar)).join(daily, [*by, day], "left")  # a calendar of days


MASKS: dict[str, Callable[[str, str], Column]] = {
    "heat": lambda x, b: S.exceeds(F.col(x), F.col(b)) & S.exceeds(F.col(x), F.lit(35.0)),
    "cold": lambda x, b: S.exceeds(F.col(x), F.col(b), cold=True) & S.exceeds(F.col(x), F.lit(-5.0), cold=True),
}


def threshold_mask(daily: DataFrame, value: str, threshold: str, lat: str, kind: str = "heat", max_lat: float = 60.0) -> DataFrame:
    """[P28] Beyond the baseline and the absolute limit, within a latitude band."""
    return daily.withColumn("mask", MASKS[kind](value, threshold) & (F.abs(lat) < max_lat))
