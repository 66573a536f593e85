"""Grid verification: weights, field joins, scores, neighbourhoods and regridding."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from veriskill.functions import metrics as M
from veriskill.operators.chunks import in_groups

PI = 3.141592653589793


def lat_weights(lats: DataFrame, lat: str = "lat", variant: str = "exact", keys: Sequence[str] = ()) -> DataFrame:
    """[A1] ``lats`` (one row per latitude) with ``w``: cos over its mean (``exact``), the same with 3.1416 (``approx_pi``), or plain cos (``cos``)."""
    pi = 3.1416 if variant == "approx_pi" else PI
    c = F.greatest(F.cos(F.col(lat) * (pi / 180)), F.lit(0.0))
    if variant == "cos":
        return lats.withColumn("w", c)
    mean = lats.groupBy(*keys).agg(F.avg(c).alias("_mean"))
    joined = lats.join(F.broadcast(mean), list(keys)) if keys else lats.crossJoin(F.broadcast(mean))  # one row
    return joined.withColumn("w", c / F.col("_mean")).drop("_mean")


def join_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[J1] Forecast and truth on position and valid time; fields without truth fall out."""
    return pred.join(truth, list(keys))


def join_climatology(fields: DataFrame, clim: DataFrame, valid: str = "valid_time", keys: Sequence[str] = ()) -> DataFrame:
    """[J2, S22] Climatology of the calendar day; a missing day leaves null."""
    return fields.withColumn("mmdd", F.date_format(valid, "MM-dd")).join(clim, ["mmdd", *keys], "left")


def scores(cells: DataFrame, by: Sequence[str], names: Sequence[str] = ("wrmse", "bias", "mae", "activity", "acc")) -> DataFrame:
    """[A11] Any registered metrics in one aggregation; needs ``pred, truth, clim, w``."""
    return cells.groupBy(*by).agg(*(M.metric(n) for n in names))


def centred_acc(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """[A9] Anomaly correlation about the unweighted mean anomaly, from partial sums of one pass."""
    f, o, w = F.col("pred") - F.col("clim"), F.col("truth") - F.col("clim"), F.col("w")
    cells = cells.where(f.isNotNull() & o.isNotNull())
    s = cells.groupBy(*by).agg(F.avg(f).alias("mf"), F.avg(o).alias("mo"), F.sum(w).alias("w"), F.sum(w * f).alias("wf"), F.sum(w * o).alias("wo"), F.sum(w * f * o).alias("fo"), F.sum(w * f * f).alias("ff"), F.sum(w * o * o).alias("oo"))
    cov = F.col("fo") - F.col("mf") * F.col("wo") - F.col("mo") * F.col("wf") + F.col("mf") * F.col("mo") * F.col("w")
    vf = F.col("ff") - 2 * F.col("mf") * F.col("wf") + F.col("mf") * F.col("mf") * F.col("w")
    vo = F.col("oo") - 2 * F.col("mo") * F.col("wo") + F.col("mo") * F.col("mo") * F.col("w")
    return s.select(*by, F.try_divide(cov, F.sqrt(vf * vo)).alias("acc_centred"))


def threshold_scores(cells: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """[A14, A15, A16] Contingency counts, CSI and SEDI for each threshold, in one pass over the cells."""
    p, t, thr = F.col("pred"), F.col("truth"), F.col("threshold")
    each = cells.where(p.isNotNull() & t.isNotNull()).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    n = each.groupBy(*by, "threshold").agg(M.hits(p, t, thr).alias("hits"), M.misses(p, t, thr).alias("misses"), M.false_alarms(p, t, thr).alias("false_alarms"), M.correct_negatives(p, t, thr).alias("correct_negatives"))
    h, m, f, c = (F.col(k) for k in ("hits", "misses", "false_alarms", "correct_negatives"))
    return n.select("*", M.csi(h, m, f).alias("csi"), M.sedi(h, m, f, c).alias("sedi"))


def exceedance_share(cells: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """[A17] Share of cells whose signed error exceeds each threshold."""
    each = cells.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return each.groupBy(*by, "threshold").agg(F.avg(F.when(F.col("pred") - F.col("truth") > F.col("threshold"), 1.0).otherwise(0.0)).alias("poep"))


def error_groupings(cells: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """[A13] Mean squared error for several groupings at once; ``grouping`` tells them apart."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    e = F.col("pred") - F.col("truth")
    return cells.groupingSets([list(map(F.col, s)) for s in sets], *columns).agg(F.grouping_id().alias("grouping"), F.avg(e * e).alias("mse"))


def energy(fields: DataFrame, by: Sequence[str], cp: float = 1004.0, t0: float = 270.0) -> DataFrame:
    """[A18] Mean of (w u)^2/2 + (w v)^2/2 + cp/(2 t0) (w t)^2 over cells with columns ``u, v, t, w``."""
    w2 = F.col("w") * F.col("w")
    kinetic = 0.5 * (F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return fields.groupBy(*by).agg(F.avg(w2 * (kinetic + cp / (2 * t0) * F.col("t") * F.col("t"))).alias("energy"))


def ensemble_scores(members: DataFrame, by: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """[A19, A20, J26] Fair CRPS, spread and spread/skill of ``members`` (``pred, truth, w``, a row per member and cell).

    The pair sum of absolute differences comes from the sorted members, so that no pairs are made.
    """
    x = F.array_sort(F.collect_list("pred"))
    per = members.groupBy(*by, *cell).agg(x.alias("x"), F.first("truth").alias("truth"), F.first("w").alias("w"), F.avg("pred").alias("mean"), F.var_samp("pred").alias("var"), F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("err"))
    n = F.size("x")
    place = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), n), lambda v, i: v * (2 * i - n - 1)), F.lit(0.0), lambda a, b: a + b)
    pair = F.coalesce(F.try_divide(2 * place, 2 * n * (n - 1)), F.lit(0.0))
    e2 = (F.col("mean") - F.col("truth")) * (F.col("mean") - F.col("truth"))
    out = per.groupBy(*by).agg(F.avg(F.col("w") * (F.col("err") - pair)).alias("crps"), F.sqrt(F.avg(F.col("w") * F.col("var"))).alias("spread"), F.sqrt(F.avg(F.col("w") * e2)).alias("skill"))
    return out.withColumn("spread_skill", F.try_divide("spread", "skill")).drop("skill")


def weighted_mse(cells: DataFrame, variable: str, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """[A21] Mean w e^2 for each variable, and their mean under variable weights normalised to 1 (``variable`` null)."""
    e = F.col("pred") - F.col("truth")
    each = cells.groupBy(*by, variable).agg(F.avg(F.col("w") * e * e).alias("mse")).join(F.broadcast(weights), variable)
    total = each.groupBy(*by).agg((F.sum(F.col("mse") * F.col("weight")) / F.sum("weight")).alias("mse"))
    return each.select(*by, variable, "mse").unionByName(total.select(*by, F.lit(None).cast("string").alias(variable), "mse"))


def mean_sample_rmse(cells: DataFrame, by: Sequence[str], sample: Sequence[str]) -> DataFrame:
    """[A22] Mean over samples of sqrt(mean(w e^2))."""
    e = F.col("pred") - F.col("truth")
    return cells.groupBy(*by, *sample).agg(F.sqrt(F.avg(F.col("w") * e * e)).alias("r")).groupBy(*by).agg(F.avg("r").alias("rmse"))


def interval_mean(forecasts: DataFrame, cell: Sequence[str], lead: str = "lead_h", interval: str = "interval_h") -> DataFrame:
    """[A23] Mean of the forecasts whose base interval divides the lead."""
    return forecasts.where(F.col(lead) % F.col(interval) == 0).groupBy(*cell, lead).agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n"))


def vorticity(cells: DataFrame, field: Sequence[str], spacing: float = 25_000.0, rows: int = 721) -> DataFrame:
    """[W4] dv/dx - du/dy by central differences (one-sided at edges) on N-to-S rows, sign turned south of the equator."""

    def slope(x: str, along: str, across: str) -> Column:
        w = Window.partitionBy(*field, across).orderBy(along)
        before, after = F.coalesce(F.lag(x).over(w), F.col(x)), F.coalesce(F.lead(x).over(w), F.col(x))
        steps = F.when(F.lag(x).over(w).isNotNull(), 1).otherwise(0) + F.when(F.lead(x).over(w).isNotNull(), 1).otherwise(0)
        return F.try_divide(after - before, steps * spacing)

    south = F.when(F.col("lat_i") >= (rows + 1) // 2, -1.0).otherwise(1.0)
    return cells.select("*", slope("v", "lon_i", "lat_i").alias("_dvdx"), slope("u", "lat_i", "lon_i").alias("_dudi")).withColumn("vorticity", south * (F.col("_dvdx") + F.col("_dudi"))).drop("_dvdx", "_dudi")


def nrmse(cells: DataFrame, by: Sequence[str], rows: int, width: int, border: int = 30, pred: str = "pred", truth: str = "truth", std: str | None = None) -> DataFrame:
    """[A12] Unweighted RMSE without a border of cells, times the channel's standard deviation if there is one."""
    if rows <= 2 * border or width <= 2 * border:
        raise ValueError("the border leaves no cell")
    inner = cells.where(F.col("lat_i").between(border, rows - 1 - border) & F.col("lon_i").between(border, width - 1 - border))
    e = F.sqrt(F.avg(F.pow(F.col(pred) - F.col(truth), 2)))
    return inner.groupBy(*by).agg((e * F.first(std) if std else e).alias("nrmse"))


def nearest_index(x: Column, n: int, start: float, step: float, periodic: bool = False) -> Column:
    """[J25] Index of the grid coordinate next to ``x``, the first of two; periodic axes wrap."""
    at = F.ceil((x - start) / step - 0.5).cast("int")
    return F.pmod(at, F.lit(n)) if periodic else F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))


#: Columns of the stripes that are filled together.
STRIPE = 64


def _fill_stripe(i: np.ndarray, j: np.ndarray, lat: np.ndarray, gap: np.ndarray, off: np.ndarray, v: np.ndarray, step: float) -> np.ndarray:
    """Values of the gaps of one stripe: rings of rows, nearest first, until no further row can be nearer."""
    rows, r = np.unique(i, return_inverse=True)
    cols, c = np.unique(j, return_inverse=True)
    lats, dense = np.zeros(len(rows)), np.full((2, len(rows), len(cols)), np.nan)
    lats[r], dense[:, r, c] = np.radians(lat), (np.radians(off * step), v)
    r, c = r[gap], c[gap]
    best, row, value = np.full(len(r), np.inf), np.zeros(len(r), np.int64), np.full(len(r), np.nan)
    active = np.arange(len(r))
    for k in range(len(rows)):
        bound = np.full(len(active), np.inf)
        for side in (r[active] - k, r[active] + k):
            inside = (side >= 0) & (side < len(rows))
            mine, other = active[inside], side[inside]
            here = lats[r[mine]]
            lift = np.sin((here - lats[other]) / 2) ** 2
            bound[inside] = np.minimum(bound[inside], lift)
            d, x = dense[:, other, c[mine]]
            h = np.round(lift + np.cos(here) * np.cos(lats[other]) * np.sin(d / 2) ** 2, 12)
            first = (h < best[mine]) | ((h == best[mine]) & (other < row[mine]))
            mine = mine[first]
            best[mine], row[mine], value[mine] = h[first], other[first], x[first]
        active = active[bound <= best[active] + 1e-11]  # rows further off are at least as far as these
        if not len(active):
            break
    out = v.copy()
    out[gap] = value
    return out


def filled_with_nearest(cells: DataFrame, field: Sequence[str], value: str = "value", lat: str = "lat", width: int | None = 1440, step: float | None = None) -> DataFrame:
    """[J25] Missing cells take the value of the valid cell that is nearest on the sphere.

    ``width`` columns go round the globe; None stands for a region whose columns are ``step`` degrees apart. ``lat`` must
    rise or fall with ``lat_i``. Of equally near cells (squared half chords, rounded to 12 digits) the one of the smaller
    row counts, in it the one fewer columns away, then the smaller column. Whole-row windows find each cell's nearest valid column in its own row, round
    the globe; as along a row distance grows with the columns between, these alone can be nearest. One shuffle to stripes
    of columns then compares the rows of a stripe in Arrow, ring by ring outwards from each missing cell, until the rows
    alone are further than the best. Fields without any valid cell stay missing. Other columns are kept.
    """
    degrees = 360.0 / width if width else step
    if not degrees:
        raise ValueError("a region needs the step of its columns")
    row = Window.partitionBy(*field, "lat_i")
    w = row.orderBy("lon_i")
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("lon_i").cast("long").alias("at"), F.col(value).cast("double").alias("v")))
    west, east = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if width:
        moved = lambda x, d: F.struct((x["at"] + d).alias("at"), x["v"].alias("v"))
        last, first = F.max(seen).over(row), F.min(seen).over(row)
        west, east = F.coalesce(west, F.when(last.isNotNull(), moved(last, -width))), F.coalesce(east, F.when(first.isNotNull(), moved(first, width)))
    rows = cells.withColumn("_w", west).withColumn("_e", east)
    real = lambda x: F.pmod(x, F.lit(width)) if width else x
    to_west, to_east = F.col("lon_i") - F.col("_w.at"), F.col("_e.at") - F.col("lon_i")
    nearer = (to_west < to_east) | ((to_west == to_east) & (real(F.col("_w.at")) <= real(F.col("_e.at"))))
    use_west = F.col("_e").isNull() | F.coalesce(nearer, F.lit(False))
    pick = lambda a, b: F.when(use_west, a).otherwise(b).cast("double")
    rows = rows.select(*cells.columns, F.floor(F.col("lon_i") / STRIPE).alias("_stripe"), pick(to_west, to_east).alias("_off"), pick(F.col("_w.v"), F.col("_e.v")).alias("_near"))
    names = cells.columns
    schema = StructType([StructField(f.name, DoubleType() if f.name == value else f.dataType) for f in cells.schema])

    def fill(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("lat_i", "lon_i", lat, "_off", "_near")}
        gap = batch.column(value).is_null().to_numpy(zero_copy_only=False)
        out = np.empty(batch.num_rows)
        for a, b in itertools.pairwise([*starts, batch.num_rows]):
            i, j, y, off, v = (columns[n][a:b] for n in columns)
            out[a:b] = _fill_stripe(i, j, y, gap[a:b], off, v, degrees) if gap[a:b].any() else v
        own = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        out = pa.array(np.where(gap, out, own), mask=gap & np.isnan(out))
        return pa.RecordBatch.from_arrays([out if n == value else batch.column(n) for n in names], names)

    return in_groups(rows, [*field, "_stripe"], fill, schema)


def smooth(cells: DataFrame, field: Sequence[str], value: str = "value", reach: int = 4, sigma: float = 1.0) -> DataFrame:
    """Separable Gaussian over the cells that are there: along rows, then along columns, the weights of missing ones left out."""
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]

    def one(df: DataFrame, across: str, along: str) -> DataFrame:
        w = Window.partitionBy(*field, across).orderBy(along)
        near = F.collect_list(F.struct(F.col(along).alias("at"), F.col(value).alias("v"))).over(w.rangeBetween(-reach, reach))
        tap = lambda x: F.element_at(F.array(*map(F.lit, taps)), x["at"] - F.col(along) + reach + 1)
        total = lambda g: F.aggregate("_near", F.lit(0.0), lambda acc, x: acc + g(x))
        return df.withColumn("_near", near).withColumn(value, total(lambda x: tap(x) * x["v"]) / total(tap)).drop("_near")

    return one(one(cells.where(F.col(value).isNotNull()), "lat_i", "lon_i"), "lon_i", "lat_i")


def local_extrema(cells: DataFrame, field: Sequence[str], distance: int, threshold: float, value: str = "value", border: int = 0, rows: int = 721, width: int = 1440) -> DataFrame:
    """[W5] Cells above the threshold that are the largest within a square of ``distance`` cells to each side.

    The square maximum is taken along rows, then along columns. Of equal neighbours the first by row, then column stays.
    """
    inner = cells.withColumn("_k", F.struct(F.col(value).alias("v"), (-F.col("lat_i")).alias("i"), (-F.col("lon_i")).alias("j")))
    along = Window.partitionBy(*field, "lat_i").orderBy("lon_i").rangeBetween(-distance, distance)
    down = Window.partitionBy(*field, "lon_i").orderBy("lat_i").rangeBetween(-distance, distance)
    top = inner.withColumn("_r", F.max("_k").over(along)).withColumn("_m", F.max("_r").over(down))
    edge = F.col("lat_i").between(border, rows - 1 - border) & F.col("lon_i").between(border, width - 1 - border)
    return top.where((F.col("_m") == F.col("_k")) & (F.col(value) > threshold) & edge).drop("_k", "_r", "_m")


def axis(spark: SparkSession, n: int, start: float, step: float, name: str) -> DataFrame:
    """Axis table ``<name>_i, <name>``."""
    return spark.range(n).select(F.col("id").cast("int").alias(f"{name}_i"), (start + step * F.col("id")).alias(name))


def linear_weights(source: DataFrame, target: DataFrame, name: str, period: float | None = None, extrapolate: bool = False) -> DataFrame:
    """[J9, J10, J12] ``target_i, source_i, w`` of linear interpolation between two regular axes.

    Outside the source a periodic axis wraps, ``extrapolate`` continues the outermost pair, and else values are clamped.
    """
    s = source.agg(F.min(f"{name}_i").alias("i0"), F.max(f"{name}_i").alias("i1"), F.min_by(name, f"{name}_i").alias("x0"), F.max_by(name, f"{name}_i").alias("x1"))
    n = F.col("i1") - F.col("i0") + 1
    step = (F.col("x1") - F.col("x0")) / (n - 1)
    at = (F.col(name) - F.col("x0")) / step
    if period is not None:
        at = F.pmod(F.col(name) - F.col("x0"), F.lit(period)) / step
        low, high = F.pmod(F.floor(at), n), F.pmod(F.floor(at) + 1, n)
        part = at - F.floor(at)
    else:
        bound = at if extrapolate else F.least(F.greatest(at, F.lit(0.0)), n - 1.0)
        low = F.least(F.greatest(F.floor(bound), F.lit(0)), n - 2)
        high, part = low + 1, bound - low
    pair = F.array(F.struct((low + F.col("i0")).cast("int").alias("i"), (1 - part).alias("w")), F.struct((high + F.col("i0")).cast("int").alias("i"), part.alias("w")))
    both = target.crossJoin(F.broadcast(s)).select(F.col(f"{name}_i").alias("target_i"), F.explode(pair).alias("x"))  # s is one row
    return both.select("target_i", F.col("x.i").alias("source_i"), F.col("x.w").alias("w")).where("w <> 0")


def regrid_linear(cells: DataFrame, lat: DataFrame, lon: DataFrame, field: Sequence[str]) -> DataFrame:
    """[J9] Bilinear regrid by two axis weight tables, one axis after the other: tables grow with axes, not with cells."""
    rows = cells.join(F.broadcast(lat), cells["lat_i"] == lat["source_i"]).groupBy(*field, F.col("target_i").alias("_i"), "lon_i").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    out = rows.join(F.broadcast(lon), rows["lon_i"] == lon["source_i"]).groupBy(*field, "_i", "target_i").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return out.select(*field, F.col("_i").alias("lat_i"), F.col("target_i").alias("lon_i"), "value")


def overlap_weights(source: DataFrame, target: DataFrame, period: float | None = None) -> DataFrame:
    """[J11] ``target_i, source_i, w`` from cells ``i, lo, hi``: length of the overlap, wrapped if periodic; pass sin(lat) bounds for latitudes."""
    shifts = F.array(*map(F.lit, (0.0,) if period is None else (-period, 0.0, period)))
    s = source.select(F.col("i").alias("source_i"), F.explode(shifts).alias("d"), "lo", "hi").select("source_i", (F.col("lo") + F.col("d")).alias("slo"), (F.col("hi") + F.col("d")).alias("shi"))
    both = target.select(F.col("i").alias("target_i"), "lo", "hi").join(F.broadcast(s), (F.col("lo") < F.col("shi")) & (F.col("slo") < F.col("hi")))  # axes of some thousand cells
    return both.groupBy("target_i", "source_i").agg(F.sum(F.least("hi", "shi") - F.greatest("lo", "slo")).alias("w"))


def regrid_conservative(cells: DataFrame, lat: DataFrame, lon: DataFrame, field: Sequence[str]) -> DataFrame:
    """[J11] Area-weighted mean over the overlapped source cells that have a value; null if none has."""
    a, b = lat.select(F.col("target_i").alias("ti"), F.col("source_i").alias("lat_i"), F.col("w").alias("wa")), lon.select(F.col("target_i").alias("tj"), F.col("source_i").alias("lon_i"), F.col("w").alias("wb"))
    valid = F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)
    rows = cells.join(F.broadcast(a), "lat_i").groupBy(*field, "ti", "lon_i").agg(F.sum(F.col("wa") * F.coalesce("value", F.lit(0.0))).alias("s"), F.sum(F.col("wa") * valid).alias("n"))
    out = rows.join(F.broadcast(b), "lon_i").groupBy(*field, "ti", "tj").agg(F.sum(F.col("wb") * F.col("s")).alias("s"), F.sum(F.col("wb") * F.col("n")).alias("n"))
    return out.select(*field, F.col("ti").alias("lat_i"), F.col("tj").alias("lon_i"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("value"))
