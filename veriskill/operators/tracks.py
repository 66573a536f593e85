"""Cyclone tracks: errors, terminations, report tables, best tracks and trackers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.functions import scalars as S
from veriskill.operators.steps import Fields, Tracks, follow


def track_errors(points: DataFrame, best: DataFrame, keys: Sequence[str] = ("sid", "valid_time")) -> DataFrame:
    """[J3, F1] Points with the best track of the time and their distance; without one the error is null."""
    return points.join(best, list(keys), "left").withColumn("error_km", S.haversine_km(F.col("pred_lat"), F.col("pred_lon"), F.col("true_lat"), F.col("true_lon")))


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """[W12, U2] The last row of each key by the order columns, ties broken by them all."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def error_table(points: DataFrame, by: Sequence[str], error: str = "error_km", wind: str | None = None, msl: str | None = None, status: str | None = None) -> DataFrame:
    """[A36, A37] Count of rows, mean, median and RMSE of the error; MAE and bias of wind and pressure errors if given."""
    rows = points.where(F.col(status) == "ok") if status else points
    e = F.col(error)
    more = [x for name in (wind, msl) if name for x in (F.avg(F.abs(name)).alias(f"{name}_mae"), F.avg(name).alias(f"{name}_bias"))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_km"), F.median(e).alias("median_km"), F.sqrt(F.avg(e * e)).alias("rmse_km"), *more)


def homogeneous(points: DataFrame, model: str, key: Sequence[str]) -> DataFrame:
    """[J21, U3] Rows whose key all models of the table have."""
    n = points.agg(F.count_distinct(model).alias("_all"))
    complete = points.groupBy(*key).agg(F.count_distinct(model).alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all").select(*key)  # n is one row
    return points.join(complete, list(key), "left_semi")


def wide(table: DataFrame, by: Sequence[str], column: str, values: Sequence[object], value: str, prefix: str) -> DataFrame:
    """[A39] One column for each of ``values``."""
    out = table.groupBy(*by).pivot(column, list(values)).agg(F.first(value))
    return out.select(*by, *(F.col(str(v)).alias(f"{prefix}{v}") for v in values))


def low_samples(table: DataFrame, n: str = "n", least: int = 10) -> DataFrame:
    """[A40]"""
    return table.where(F.col(n) < least)


def mean_track(members: DataFrame, by: Sequence[str], member: str = "member") -> DataFrame:
    """[A42] Mean position and number of members at each time, the best track left out."""
    return members.where(F.col(member) != "best").groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n"))


def with_best(track: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[J28] A (mean) track with the best track's position (``best_lat, best_lon``) of the same time, null where there is none."""
    return track.join(best.select(*keys, F.col("lat").alias("best_lat"), F.col("lon").alias("best_lon")), list(keys), "left")


def prefix_termination(leads: DataFrame, by: Sequence[str], lead: str, failed: Column, reason: Column) -> DataFrame:
    """[W9] Leads before the first failure of each track, and the track's reason on every row.

    ``failed`` marks a lead that ends its track, ``reason`` says why; without one it is ``max_lead_reached``.
    """
    whole = Window.partitionBy(*by)
    rows = leads.withColumn("_end", F.min(F.when(failed, F.struct(F.col(lead).alias("lead"), reason.alias("reason")))).over(whole))
    rows = rows.withColumn("reason", F.coalesce("_end.reason", F.lit("max_lead_reached"))).withColumn("end_lead", F.coalesce(F.col("_end.lead"), F.max(lead).over(whole)))
    return rows.where(F.col("_end").isNull() | (F.col(lead) < F.col("_end.lead"))).drop("_end")


def track_ends(leads: DataFrame, by: Sequence[str], lead: str, failed: Column, reason: Column) -> DataFrame:
    """[W9, A44] One termination row for each track, even without a kept lead; tracks in ``by`` with null leads end as ``missing_file`` at 0."""
    end = F.min(F.when(failed, F.struct(F.col(lead).alias("lead"), reason.alias("reason"))))
    out = leads.groupBy(*by).agg(end.alias("_end"), F.max(lead).alias("_last"))
    last = F.when(F.col("_last").isNull(), F.struct(F.lit(0).cast("long").alias("lead"), F.lit("missing_file").alias("reason"))).otherwise(F.struct(F.col("_last").cast("long").alias("lead"), F.lit("max_lead_reached").alias("reason")))
    end = F.coalesce(F.struct(F.col("_end.lead").cast("long").alias("lead"), F.col("_end.reason").alias("reason")), last)
    chosen = F.when(F.col("_end").isNotNull(), end).otherwise(last)
    return out.select(*by, chosen["reason"].alias("terminate_reason"), chosen["lead"].alias("terminate_lead"))


def with_forecast(inits: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("model", "init_time")) -> tuple[DataFrame, DataFrame]:
    """[J4, A44] Best-track initialisations that have a forecast file, and a ``missing_file`` row at lead 0 for each that has none.

    ``catalog`` has a row for each file (:func:`~veriskill.sources.readers.forecast_catalog`); one file is enough.
    """
    have = catalog.select(*keys).distinct()
    lost = inits.join(have, list(keys), "left_anti").select("*", F.lit("missing_file").alias("terminate_reason"), F.lit(0).cast("long").alias("terminate_lead"))
    return inits.join(have, list(keys), "left_semi"), lost


def top_cases(cases: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """[W11] The first case of each group, then the first k of these; ``rank`` counts from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    best = cases.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def two_source_cases(left: DataFrame, right: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """[J22] Cases that both sources have, scored by the lesser of their scores."""
    r = right.select(*keys, F.col(score).alias("_other"))
    return left.join(r, list(keys)).withColumn(score, F.least(score, "_other")).drop("_other")


def eye_intensity(cells: DataFrame, eyes: DataFrame, keys: Sequence[str], radius: float = 1.5) -> DataFrame:
    """[A43] Lowest pressure and strongest wind within a box around each eye (``eye_lat, eye_lon``); eyes without cells are left out.

    Longitudes are compared by their plain difference, which nothing is added to: a cell on the edge stays on its side.
    """
    off = F.abs(F.col("lon") - F.col("eye_lon")) % 360
    near = (F.abs(F.col("lat") - F.col("eye_lat")) <= radius) & (F.least(off, 360 - off) <= radius)
    return cells.join(eyes, list(keys)).where(near).groupBy(*keys, "eye_lat", "eye_lon").agg(F.min("msl").alias("min_msl"), F.max(S.wind_speed(F.col("u10"), F.col("v10"))).alias("max_wind"))


def near_points(points: DataFrame, others: DataFrame, keys: Sequence[str], radius_km: float) -> DataFrame:
    """[J18] Points with another table's point within the radius.

    Both sides meet in buckets wider than the radius in latitude; in longitude the bucket follows from the row's
    latitude, so that near the poles a point looks over more of them.
    """
    deg = radius_km / (np.pi / 180 * S.EARTH_KM)
    row = lambda lat: F.floor((lat + 90) / deg)
    b = others.select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), row(F.col("lat")).alias("_row"))
    # The number of longitude buckets of a row: the widest span that the radius can take anywhere in the row or its neighbours.
    edge = lambda r: F.least(F.lit(89.9999), F.greatest(F.abs(r * deg - 90), F.abs((r + 1) * deg - 90)))
    share = lambda r: F.greatest(F.lit(1), F.floor(F.lit(360.0) / (F.lit(deg) / F.cos(F.radians(F.least(F.lit(89.9999), edge(r) + 2 * deg))))))
    b = b.withColumn("_n", share(F.col("_row"))).withColumn("_col", F.floor(F.pmod("_lon", F.lit(360.0)) / 360.0 * F.col("_n")))
    a = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_row", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: row(F.col("lat")) + d)))
    a = a.withColumn("_n", share(F.col("_row")))
    here = F.floor(F.pmod("lon", F.lit(360.0)) / 360.0 * F.col("_n"))
    a = a.withColumn("_col", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(here + d, F.col("_n"))))))
    close = S.haversine_km(a["lat"], a["lon"], b["_lat"], b["_lon"]) <= radius_km
    same = [a[k] == b[k] for k in (*keys, "_row", "_col")]
    cond = close
    for s in same:
        cond = s & cond
    return a.join(b, cond, "left_semi").dropDuplicates(["_id"]).drop("_id", "_row", "_n", "_col")


def link_paths(points: DataFrame, group: Sequence[str], step: str = "step", radius_km: float = 300.0, memory: int = 2) -> DataFrame:
    """[J17] ``points`` (``lat, lon``) with ``path_id``, linked step by step to the nearest path.

    A path is reached by its most recent of the last ``memory`` points within its age times the radius; the nearest
    wins, each path takes one centre, and every centre left starts a path. Groups are independent runs.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", path_id long"

    def link(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values([step, "lat", "lon"], kind="stable").reset_index(drop=True)
        ids, paths, begun = np.full(len(run), -1), [], 0
        for now, rows in run.groupby(step, sort=True).indices.items():
            ids[rows], begun = step_paths(paths, begun, int(now), run.lat.to_numpy()[rows], run.lon.to_numpy()[rows], radius_km, memory)
        return run.assign(path_id=ids)

    return points.groupBy(*group).applyInPandas(link, schema)


def step_paths(paths: list[tuple[int, int, float, float]], begun: int, now: int, lat: np.ndarray, lon: np.ndarray, radius_km: float, memory: int) -> tuple[np.ndarray, int]:
    """Path numbers of one step's centres, and how many paths have begun.

    ``paths`` holds number, last step and position of the paths that can still be reached; it is updated, and those
    that no later step reaches are dropped.
    """
    ids = np.full(len(lat), -1)
    near = []
    for k, at, y, x in paths:
        age = now - at
        if 1 <= age <= memory:
            km = S.EARTH_KM * np.hypot(np.radians(lat - y), np.radians(lon - x))
            near += [(float(km[i]), i, k) for i in np.flatnonzero(km < age * radius_km)]
    taken: set[int] = set()
    for _, i, k in sorted(near):
        if ids[i] < 0 and k not in taken:
            ids[i] = k
            taken.add(k)
    for i in np.flatnonzero(ids < 0):
        ids[i], begun = begun, begun + 1
    paths[:] = [p for p in paths if p[0] not in taken and now - p[1] < memory] + [(int(k), now, float(y), float(x)) for k, y, x in zip(ids, lat, lon, strict=True)]
    return ids, begun


def smoothed(field: np.ndarray) -> np.ndarray:
    """Gaussian of sigma 1 over 9 taps along the last two axes, edges reflected."""
    taps = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    taps /= taps.sum()
    for turn in (-2, -1):
        wide = padded(field, turn, 4, 4)
        field = sum(w * np.take(wide, range(k, k + field.shape[turn]), axis=turn) for k, w in enumerate(taps))
    return field


def padded(field: np.ndarray, axis: int, before: int, after: int) -> np.ndarray:
    wide = [(0, 0)] * field.ndim
    wide[axis] = (before, after)
    return np.pad(field, wide, mode="symmetric")


def nearest_minimum(lat: np.ndarray, lon: np.ndarray, field: np.ndarray, at: np.ndarray, delta: float, size: int) -> np.ndarray:
    """[W6] Local minimum of each smoothed field within the box that is nearest to ``at``, as rows of lat, lon and km; NaN without one.

    The first axis counts the fields; ``lat`` and ``lon`` are their axes, ``at`` has rows of lat and lon.
    """
    out = np.full((len(field), 3), np.nan)
    inside = np.abs(lat - at[:, :1]) <= delta
    turned = (lon - at[:, 1:] + 180) % 360
    across = np.abs(turned - 180) <= delta
    first, order = inside.argmax(axis=1), np.argsort(np.where(across, turned, np.inf), axis=1, kind="stable")
    shape = np.stack([inside.sum(axis=1), across.sum(axis=1)], axis=1)
    for high, wide in np.unique(shape, axis=0):
        if high < 3 or wide < 3:
            continue
        these = np.flatnonzero((shape == (high, wide)).all(axis=1))
        rows, cols = first[these, None] + np.arange(high), order[these, :wide]
        box = smoothed(field[these[:, None, None], rows[:, :, None], cols[:, None, :]])
        low = box
        for turn in (-2, -1):
            low = np.lib.stride_tricks.sliding_window_view(padded(low, turn, size // 2, size - 1 - size // 2), size, axis=turn).min(axis=-1)
        hit = (box == low) & ~np.isnan(box).any(axis=(1, 2))[:, None, None]
        hit[:, [0, -1]], hit[:, :, [0, -1]] = False, False
        b, i, j = np.nonzero(hit)
        y, x, (y0, x0) = lat[these[b], rows[b, i]], lon[these[b], cols[b, j]], at[these[b]].T
        inner = 1 - np.cos(np.radians(y - y0)) + np.cos(np.radians(y)) * np.cos(np.radians(y0)) * (1 - np.cos(np.radians(x - x0)))
        km = 2 * S.EARTH_KM * np.arcsin(np.sqrt(np.clip(inner / 2, 0, 1)))
        near = np.lexsort((km, b))  # stable: the first in the field's order on ties
        _, k = np.unique(b[near], return_index=True)
        out[these[b[near[k]]]] = np.stack([y, x, km], axis=1)[near[k]]
    return out


def straight_on(track: np.ndarray) -> np.ndarray:
    """[W7] The next value of each row, on the straight line of least squares through its values (``np.polyfit``, set up once)."""
    n = track.shape[1]
    if n == 1:
        return track[:, 0]
    lines = np.vander(np.arange(n) + 0.0, 2)
    scale = np.sqrt((lines * lines).sum(axis=0))
    fit = np.array([np.linalg.lstsq(lines / scale, row, n * np.finfo(float).eps)[0] for row in track]) / scale
    return fit[:, 0] * n + fit[:, 1]


def near_eye(lat: np.ndarray, lon: np.ndarray, eye: np.ndarray, radius: float) -> np.ndarray:
    """Cells within the box around each field's eye."""
    return (np.abs(lat - eye[:, :1]) <= radius)[:, :, None] & (np.abs((lon - eye[:, 1:] + 180) % 360 - 180) <= radius)[:, None, :]


def track_storms(
    crops: DataFrame, starts: DataFrame, by: Sequence[str] = ("model", "sid", "init_time"), size: int = 8, lead: str = "lead_h", field: Callable[[pd.DataFrame], Iterator[Fields]] | None = None,
) -> DataFrame:
    """[W7, W8] Storm tracks through cropped fields, the storms of a task side by side, one step after the other.

    ``crops`` holds cells ``lat, lon, msl, u10, v10`` and optionally ``z850`` in a corridor around the best track, or
    steps from which ``field`` makes them; ``starts`` the first position (``lat, lon``). The guess is the straight
    continuation of the last eight points. A step searches pressure minima in shrinking boxes, then the 850 hPa height,
    and is accepted if the wind near the eye exceeds 8 m/s and the eye lies within 560 km; a guess that no search
    confirms counts as 100 km and a fail. A guess outside the corridor ends the track with the reason
    ``corridor_exceeded``.
    """
    names = ("msl", "u10", "v10", *(c for c in ("z850",) if c in crops.columns))

    def search(found: np.ndarray, these: np.ndarray, lat: np.ndarray, lon: np.ndarray, msl: np.ndarray, at: np.ndarray) -> None:
        for d in (5, 4, 3, 2, 1.5):
            if len(these):
                found[these] = nearest_minimum(lat[these], lon[these], msl[these], at[these], d, size)
                these = these[np.isnan(found[these, 2])]

    def step(tracks: Tracks, s: np.ndarray, lat: np.ndarray, lon: np.ndarray, values: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        n, at, msl = np.minimum(tracks.n[s], 8), np.empty((len(s), 2)), values["msl"]
        for k in np.unique(n):
            last = tracks.at[s[n == k]][:, :, -k:]
            at[n == k] = np.stack([straight_on(last[:, 0]), straight_on(np.unwrap(last[:, 1], period=360))], axis=1)
        at = np.stack([np.clip(at[:, 0], -90, 90), at[:, 1] % 360], axis=1)
        inside = (lat.min(axis=1) <= at[:, 0]) & (at[:, 0] <= lat.max(axis=1)) & (np.abs((lon - at[:, 1:] + 180) % 360 - 180).min(axis=1) <= 1.0)
        tracks.reason[s[~inside]] = "corridor_exceeded"
        found = np.full((len(s), 3), np.nan)
        search(found, np.flatnonzero(inside), lat, lon, msl, at)
        lost = np.flatnonzero(inside & np.isnan(found[:, 2]))
        if "z850" in values and len(lost):
            high = nearest_minimum(lat[lost], lon[lost], values["z850"][lost], at[lost], 5, size)
            lost, high = lost[~np.isnan(high[:, 2])], high[~np.isnan(high[:, 2])]
            aim = at.copy()
            aim[lost] = high[:, :2]
            search(found, lost, lat, lon, msl, aim)
            found[lost] = np.where(np.isnan(found[lost, 2:]), high, found[lost])
        lost = inside & np.isnan(found[:, 2])
        over = ~inside | (lost & (tracks.n[s] == 1))
        kept = lost & ~over
        found[kept] = np.concatenate([at[kept], np.full((int(kept.sum()), 1), 100.0)], axis=1)
        tracks.fails[s[kept]] += 1
        eye = near_eye(lat, lon, found[:, :2], 1.5)
        wind = np.where(eye, np.fmax(np.hypot(values["u10"], values["v10"]), -np.inf), -np.inf).max(axis=(1, 2))
        low = np.where(eye, np.fmin(msl, np.inf), np.inf).min(axis=(1, 2))
        good = ~over & (wind > 8) & (found[:, 2] < 560)
        tracks.reason[s[inside & ~good]] = "tracker_fail"
        found[:, 1] %= 360
        tracks.add(s[good], found[good, 0], found[good, 1])
        return good, {"lat": found[good, 0], "lon": found[good, 1], "min_msl": np.where(np.isinf(low), np.nan, low)[good], "max_wind": wind[good], "fails": tracks.fails[s[good]]}

    begun = starts.withColumn("lon", F.pmod("lon", F.lit(360.0)))
    columns = {"lat": "double", "lon": "double", "min_msl": "double", "max_wind": "double", "fails": "long"}
    return follow(crops, begun, by, lead, names, 8, columns, "max_lead_reached", step, field)
