"""Cyclone detection on single fields: vorticity objects, warm cores and pressure minima."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.functions import scalars as S
from veriskill.operators.grid import local_extrema
from veriskill.operators.objects import label, large_objects
from veriskill.operators.steps import Fields, Tracks, follow
from veriskill.operators.tracks import link_paths, near_eye, near_points


def convex_area(points: np.ndarray) -> float:
    """Area of the hull around unit cells centred on the points."""
    corners = np.unique((points[:, None, :] * 2 + np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)])[None]).reshape(-1, 2), axis=0)

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(half(corners) + half(corners[::-1]), float) / 2
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def shape_of(lat_i: np.ndarray, lon_i: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Axis ratio, solidity, and whether each cell survives erosion by its four neighbours."""
    points = np.stack([lat_i, lon_i], axis=1).astype(float)
    spread = np.cov(points.T, bias=True) + np.eye(2) / 12 if len(points) > 1 else np.eye(2) / 12
    low, high = np.linalg.eigvalsh(spread)
    cells = set(zip(lat_i.tolist(), lon_i.tolist(), strict=True))
    core = np.array([all((i + a, j + b) in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for i, j in zip(lat_i.tolist(), lon_i.tolist(), strict=True)])
    return float(np.sqrt(high / low)), len(points) / convex_area(points), core


def vorticity_objects(cells: DataFrame, field: Sequence[str], basin: Column, threshold: float = 1.4e-4, least: int = 18, max_ratio: float = 2.0, min_solidity: float = 0.3, max_quotient: float = 4.0) -> DataFrame:
    """[O6] Cyclones as objects of strong vorticity: ``field, lat, lon, min_msl, max_wind``.

    Cells (``lat_i, lon_i, lat, lon, vorticity, msl, u10, v10``) above the threshold are labelled; objects are kept that
    are large, round and solid enough, keep a core of more than one cell under erosion, have the core's vorticity above
    the rim's and lie in the basin. The shape of an object is judged in one task, labelled cells only.
    """
    strong = label(cells.where(F.col("vorticity") > threshold), field)
    objects = large_objects(strong, field, least)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name in field)
    schema = f"{keys}{', ' if keys else ''}lat double, lon double, min_msl double, max_wind double, cells long"

    def judge(o: pd.DataFrame) -> pd.DataFrame:
        ratio, solidity, core = shape_of(o.lat_i.to_numpy(), o.lon_i.to_numpy())
        v = o.vorticity.to_numpy()
        good = ratio <= max_ratio and core.sum() > 1 and solidity >= min_solidity and ratio / solidity <= max_quotient and v[core].mean() > (v[~core].mean() if (~core).any() else -np.inf)
        row = {**{c: o[c].iloc[0] for c in field}, "lat": o.lat.mean(), "lon": o.lon.mean(), "min_msl": o.msl.min(), "max_wind": float(np.hypot(o.u10, o.v10).max()), "cells": len(o)}
        return pd.DataFrame([row] if good else [], columns=[*field, "lat", "lon", "min_msl", "max_wind", "cells"])

    return objects.groupBy(*field, "label").applyInPandas(judge, schema).where(basin)


def directional_drop(cells: DataFrame, centres: DataFrame, field: Sequence[str], value: str, drop: float, steps: int) -> DataFrame:
    """[O7] Centres from which the value falls by ``drop`` within ``steps`` cells in each of the four grid directions."""
    ways = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    rays = centres.select(*field, "lat_i", "lon_i", F.col(value).alias("_v"), F.explode(ways).alias("d")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    seen = rays.select("*", (F.col("lat_i") + F.col("k") * F.col("d.a")).alias("_i"), (F.col("lon_i") + F.col("k") * F.col("d.b")).alias("_j"))
    other = cells.select(*field, F.col("lat_i").alias("_i"), F.col("lon_i").alias("_j"), F.col(value).alias("_w"))
    lowest = seen.join(other, [*field, "_i", "_j"]).groupBy(*field, "lat_i", "lon_i", "d").agg(F.max(F.col("_v") - F.col("_w")).alias("_fall"))
    good = lowest.where(F.col("_fall") >= drop).groupBy(*field, "lat_i", "lon_i").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4").drop("_n")
    return centres.join(good, [*field, "lat_i", "lon_i"], "left_semi")


def warm_cores(cells: DataFrame, field: Sequence[str], distance: int = 8, vorticity_min: float = 3.5e-5, rows: int = 721, width: int = 1440, warm_km: float = 8 * 25.0, near_km: float = 2 * 25.0, drop: float = 0.5, cell_km: float = 25.0) -> DataFrame:
    """[O7, F10] Pressure minima near a vorticity maximum whose warm core and thickness maximum lie close: ``field, lat_i, lon_i, lat, lon, msl``.

    ``cells`` have ``lat, lon, msl, vorticity, warm`` (mean temperature of the layer) and ``thickness`` (z200 - z850);
    the warm core cools by ``drop`` within ``warm_km`` to all four sides, in cells of ``cell_km``.
    """
    peak = lambda c, low, value: local_extrema(c.withColumn("_x", value), field, distance, low, "_x", rows=rows, width=width)
    minima = peak(cells, float("-inf"), -F.col("msl")).drop("_x")
    spin = peak(cells, vorticity_min, F.col("vorticity"))
    warm = directional_drop(cells, peak(cells, float("-inf"), F.col("warm")), field, "warm", drop, int(warm_km // cell_km))
    thick = peak(cells, float("-inf"), F.col("thickness"))
    out = near_points(minima, spin, field, warm_km)
    return near_points(near_points(out, warm, field, near_km), thick, field, near_km).select(*field, "lat_i", "lon_i", "lat", "lon", "msl")


def layer_thickness(fields: DataFrame, cell: Sequence[str], variable: str = "z", top: int = 200, bottom: int = 850) -> DataFrame:
    """Difference of two levels of a variable."""
    at = lambda lev: F.max(F.when((F.col("variable") == variable) & (F.col("level_hpa") == lev), F.col("value")))
    return fields.groupBy(*cell).agg((at(top) - at(bottom)).alias("thickness"))


def layer_mean(fields: DataFrame, cell: Sequence[str], levels: Sequence[int], variable: str = "t") -> DataFrame:
    """Mean of a variable over levels."""
    return fields.where((F.col("variable") == variable) & F.col("level_hpa").isin(*levels)).groupBy(*cell).agg(F.avg("value").alias("mean"))


def minimum_pressure_track(
    crops: DataFrame, starts: DataFrame, by: Sequence[str], lead: str = "lead_h", radius_km: float = 278.0, max_msl: float = 101_200.0, min_wind: float = 10.2, most: int = 40,
    wind_deg: float = 100.0, lats: tuple[float, float] = (-50.0, 50.0), lons: tuple[float, float] = (0.0, 360.0),
    field: Callable[[pd.DataFrame], Iterator[Fields]] | None = None,
) -> DataFrame:
    """[W10] Tracks by the lowest pressure within a box around the last position: ``by, lead, lat, lon, min_msl, max_wind``.

    The box reaches ``radius_km`` to each side, in longitude by the latitude of the last position, and round the globe;
    of equal pressures the northernmost, then the westernmost counts. A step ends its track and is left out if pressure
    there is above ``max_msl``, the strongest wind within ``wind_deg`` degrees is below ``min_wind``, the jump is longer
    than the radius, the point lies outside the bounds, more than ``most`` points are behind it, or the box is empty. A
    task follows its storms side by side. ``crops`` holds cells, or steps from which ``field`` makes them.
    """
    deg = radius_km / 111.32

    def step(tracks: Tracks, s: np.ndarray, lat: np.ndarray, lon: np.ndarray, values: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at, msl, each = tracks.at[s][:, :, -1], values["msl"], np.arange(len(s))
        off = np.abs(lon - at[:, 1:]) % 360
        wide = np.minimum(off, 360 - off) <= deg / np.maximum(1e-9, np.cos(np.radians(at[:, :1])))
        box = (np.abs(lat - at[:, :1]) <= deg)[:, :, None] & wide[:, None, :] & ~np.isnan(msl)
        low = np.where(box, msl, np.inf).min(axis=(1, 2))
        hit = box & (msl == low[:, None, None])
        i = lat.shape[1] - 1 - hit.any(axis=2)[:, ::-1].argmax(axis=1)
        y, x = lat[each, i], lon[each, hit[each, i].argmax(axis=1)]
        near = near_eye(lat, lon, np.stack([y, x], axis=1), wind_deg)
        wind = np.where(near, np.fmax(np.hypot(values["u10"], values["v10"]), -np.inf), -np.inf).max(axis=(1, 2))
        inner = 1 - np.cos(np.radians(y - at[:, 0])) + np.cos(np.radians(at[:, 0])) * np.cos(np.radians(y)) * (1 - np.cos(np.radians(x - at[:, 1])))
        jump = 2 * S.EARTH_KM * np.arcsin(np.sqrt(np.clip(inner / 2, 0, 1)))
        inside = (lats[0] <= y) & (y <= lats[1]) & (lons[0] <= x) & (x <= lons[1])
        good = box.any(axis=(1, 2)) & (low <= max_msl) & (wind >= min_wind) & (jump <= radius_km) & (tracks.n[s] <= most + 1) & inside
        tracks.reason[s[~good]] = "ended"
        tracks.add(s[good], y[good], x[good])
        return good, {"lat": y[good], "lon": x[good], "min_msl": low[good], "max_wind": wind[good]}

    columns = {"lat": "double", "lon": "double", "min_msl": "double", "max_wind": "double"}
    return follow(crops, starts, by, lead, ("msl", "u10", "v10"), 1, columns, None, step, field)


def centre_paths(centres: DataFrame, run: Sequence[str], step: str = "step", radius_km: float = 300.0, memory: int = 2, least: int = 1) -> DataFrame:
    """[O8] Detected centres (``lat, lon`` at each ``step``) of a run linked to paths of at least ``least`` points, with ``path_id``."""
    linked = link_paths(centres, run, step, radius_km, memory)
    size = F.count(F.lit(1)).over(Window.partitionBy(*run, "path_id"))
    return linked.withColumn("_n", size).where(F.col("_n") >= least).drop("_n")
