"""Station verification: interpolation to stations, observation slots, quality checks and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriskill.functions import scalars as S

#: Observed column for each scored variable.
OBSERVED = {"t2m": "temperature", "msl": "sea_level_pressure", "u10": None, "v10": None}


def corners(stations: DataFrame, rows: int, width: int, lat0: float, dlat: float) -> DataFrame:
    """[J5] ``station, lat_i, lon_i, w``: the four grid corners around each station.

    Latitudes run from ``lat0`` by ``dlat`` (negative: N to S), longitudes from 0 around the globe. Stations beyond the
    grid's latitudes or without a position have no corners.
    """
    y = (F.col("lat") - lat0) / dlat
    x = S.lon_360(F.col("lon")) / (360.0 / width)
    i = F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(rows - 2)).cast("int")
    j = F.pmod(F.floor(x), F.lit(width)).cast("int")
    wy, wx = y - i, F.least(F.greatest(x - F.floor(x), F.lit(0.0)), F.lit(1.0))
    corner = [F.struct((i + a).alias("lat_i"), F.pmod(j + b, F.lit(width)).cast("int").alias("lon_i"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w")) for a in (0, 1) for b in (0, 1)]
    inside = (y >= 0) & (y <= rows - 1) & F.col("lon").isNotNull()
    return stations.where(inside).select("station", F.inline(F.array(*corner)))


def to_stations(rows: DataFrame, corner: DataFrame, field: Sequence[str], values: str = "vals", spread: int = 8) -> DataFrame:
    """[J5, J6] Bilinear values at stations from latitude rows (``lat_i`` and an array over longitudes). A null corner gives null.

    Each row is put beside its southern neighbour; the pair then meets the stations between the two and gives their
    values at once: as many as fields times stations, none of which is shuffled. Stations are repeated ``spread`` times,
    so that a latitude's fields are shared out. A station has one position, its corners lie in two neighbouring rows.
    """
    pair = F.explode(F.array(*(F.struct((F.col("lat_i") - d).alias("_i"), F.lit(d).alias("_d")) for d in (0, 1))))
    half = lambda d: F.first(F.when(F.col("_p._d") == d, F.col(values)), ignorenulls=True).alias(f"_v{d}")
    pairs = rows.withColumn("_p", pair).groupBy(*field, F.col("_p._i").alias("_i")).agg(half(0), half(1)).withColumn("_s", F.pmod(F.xxhash64(*field), F.lit(spread)))

    four = corner.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("lat_i", "lon_i", "w"))).alias("_c"), F.min("lat_i").alias("_i"))
    fits = (F.size("_c") <= 4) & (F.array_max("_c.lat_i") <= F.col("_i") + 1)
    four = four.withColumn("_i", F.when(fits, F.col("_i")).otherwise(F.raise_error(F.lit("a station with corners in more than one place")).cast("int")))
    flat = [x for k in range(4) for c in (F.get("_c", F.lit(k)),) for x in ((c["lat_i"] - F.col("_i")).alias(f"_d{k}"), c["lon_i"].alias(f"_x{k}"), c["w"].alias(f"_w{k}"))]
    stations = four.select("station", "_i", *flat).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))

    row = [F.when(F.col(f"_d{k}") == 0, F.col("_v0")).when(F.col(f"_d{k}") == 1, F.col("_v1")) for k in range(4)]
    at = [F.get(r, F.col(f"_x{k}")) for k, r in enumerate(row)]
    gap = [r.isNotNull() & v.isNull() & (F.col(f"_w{k}") > 0) for k, (r, v) in enumerate(zip(row, at, strict=True))]
    part = [F.col(f"_w{k}") * v for k, v in enumerate(at)]
    total = reduce(lambda x, y: x + y, (F.coalesce(p, F.lit(0.0)) for p in part))
    value = F.when(~reduce(lambda x, y: x | y, gap) & F.coalesce(*part).isNotNull(), total)
    return pairs.join(stations, ["_i", "_s"]).select(*field, "station", value.alias("value"))


def slots(obs: DataFrame, by: Sequence[str], time: str, values: Sequence[str], meta: Sequence[str] = (), hours: int = 6, minutes: int = 15) -> DataFrame:
    """[J8, A25] Means of observations within ``minutes`` of each synoptic time, with the first row's metadata."""
    step = hours * 3600
    us = F.unix_micros(F.col(time).cast("timestamp"))  # whole seconds would let in what lies less than one beyond
    slot = F.round(us / (step * 1_000_000)).cast("long") * step
    rows = obs.withColumn("slot", slot).where(F.abs(us - slot * 1_000_000) <= minutes * 60_000_000)
    out = rows.groupBy(*by, "slot").agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n_obs"), *(F.min_by(m, F.struct(time, m)).alias(m) for m in meta))
    return out.withColumn("slot", F.timestamp_seconds("slot"))


def with_positions(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """[J7] Coordinates of the catalog, where it has the station, in place of the file's."""
    c = catalog.select("station", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    joined = obs.join(c, "station", "left")
    return joined.withColumn("lat", F.coalesce("_lat", "lat")).withColumn("lon", F.coalesce("_lon", "lon")).drop("_lat", "_lon")


def observed(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[P20] Long form ``variable, obs`` from the wide table, wind from speed and direction (999 is none)."""
    d = S.without(F.col("wind_direction"), 999.0)
    wide = obs.select(*keys, F.col("temperature").alias("t2m"), F.col("sea_level_pressure").alias("msl"), S.wind_u(F.col("wind_speed"), d).alias("u10"), S.wind_v(F.col("wind_speed"), d).alias("v10"))
    return wide.unpivot(list(keys), list(OBSERVED), "variable", "obs").where(F.col("obs").isNotNull())


def unit_guess(values: DataFrame, by: Sequence[str], value: str = "value", variable: str = "variable") -> DataFrame:
    """[P13, P14] Temperatures to Kelvin and pressures to Pa where the median over all stations of the field says otherwise."""
    med = values.groupBy(*by).agg(F.median(value).alias("_m"))
    fixed = F.when((F.col(variable) == "t2m") & (F.col("_m") < 100), F.col(value) + 273.15).when((F.col(variable) == "msl") & (F.col("_m") < 5000), F.col(value) * 100).otherwise(F.col(value))
    return values.join(med, list(by)).withColumn(value, fixed).drop("_m")


def station_scores(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    """[A24] Unweighted scores over rows that have ``pred, obs`` and ``clim``."""
    p, o, c = F.col("pred"), F.col("obs"), F.col("clim")
    rows = joined.where(p.isNotNull() & o.isNotNull() & c.isNotNull())
    fa, oa, e = p - c, o - c, p - o
    acc: Column = F.try_divide(F.sum(fa * oa), F.sqrt(F.sum(fa * fa) * F.sum(oa * oa)))
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("wrmse"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(fa * fa)).alias("activity"), acc.alias("acc"), F.count(F.lit(1)).alias("n"))
