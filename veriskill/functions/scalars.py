"""Scalar column functions: units, positions, names and times. Codes in brackets name the inventory rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KNOT = 0.514444
GRAVITY = 9.80665


def clean(x: Column) -> Column:
    """[P30] NaN and infinite to null: numbers that are not finite never enter a table."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def channel_key(name: Column) -> Column:
    """[P1] Channel name without underscores and blanks, in lower case."""
    return F.lower(F.trim(F.regexp_replace(name, "_", "")))


def channel_variable(name: Column) -> Column:
    """[P3] Variable part of ``z_500``, ``Z500`` or ``geopotential_500``; surface names stay whole."""
    return F.when(name.rlike(r"^[A-Za-z]+_?[0-9]{2,4}$") & ~name.rlike(r"^[uv](10|100)$"), F.lower(F.regexp_extract(name, r"^([A-Za-z]+?)_?[0-9]+$", 1))).otherwise(F.lower(name))


def channel_level(name: Column) -> Column:
    """[P3] Pressure level in hPa, null for surface names."""
    return F.when(name.rlike(r"^[A-Za-z]+_?[0-9]{2,4}$") & ~name.rlike(r"^[uv](10|100)$"), F.regexp_extract(name, r"([0-9]+)$", 1).try_cast("int"))


def saved_name(name: Column) -> Column:
    """[P5] Humidity is saved under ``r_``."""
    return F.when(name.startswith("q_"), F.concat(F.lit("r_"), F.substring(name, 3, 100))).otherwise(name)


def eval_name(name: Column) -> Column:
    """[P5] Name under which a channel is scored: lower case, ``v_level``; precipitation is ``tp``."""
    low = F.lower(F.trim(name))
    level = F.concat(F.lower(F.regexp_extract(F.trim(name), r"^([a-zA-Z]+)_?(\d{2,4})$", 1)), F.lit("_"), F.regexp_extract(F.trim(name), r"^([a-zA-Z]+)_?(\d{2,4})$", 2))
    return F.when(low.isin("tp", "tp6h"), "tp").when(low.isin("msl", "t2m", "u10", "v10"), low).when(F.trim(name).rlike(r"^[a-zA-Z]+_?\d{2,4}$"), level).otherwise(low)


def is_scored(name: Column) -> Column:
    """[P5] Relative humidity is not scored."""
    return ~eval_name(name).startswith("r_")


def valid_time(init: Column, lead_hours: Column) -> Column:
    """[P7] Initialisation plus lead."""
    return init + F.make_dt_interval(hours=lead_hours)


def lead_day(valid: Column, init: Column) -> Column:
    """[P10] Calendar days from initialisation, the first is 1."""
    return F.datediff(valid.cast("date"), init.cast("date")) + 1


def lon_360(lon: Column) -> Column:
    """[P11] Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def lon_180(lon: Column) -> Column:
    """[P11] Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def flipped(lat_i: Column, rows: int = 721) -> Column:
    """[P12] Row index from the other pole."""
    return F.lit(rows - 1) - lat_i


def rolled(lon_i: Column, width: int = 1440) -> Column:
    """[P12] Column index after a roll by half the width."""
    return F.pmod(lon_i + width // 2, F.lit(width))


def celsius(x: Column, unit: Column) -> Column:
    """[P13] Kelvin to degrees by the unit attribute."""
    return F.when(F.upper(unit).isin("K", "KELVIN"), x - 273.15).otherwise(x)


def pascal(x: Column, median: Column) -> Column:
    """[P14] hPa to Pa if the field's median says hPa."""
    return F.when(median < 5000, x * 100).otherwise(x)


def hectopascal(x: Column) -> Column:
    """[P14] Pa to hPa by magnitude."""
    return F.when(x > 2000, x / 100).otherwise(x)


def metres_per_second(knots: Column) -> Column:
    """[P15]"""
    return knots * KNOT


def geopotential(x: Column, unit: Column) -> Column:
    """[P16] Height in gpm or m to geopotential."""
    return F.when(unit.isin("gpm", "m"), x * GRAVITY).otherwise(x)


def rain_mm(metres: Column) -> Column:
    """[P17] Metres to millimetres within 0 and 1000."""
    return F.least(F.greatest(metres * 1000, F.lit(0.0)), F.lit(1000.0))


def wind_speed(u: Column, v: Column) -> Column:
    """[P18]"""
    return F.sqrt(u * u + v * v)


def wind_u(speed: Column, direction: Column) -> Column:
    """[P19] Eastward part of a wind that comes from ``direction``."""
    return -speed * F.sin(F.radians(direction))


def wind_v(speed: Column, direction: Column) -> Column:
    """[P19] Northward part."""
    return -speed * F.cos(F.radians(direction))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """[P21, P22] Inside an inclusive box; a box with west > east crosses the date line."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def band(lat: Column) -> Column:
    """[P23] tropics [-30, 30], north (30, 90], south [-90, -30)."""
    return F.when(lat.between(-30, 30), "tropics").when(lat > 30, "north").when(lat < -30, "south")


def without(x: Column, sentinel: object) -> Column:
    """[P24] Sentinel to null."""
    return F.nullif(x, F.lit(sentinel))


def ratio_checked(obs: Column, ref: Column, limit: float) -> tuple[Column, Column]:
    """[P25] The observation, or the reference where their ratio exceeds the limit; and the flag. A null ratio keeps the observation."""
    bad = F.coalesce(F.try_divide(obs, ref) > limit, F.lit(False))
    return F.when(bad, ref).otherwise(obs), bad


def standardised(x: Column, mean: Column, std: Column) -> Column:
    """[P26]"""
    return F.try_divide(x - mean, std)


def exceedance(x: Column, threshold: Column) -> Column:
    """[P27] Amount above the threshold, 0 below."""
    return F.greatest(x - threshold, F.lit(0.0))


def exceeds(x: Column, threshold: Column, cold: bool = False) -> Column:
    """[P27] Strictly above (heat) or below (cold); null counts as no."""
    return F.coalesce(x < threshold if cold else x > threshold, F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    inner = 1 - F.cos(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (1 - F.cos(F.radians(lon2 - lon1)))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.greatest(inner / 2, F.lit(0.0)), F.lit(1.0))))


def equirectangular_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of (lat, lon) in radians times the radius, longitudes not shortened by latitude."""
    return F.lit(EARTH_KM) * F.sqrt(F.pow(F.radians(lat2 - lat1), 2) + F.pow(F.radians(lon2 - lon1), 2))


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of inclusive spans of day numbers."""
    both = overlap_days(s1, e1, s2, e2)
    return both / ((e1 - s1 + 1) + (e2 - s2 + 1) - both)


def wrapped_doy(doy: Column) -> Column:
    """Day of year in 1..366."""
    return F.pmod(doy - 1, F.lit(366)) + 1


def time_encoding(t: Column, offset_hours: int = 0) -> list[Column]:
    """sin and cos of day of year and hour."""
    x = t + F.make_dt_interval(hours=F.lit(offset_hours))
    d, h = F.dayofyear(x) / 366.0 * 6.283185307179586, F.hour(x) / 24.0 * 6.283185307179586
    return [F.sin(d).alias("sin_doy"), F.cos(d).alias("cos_doy"), F.sin(h).alias("sin_hour"), F.cos(h).alias("cos_hour")]


def eval_key(sid: Column, init: Column, lead: Column) -> Column:
    """[F12]"""
    return F.concat_ws("|", sid, F.date_format(init, "yyyy-MM-dd'T'HH:mm:ss"), lead.cast("string"))


def case_parts(case: Column) -> tuple[Column, Column]:
    """Storm and time of ``SID@timestamp``."""
    return F.element_at(F.split(case, "@"), 1), F.try_to_timestamp(F.try_element_at(F.split(case, "@"), F.lit(2)))
