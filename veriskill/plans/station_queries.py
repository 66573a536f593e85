"""Queries of station verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriskill.functions import scalars as S
from veriskill.operators import stations as O
from veriskill.plans.register import query, rounded


@query("fx_station_obs", "fx_grid", sql="""WITH st AS (SELECT DISTINCT station, lat, lon FROM fx_station_obs), p AS (SELECT station, (lat - 80)/-7::DOUBLE AS y, ((lon % 360) + 360) % 360 / 10::DOUBLE AS x FROM st),
q AS (SELECT station, y, x, least(greatest(floor(y), 0), 22)::INT AS i, floor(x)::INT % 36 AS j FROM p WHERE y >= 0 AND y <= 23),
c AS (SELECT station, i + a AS lat_i, (j + b) % 36 AS lon_i, CASE WHEN a = 1 THEN y - i ELSE 1 - (y - i) END * CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM q, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))
SELECT model, station, CASE WHEN count(*) FILTER (value IS NULL AND w > 0) = 0 THEN round(sum(w*value), 4) END AS value FROM (SELECT DISTINCT model, lat_i FROM fx_grid) r JOIN c USING (lat_i) LEFT JOIN fx_grid USING (model, lat_i, lon_i) GROUP BY ALL""")
def bilinear_to_station(spark, obs, grid):
    """[J5, J6]"""
    stations = obs.select("station", "lat", "lon").distinct()
    filled = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda j: F.try_element_at("m", j))
    rows = grid.groupBy("model", "lat_i").agg(F.map_from_entries(F.collect_list(F.struct("lon_i", "value"))).alias("m")).select("model", "lat_i", filled.alias("vals"))
    return rounded(O.to_stations(rows, O.corners(stations, 24, 36, 80.0, -7.0), ["model"]))


@query("fx_station_obs", sql="""WITH s AS (SELECT *, round(epoch(ts)/21600)*21600 AS slot FROM fx_station_obs) SELECT station, variable, slot::BIGINT AS slot, round(avg(value), 4) AS value, count(*) AS n_obs FROM s WHERE abs(epoch(ts)-slot) <= 900 GROUP BY ALL""")
def slot_15min(spark, obs):
    """[J8, A25]"""
    out = O.slots(obs.withColumn("ts", F.col("ts").cast("timestamp")), ["station", "variable"], "ts", ["value"])
    return rounded(out.withColumn("slot", F.unix_timestamp("slot")))


@query("fx_station_obs", sql="""WITH j AS (SELECT variable, value*1.1 + station % 7 AS pred, value AS obs, CASE WHEN station % 11 = 0 THEN NULL ELSE 50.0::DOUBLE + station % 5 END AS clim FROM fx_station_obs), r AS (SELECT * FROM j WHERE clim IS NOT NULL AND obs IS NOT NULL)
SELECT variable, round(sqrt(avg((pred-obs)*(pred-obs))), 4) AS wrmse, round(avg(pred-obs), 4) AS bias, round(avg(abs(pred-obs)), 4) AS mae, round(sqrt(avg((pred-clim)*(pred-clim))), 4) AS activity,
 round(sum((pred-clim)*(obs-clim))/sqrt(sum((pred-clim)*(pred-clim))*sum((obs-clim)*(obs-clim))), 4) AS acc, count(*) AS n FROM r GROUP BY variable""")
def station_metrics(spark, obs):
    """[A24]"""
    s = F.col("station")
    j = obs.select("variable", (F.col("value") * 1.1 + s % 7).alias("pred"), F.col("value").alias("obs"), F.when(s % 11 != 0, F.lit(50.0) + s % 5).alias("clim"))
    return rounded(O.station_scores(j, ["variable"]))


@query("fx_station_obs", sql="""WITH q AS (SELECT station, ts, variable, value, value/nullif(10.0::DOUBLE + station % 40, 0) > 3 AS flagged, 10.0::DOUBLE + station % 40 AS ref FROM fx_station_obs)
SELECT variable, count(*) FILTER (flagged) AS n_flagged, round(avg(CASE WHEN flagged THEN ref ELSE value END), 4) AS value FROM q GROUP BY variable""")
def ratio_quality_check(spark, obs):
    """[P25]"""
    value, bad = S.ratio_checked(F.col("value"), F.lit(10.0) + F.col("station") % 40, 3.0)
    return rounded(obs.select("variable", value.alias("v"), bad.alias("b")).groupBy("variable").agg(F.count_if("b").alias("n_flagged"), F.avg("v").alias("value")))


@query("fx_station_obs", sql="""WITH o AS (SELECT station, ts, value, CASE WHEN station % 9 = 0 THEN NULL ELSE (station*31) % 360 END::DOUBLE AS d FROM fx_station_obs)
SELECT station, round(avg(-value*sin(radians(d))), 4) AS u10, round(avg(-value*cos(radians(d))), 4) AS v10, round(avg(sqrt(pow(value*sin(radians(d)), 2) + pow(value*cos(radians(d)), 2))), 4) AS speed FROM o WHERE d IS NOT NULL GROUP BY station""")
def wind_components(spark, obs):
    """[P18, P19, P20, P24]"""
    d = F.when(F.col("station") % 9 == 0, 999.0).otherwise(((F.col("station") * 31) % 360).cast("double"))
    x = obs.select("station", "ts", F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("double").alias("sea_level_pressure"), F.col("value").alias("wind_speed"), d.alias("wind_direction"))
    long = O.observed(x.withColumn("id", F.monotonically_increasing_id()), ["station", "id"])
    wide = long.groupBy("station", "id").agg(F.max(F.when(F.col("variable") == "u10", F.col("obs"))).alias("u10"), F.max(F.when(F.col("variable") == "v10", F.col("obs"))).alias("v10"))
    return rounded(wide.groupBy("station").agg(F.avg("u10").alias("u10"), F.avg("v10").alias("v10"), F.avg(S.wind_speed(F.col("u10"), F.col("v10"))).alias("speed")))


@query("fx_station_obs", sql="""WITH v AS (SELECT date_trunc('day', ts) AS t, CASE WHEN user_var THEN 't2m' ELSE 'msl' END AS variable, value FROM (SELECT *, variable IN ('click', 'view') AS user_var FROM fx_station_obs)), m AS (SELECT t, variable, median(value) AS m FROM v GROUP BY ALL)
SELECT variable, round(avg(CASE WHEN variable = 't2m' AND m < 100 THEN value + 273.15 WHEN variable = 'msl' AND m < 5000 THEN value * 100 ELSE value END), 4) AS value FROM v JOIN m USING (t, variable) GROUP BY variable""")
def unit_guess(spark, obs):
    """[P13, P14]"""
    x = obs.select(F.date_trunc("day", "ts").alias("t"), F.when(F.col("variable").isin("click", "view"), "t2m").otherwise("msl").alias("variable"), "value")
    return rounded(O.unit_guess(x, ["t", "variable"]).groupBy("variable").agg(F.avg("value").alias("value")))


@query("fx_station_obs", sql="""WITH c AS (SELECT DISTINCT station, lat + 1 AS la, lon - 1 AS lo FROM fx_station_obs WHERE station % 2 = 0) SELECT station, round(any_value(coalesce(la, lat)), 4) AS lat, round(any_value(coalesce(lo, lon)), 4) AS lon FROM fx_station_obs LEFT JOIN c USING (station) GROUP BY station""")
def station_positions(spark, obs):
    """[J7]"""
    c = obs.where("station % 2 = 0").select("station", (F.col("lat") + 1).alias("lat"), (F.col("lon") - 1).alias("lon")).distinct()
    return rounded(O.with_positions(obs, c).groupBy("station").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")))
