"""Queries of files: rows of the driver's tables are written as the files that users have, then scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriskill.functions import scalars as S
from veriskill.operators import coverage as C
from veriskill.operators import detect as D
from veriskill.operators import events as E
from veriskill.operators import tracks as T
from veriskill.plans.register import query, rounded
from veriskill.sources import models, npy_source, readers, sinks
from veriskill.sources.scratch import fresh_path

_EXTRA = [f"measurement_code_{k}" for k in range(222)]


@query("events", sql="""SELECT user_id::VARCHAR AS station, count(*) AS n, round(sum(value), 3) AS temperature, count(CASE WHEN event_id % 10 <> 0 THEN 1 END) AS directions, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS elevations,
count(CASE WHEN user_id % 2 = 0 THEN 1 END) AS winds, round(sum(2*value), 3) AS precipitation_24_hour, max(date_trunc('second', ts)) AS last_time FROM events GROUP BY user_id""")
def station_file_scan(spark, events):
    """[S17, P24, P29, P30] Pipe-separated files of 240 columns in two orders, with quoted separators and sentinels."""
    cells = {
        "DATE": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "STATION": F.col("user_id").cast("string"), "temperature": F.col("value").cast("string"), "wind_direction": F.when(F.col("event_id") % 10 == 0, "999").otherwise("90"),
        "ELEVATION": F.when(F.col("event_id") % 3 == 0, "******").otherwise("12.5"), "wind_speed": F.lit("3"), "Station_name": F.concat(F.lit('The "old"| mast '), F.col("user_id")), "precipitation_24_hour": (F.col("value") * 2).cast("string"),
    }
    extra = {n: F.lit("s") for n in _EXTRA}
    moved = {k: v for k, v in reversed((extra | cells).items()) if k != "wind_speed"}
    path = fresh_path(spark)
    for parity, layout in enumerate((cells | extra, extra | moved)):
        rows = events.where(F.col("user_id") % 2 == parity).select(*(c.alias(n) for n, c in layout.items()))
        rows.write.option("sep", "|").option("header", True).option("escape", '"').csv(f"{path}/layout={parity}")
    found = readers.station_files(spark, path)
    out = found.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("temperature").alias("temperature"), F.count("wind_direction").alias("directions"), F.count("elevation").alias("elevations"), F.count("wind_speed").alias("winds"), F.sum("precipitation_24_hour").alias("precipitation_24_hour"), F.max("time").cast("timestamp_ntz").alias("last_time"))
    return rounded(out, 3)


@query("fx_cell_day", sql="""SELECT model, strftime(day, '%Y010100') AS init_time, lead_h AS lead_hours, source AS variable, round(avg(abs(pred - truth)), 4) AS mae, round(avg(pred - truth) + 1e-7, 4) AS bias, CASE WHEN lead_h > 6 THEN round(max(pred), 4) END AS acc FROM fx_cell_day GROUP BY 1, 2, 3, 4""")
def metric_file_scan(spark, cells):
    """[S23, K3, K4, P29, P30] Metric rows split by model and initialisation into CSV files, saved twice, and scanned; NaN is missing."""
    path = fresh_path(spark)
    acc = F.when(F.col("lead_h") > 6, F.max("pred")).otherwise(F.lit(float("nan"))).alias("acc")
    rows = cells.groupBy("model", F.date_format("day", "yyyy010100").alias("init_time"), "lead_h", "source").agg(F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"), F.avg(F.col("pred") - F.col("truth")).alias("bias"), acc)
    rows = rows.withColumnsRenamed({"lead_h": "lead_hours", "source": "variable"}).select("variable", "acc", "mae", "lead_hours", "bias", "model", "init_time")
    sinks.save_by_init(rows.withColumn("bias", F.lit(0.0)).where("lead_hours > 12"), path)
    sinks.save_by_init(rows, path)
    found = readers.metric_tables(spark, path)
    out = rounded(found.select("model", "init_time", F.col("lead_hours").cast("long").alias("lead_hours"), "variable", "mae", (F.col("bias") + 1e-7).alias("bias"), "acc"))
    return out


@query("fx_track", sql="""SELECT model, CASE WHEN sid % 2 = 0 THEN 'era5' ELSE 'ifs' END AS source, lead_h AS lead, count(*) AS n, round(avg(pred_lat) + 1e-7, 4) AS mean_km FROM fx_track WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY ALL""")
def track_file_scan(spark, points):
    """[S24, P29] Raw track CSVs under source and model: rows that are not ok or lack an error are left out."""
    path = fresh_path(spark)
    error = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("pred_lat").cast("string"))
    rows = points.select(F.col("sid").alias("Storm_ID"), F.col("lead_h").alias("Lead_Time"), error.alias("Track_Error_km"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("OK").alias("Status"), F.when(F.col("sid") % 2 == 0, "era5").otherwise("ifs").alias("source"), "model")
    rows.write.partitionBy("source", "model").option("header", True).csv(path)
    table = T.error_table(readers.track_tables(spark, path), ["model", "source", "Lead_Time"], "Track_Error_km")
    return rounded(table.select("model", "source", F.col("Lead_Time").cast("long").alias("lead"), "n", (F.col("mean_km") + 1e-7).alias("mean_km")))


_POINTS = "pt AS (SELECT user_id AS sid, time_bucket(INTERVAL '3 hours', ts) AS t, min(value) AS lat, max(value) AS lon FROM events GROUP BY ALL)"


@query("events", sql=f"""WITH {_POINTS}, k AS (SELECT * FROM pt WHERE hour(t) % 6 = 0) SELECT 's' || sid AS sid, count(*) AS points, round(sum(lat), 3) AS lat, round(sum(((-lon) % 360 + 360) % 360), 3) AS lon,
count(CASE WHEN t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND sid % 10 = 3 THEN 1 END) AS looked_up FROM k GROUP BY sid""")
def best_track_scan(spark, events):
    """[S15, S16] A best-track CSV with a line of units, points off the synoptic times and blanks; and storms by name and time."""
    path = fresh_path(spark)
    points = events.groupBy(F.col("user_id").alias("sid"), F.window("ts", "3 hours").start.alias("t")).agg(F.min("value").alias("lat"), F.max("value").alias("lon"))
    columns = {
        "SID": F.concat(F.lit("s"), "sid"), "NAME": F.concat(F.lit(" STORM"), F.col("sid") % 10), "BASIN": F.lit(" "), "SUBBASIN": F.lit("MM"), "SEASON": F.lit("2024"), "ISO_TIME": F.date_format("t", "yyyy-MM-dd HH:mm:ss"),
        "LAT": F.col("lat").cast("string"), "LON": (-F.col("lon")).cast("string"), "WMO_PRES": F.lit(" "), "WMO_WIND": F.lit("35"),
    }
    rows = points.select(*(c.alias(n) for n, c in columns.items()))
    units = spark.range(1).select(*(F.lit("Year" if n == "SEASON" else "degrees" if n in ("LAT", "LON") else " ").alias(n) for n in columns))
    units.coalesce(1).unionByName(rows).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    tracks = readers.best_tracks(spark, path)
    named = readers.storm_lookup(tracks, 2024, "storm3", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("sid", "iso_time", F.lit(1).alias("hit"))
    both = tracks.join(named, ["sid", "iso_time"], "left")
    return rounded(both.groupBy("sid").agg(F.count(F.lit(1)).alias("points"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.count("hit").alias("looked_up")), 3)


@query("fx_grid", sql="""WITH m AS (SELECT * FROM (VALUES ('fengwu', 90e0, -0.25e0, 0.25e0), ('stormer', -89.296875e0, 1.40625e0, 1.40625e0)) v(model, top, dy, dx)),
t AS (SELECT model AS run, lat_i, lon_i, 't2m' AS variable, value FROM fx_grid UNION ALL SELECT model, lat_i, lon_i, 'tp', u FROM fx_grid)
SELECT m.model, run, lat_i, lon_i, variable, round(top + lat_i*dy, 6) AS lat, round(lon_i*dx, 6) AS lon, round(value + 1e-7, 4) AS value FROM t, m WHERE variable = 't2m'""")
def model_truth(spark, grid):
    """[X2, S2] Truth fields in the channels and at the grid points of two models; a variable that is no channel of theirs is left out."""
    field = lambda v, c: grid.select(F.col("model").alias("run"), F.lit(v).alias("variable"), F.lit(None).cast("int").alias("level_hpa"), "lat_i", "lon_i", F.col(c).alias("value"))
    found = models.truth_fields(field("t2m", "value").unionByName(field("tp", "u")), "fengwu", "stormer")
    return rounded(found.select("model", "run", "lat_i", "lon_i", "variable", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round(F.col("value") + 1e-7, 4).alias("value")), 6)


@query("fx_station_obs", sql="""SELECT station::VARCHAR AS station, round(any_value(lat), 4) AS lat, round(any_value(lon), 4) AS lon FROM fx_station_obs GROUP BY station""")
def station_catalog_scan(spark, obs):
    """[S19] A JSON object of all stations, one file as users have it, and its positions."""
    path = fresh_path(spark)
    place = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    entries = obs.groupBy("station").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("station").cast("string"), place))).alias("m"))
    entries.select(F.to_json("m").alias("value")).write.text(path)
    return rounded(readers.station_catalog(spark, path))


@query("fx_station_obs", sql="""WITH o AS (SELECT station, variable, time_bucket(INTERVAL '6 hours', ts) AS valid_time, avg(value) AS obs FROM fx_station_obs GROUP BY ALL), f AS (SELECT station, variable, valid_time + INTERVAL '6 hours' AS valid_time, obs AS pred FROM o)
SELECT station, count(*) AS n, round(avg(pred - obs) + 1e-7, 4) AS bias FROM f JOIN o USING (station, variable, valid_time) GROUP BY station""")
def observations_at_valid_time(spark, obs):
    """[S18] Six-hour means kept by date, against a persistence forecast of the slot before."""
    path = fresh_path(spark)
    slots = obs.groupBy("station", "variable", F.window("ts", "6 hours").start.alias("valid_time")).agg(F.avg("value").alias("obs"))
    slots.withColumn("date", F.to_date("valid_time")).write.partitionBy("date").parquet(path)
    kept = spark.read.parquet(path)
    pred = kept.select("station", "variable", (F.col("valid_time") + F.expr("INTERVAL 6 HOURS")).alias("valid_time"), F.col("obs").alias("pred"))
    return rounded(readers.observations_at(kept.drop("date"), pred).groupBy("station").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("pred") - F.col("obs")) + 1e-7).alias("bias")))


@query("lineitem", sql="""WITH f AS (SELECT DISTINCT l_returnflag AS model, date_trunc('month', l_shipdate)::TIMESTAMP + INTERVAL '12 hours' AS init_time, 6*l_linenumber AS lead_hours, CASE WHEN l_linestatus = 'O' THEN 7 END AS member FROM lineitem)
SELECT * FROM f QUALIFY dense_rank() OVER (PARTITION BY model ORDER BY init_time) <= 30""")
def forecast_file_catalog(spark, lineitem):
    """[S10, S11, T4] Files named by model, initialisation, lead and member, among others, and the first initialisations of each model."""
    path = fresh_path(spark)
    init = F.date_trunc("month", "l_shipdate") + F.expr("INTERVAL 12 HOURS")
    lead = F.format_string("%02d", 6 * F.col("l_linenumber"))
    name = F.concat("l_returnflag", F.lit("/"), F.date_format(init, "yyyyMMddHH"), F.lit("/"), F.date_format(init, "yyyy-MMdd"), F.lit("-"), lead, F.when(F.col("l_linestatus") == "O", "_7").otherwise(""), F.lit(".nc"))
    names = lineitem.select(name.alias("name")).distinct()
    other = names.select(F.concat(F.regexp_extract("name", "^.*/", 0), F.lit("notes.nc")).alias("name")).distinct()
    npy_source.touch(names.unionByName(other), path).write.format("noop").mode("overwrite").save()
    catalog = readers.forecast_catalog(spark, path).select("model", F.col("init_time").cast("timestamp_ntz").alias("init_time"), F.col("lead_hours").cast("long").alias("lead_hours"), "member")
    return readers.first_inits(catalog, ["model"], "init_time", 30)


@query("fx_grid", sql="""SELECT model, 6*(1 + lat_i % 4) AS lead_hours, 'z' AS variable, 'm2 s-2' AS unit, count(*) AS cells, round(sum(value), 2) AS total FROM fx_grid WHERE lat_i % 4 IN (1, 2) GROUP BY ALL""")
def forecast_store(spark, grid):
    """[K1, K2, S11] Forecasts saved by model, initialisation and lead, some leads and variables only, saved again in part, and read back."""
    path = fresh_path(spark)
    fields = grid.select("model", F.lit("2024010100").alias("init_time"), (6 * (1 + F.col("lat_i") % 4)).alias("lead_hours"), F.explode(F.array(F.lit("z"), F.lit("t"))).alias("variable"), F.lit(500).alias("level_hpa"), "lat_i", F.col("value"))
    units = spark.createDataFrame([("z", "m2 s-2"), ("t", "K")], "variable string, unit string")
    sinks.save_forecast(fields.withColumn("value", F.lit(0.0)).where("lead_hours = 12"), units, path)
    sinks.save_forecast(fields, units, path, leads=(12, 18), variables=["z"])
    found = spark.read.parquet(path)
    return rounded(found.groupBy("model", F.col("lead_hours").cast("long").alias("lead_hours"), "variable", "unit").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")), 2)


@query("fx_daily", sql="""SELECT day, count(*) AS cells, round(avg(tmax_truth) + 1e-7, 3) AS tmax FROM fx_daily WHERE day >= DATE '1994-03-01' AND day < DATE '1995-07-01' GROUP BY day""")
def dated_file_concat(spark, daily):
    """[S20, S21] A folder for each month; the files of a range of dates are put together along time, others are not read."""
    path = fresh_path(spark)
    daily.withColumnRenamed("day", "time").repartition(F.trunc("time", "month")).withColumn("begins", F.trunc("time", "month")).write.partitionBy("begins").parquet(path)
    found = readers.concat_dated(spark, path, "1994-03-01", "1995-06-30", pattern=r"begins=(\d{4}-\d{2}-\d{2})/[^/]*$")
    return rounded(found.groupBy(F.col("time").alias("day")).agg(F.count(F.lit(1)).alias("cells"), (F.avg("tmax_truth") + 1e-7).alias("tmax")), 3)


@query("orders", "lineitem", sql="""WITH i AS (SELECT DISTINCT o_orderpriority AS model, cast(o_orderdate AS date) AS init_time, o_custkey % 40 AS sid FROM orders), c AS (SELECT DISTINCT o_orderpriority AS model, cast(l_shipdate AS date) AS init_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT model, init_time, sid, CASE WHEN c.init_time IS NULL THEN 'missing_file' ELSE 'ok' END AS status FROM i LEFT JOIN c USING (model, init_time)""")
def forecast_existence(spark, orders, lineitem):
    """[J4, A44] Initialisations of storms with and without a forecast file of their model."""
    inits = orders.select(F.col("o_orderpriority").alias("model"), F.col("o_orderdate").cast("date").alias("init_time"), (F.col("o_custkey") % 40).alias("sid")).distinct()
    catalog = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("model"), F.col("l_shipdate").cast("date").alias("init_time"), F.lit(6).alias("lead_hours"))
    have, lost = T.with_forecast(inits, catalog)
    return have.select("*", F.lit("ok").alias("status")).unionByName(lost.select("model", "init_time", "sid", F.col("terminate_reason").alias("status")))


@query("fx_grid", sql="""WITH f AS (SELECT TIMESTAMP '2024-01-01' + split_part(model, '-', 2)::INT * INTERVAL '6 hours' AS valid_time, split_part(model, '-', 1) AS flag, lat_i, value::FLOAT AS value FROM fx_grid)
SELECT valid_time, flag AS variable, lat_i, count(*) AS cells, round(sum(value), 1) AS total FROM f WHERE valid_time >= TIMESTAMP '2024-01-01 00:00:00' AND valid_time < TIMESTAMP '2024-01-02 12:00:00' AND flag IN ('A', 'R') AND lat_i BETWEEN 3 AND 17 GROUP BY ALL""")
def npy_tree_scan(spark, grid):
    """[S1, S4, S2] Fields as a tree of NPY files, read by filters on time, variable, level and row that reach the source."""
    path = fresh_path(spark)
    start = F.lit("2024-01-01").cast("timestamp")
    step, flag = F.split_part("model", F.lit("-"), F.lit(2)).cast("int"), F.split_part("model", F.lit("-"), F.lit(1))
    cells = grid.select((start + F.make_dt_interval(hours=6 * step)).alias("valid_time"), flag.alias("variable"), F.explode(F.array(F.lit(500), F.lit(850))).alias("level_hpa"), "lat_i", "lon_i", F.col("value"))
    npy_source.save_npy(cells, path).write.format("noop").mode("overwrite").save()
    fields = npy_source.npy_table(spark, path, "analysis")
    at = lambda x: F.lit(x).cast("timestamp")
    wanted = (F.col("valid_time") >= at("2024-01-01 00:00:00")) & (F.col("valid_time") < at("2024-01-02 12:00:00")) & F.col("variable").isin("A", "R") & (F.col("level_hpa") == 850) & F.col("lat_i").between(3, 17)
    values = fields.where(wanted).select("valid_time", "variable", "lat_i", F.explode("vals").alias("value"))
    out = values.groupBy(F.col("valid_time").cast("timestamp_ntz").alias("valid_time"), "variable", "lat_i").agg(F.count("value").alias("cells"), F.sum(F.col("value").cast("double")).alias("total"))
    return rounded(out, 1)


@query("fx_grid", sql="""SELECT model, lat_i, lon_i, round(value - truth + 1e-7, 3) AS thickness, round((u + v)/2 + 1e-7, 4) AS mean FROM fx_grid WHERE 80.5::DOUBLE - 7*lat_i BETWEEN -20 AND 45 AND (1e1*lon_i >= 300 OR 1e1*lon_i <= 40)""")
def layer_fields(spark, grid):
    """[F10, P22] Thickness of a layer and mean of two levels, in a region across the zero meridian."""
    level = lambda v, lev, c: grid.select("model", "lat_i", "lon_i", F.lit(v).alias("variable"), F.lit(lev).alias("level_hpa"), F.col(c).alias("value"))
    fields = level("z", 200, "value").unionByName(level("z", 850, "truth")).unionByName(level("t", 300, "u")).unionByName(level("t", 500, "v"))
    fields = fields.where(S.in_box(80.5 - 7.0 * F.col("lat_i"), 10.0 * F.col("lon_i"), -20.0, 45.0, 300.0, 40.0))
    cell = ["model", "lat_i", "lon_i"]
    both = D.layer_thickness(fields, cell).join(D.layer_mean(fields, cell, (300, 500)), cell)
    return both.select(*cell, (F.round(F.col("thickness") + 1e-7, 3) + 0.0).alias("thickness"), (F.round(F.col("mean") + 1e-7, 4) + 0.0).alias("mean"))


@query("part", sql="""WITH c AS (SELECT lower(replace(p_brand, '#', '_')) AS k, min(p_partkey) AS ord FROM part GROUP BY 1), h AS (SELECT lower(replace(p_brand, '#', '_')) AS k, arg_min(p_brand, p_partkey) AS channel FROM part GROUP BY 1)
SELECT channel, ord FROM c JOIN h USING (k)""")
def channels_in_order(spark, part):
    """[P2] Wanted channels, spelt in another way and repeated, in the order of their first mention."""
    have = part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"))
    wanted = part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("name"), F.col("p_partkey").alias("ord"))
    return C.channel_subset(have, wanted, F.lower(F.replace("name", F.lit("#"), F.lit("_"))))


@query("fx_track", sql="""WITH r AS (SELECT model, lead_h, count(*) AS n, round(avg(pred_lat), 4) AS mean FROM fx_track GROUP BY ALL) SELECT 'by_lead' AS "table", model, lead_h, n FROM r UNION ALL SELECT 'raw', model, 0, sum(n)::BIGINT FROM r GROUP BY model""")
def track_bundle(spark, points):
    """[K5] Raw points and a table by lead, written together from one reading, and read back."""
    path = fresh_path(spark)
    sinks.save_bundle(points.select("sid", "model", "lead_h", "pred_lat"), {"by_lead": lambda x: x.groupBy("model", "lead_h").agg(F.count(F.lit(1)).alias("n"))}, path)
    table = spark.read.option("header", True).schema("model string, lead_h int, n long").csv(f"{path}/by_lead")
    raw = spark.read.parquet(f"{path}/raw").groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return table.select(F.lit("by_lead").alias("table"), "model", F.col("lead_h").cast("long").alias("lead_h"), "n").unionByName(raw.select(F.lit("raw").alias("table"), "model", F.lit(0).cast("long").alias("lead_h"), "n"))


@query("fx_daily", sql="""WITH q AS (SELECT cell_id, unnest([10e0, 50e0, 90e0]) AS p, unnest([quantile_cont(tmax_truth, 0.1), quantile_cont(tmax_truth, 0.5), quantile_cont(tmax_truth, 0.9)]) AS v FROM fx_daily WHERE dayofyear(day) = 60 GROUP BY cell_id)
SELECT cell_id, p, CASE WHEN p >= 50 THEN 'heat' ELSE 'cold' END AS tail, round(v + 1e-7, 2) AS value FROM q""")
def baseline_store(spark, daily):
    """[K6, A28] Percentiles of a day of year in long form, kept by tail, and read back."""
    path = fresh_path(spark)
    wide = E.doy_percentile(daily, ["cell_id"], "tmax_truth", [10, 50, 90], window=1).where("doy = 60")
    long = wide.unpivot(["cell_id"], ["p10", "p50", "p90"], "name", "value").select("cell_id", F.substring("name", 2, 2).cast("double").alias("p"), "value")
    sinks.save_baseline(long, path)
    return spark.read.parquet(path).select("cell_id", "p", "tail", (F.round(F.col("value") + 1e-7, 2) + 0.0).alias("value"))


@query("fx_grid", sql="""SELECT model, count(*) AS cells, count(*) FILTER (value > 30000) AS hot, (SELECT count(*) FROM fx_grid) AS rows_written FROM fx_grid GROUP BY model""")
def mask_store(spark, grid):
    """[K7, K8] Masks of cells kept by tiles, with a JSON row of their parameters and number, and read back."""
    path = fresh_path(spark)
    masks = grid.select("model", "lat_i", "lon_i", (F.col("value") > 30_000).alias("mask"))
    sinks.save_cells(masks, f"{path}/cells")
    sinks.save_metadata(masks, f"{path}/data", f"{path}/meta", {"threshold": 30_000})
    meta = spark.read.schema("parameters string, rows long").json(f"{path}/meta").where(F.get_json_object("parameters", "$.threshold") == "30000")
    found = spark.read.parquet(f"{path}/cells").groupBy("model").agg(F.count(F.lit(1)).alias("cells"), F.count_if("mask").alias("hot"))
    return found.crossJoin(F.broadcast(meta.select(F.col("rows").alias("rows_written"))))  # one row


@query("lineitem", sql="""WITH k AS (SELECT l_returnflag AS model, l_linenumber AS lead, count(*) AS n FROM lineitem GROUP BY ALL) SELECT model, lead, n, CASE WHEN lead <= 3 AND model <> 'A' THEN 'first' ELSE 'second' END AS run FROM k""")
def cached_results(spark, lineitem):
    """[K9] Results under a configuration: a second run makes only what is missing or to be refreshed."""
    path = fresh_path(spark)
    counts = lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    make = lambda run: lambda todo: todo.join(counts, ["model", "lead"]).withColumn("run", F.lit(run))
    wanted = counts.select("model", "lead")
    sinks.cached(spark, path, {"grid": 1}, wanted.where("lead <= 3"), ["model", "lead"], make("first"))
    return sinks.cached(spark, path, {"grid": 1}, wanted, ["model", "lead"], make("second"), refresh=["A"])
