"""Queries of grid verification."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veriskill.functions import scalars as S
from veriskill.operators import grid as G
from veriskill.operators import spectra
from veriskill.plans.register import query, rounded

_W = "wt AS (SELECT cell_id, c / (avg(c) OVER ()) AS w FROM (SELECT DISTINCT cell_id, greatest(cos(lat*(pi()/180)), 0) AS c FROM fx_cell_day)),\nx AS (SELECT * FROM fx_cell_day JOIN wt USING (cell_id))"
THRESHOLDS = (20_000.0, 35_000.0, 50_000.0, 70_000.0)


def weighted(cells, variant="exact"):
    """Cells with the weight of their latitude; the views have one cell at each."""
    w = G.lat_weights(cells.select("lat").distinct(), variant=variant).select("lat", "w")
    return cells.join(w, "lat")  # a row for each latitude: Spark sees its size


@query("fx_cell_day", sql=f"""WITH {_W},
m AS (SELECT model, source, lead_h, avg(w*(pred-clim)) AS m FROM x GROUP BY ALL)
SELECT model, source, lead_h, round(sqrt(avg(w*(pred-truth)*(pred-truth))), 4) AS wrmse, round(avg(w*(pred-truth)), 4) AS bias, round(avg(abs(pred-truth)), 4) AS mae,
  round(sqrt(avg(w*(pred-clim-m)*(pred-clim-m))), 4) AS activity, round(sum(w*(pred-clim)*(truth-clim)) / sqrt(sum(w*(pred-clim)*(pred-clim))*sum(w*(truth-clim)*(truth-clim))), 4) AS acc
FROM x JOIN m USING (model, source, lead_h) GROUP BY model, source, lead_h""")  # fmt: skip
def grid_metrics(spark, cells):
    """[A1, A2, A4, A5, A7, A8, A11]"""
    return rounded(G.scores(weighted(cells), ["model", "source", "lead_h"]))


@query("fx_cell_day", sql="""WITH a AS (SELECT DISTINCT cell_id, lat, cos(lat*(pi()/180)) AS c, cos(lat*(3.1416/180)) AS d FROM fx_cell_day)
SELECT cell_id, lat, round(c / (avg(c) OVER ()), 4) AS w, round(d / (avg(d) OVER ()), 4) AS w_approx, round(c, 4) AS w_cos FROM a""")
def lat_weight_variants(spark, cells):
    """[A1]"""
    lats = cells.select("cell_id", "lat").distinct()
    out = G.lat_weights(G.lat_weights(lats).join(G.lat_weights(lats, variant="approx_pi").select("cell_id", F.col("w").alias("w_approx")), "cell_id").withColumnRenamed("w", "_w"), variant="cos")
    return rounded(out.select("cell_id", "lat", F.col("_w").alias("w"), "w_approx", F.col("w").alias("w_cos")))


@query("fx_cell_day", sql=f"""WITH {_W} SELECT model, lead_h, round(sqrt(sum(w*(pred-truth)*(pred-truth))/sum(w)), 4) AS cos_rmse, round(sum(w*abs(pred-truth))/sum(w), 4) AS wmae, round(sum(w*(pred-truth))/sum(w), 4) AS wbias, round(sqrt(avg((pred-truth)*(pred-truth))), 4) AS rmse FROM x GROUP BY ALL""")
def grid_weighted_errors(spark, cells):
    """[A6, A12, X1]"""
    return rounded(G.scores(weighted(cells), ["model", "lead_h"], ["cos_rmse", "wmae", "wbias", "rmse"]))


@query("fx_cell_day", sql=f"""WITH {_W}, m AS (SELECT model, lead_h, avg(pred-clim) AS mf, avg(truth-clim) AS mo FROM x GROUP BY ALL)
SELECT model, lead_h, round(sum(w*(pred-clim-mf)*(truth-clim-mo)) / sqrt(sum(w*(pred-clim-mf)*(pred-clim-mf))*sum(w*(truth-clim-mo)*(truth-clim-mo))), 4) AS acc_centred FROM x JOIN m USING (model, lead_h) GROUP BY model, lead_h""")
def grid_acc_centred(spark, cells):
    """[A9]"""
    return rounded(G.centred_acc(weighted(cells), ["model", "lead_h"]))


@query("fx_cell_day", sql="""WITH b AS (SELECT DISTINCT cell_id, cos(lat*(pi()/180)) AS c, CASE WHEN lat BETWEEN -30 AND 30 THEN 'tropics' WHEN lat > 30 THEN 'north' ELSE 'south' END AS band FROM fx_cell_day),
w AS (SELECT cell_id, band, c/(avg(c) OVER (PARTITION BY band)) AS w FROM b), x AS (SELECT * FROM fx_cell_day JOIN w USING (cell_id)),
m AS (SELECT model, band, avg(w*(pred-clim)) AS m FROM x GROUP BY ALL)
SELECT model, band, round(avg(w*(pred-truth)), 4) AS bias, round(sqrt(avg(w*(pred-clim-m)*(pred-clim-m))), 4) AS activity FROM x JOIN m USING (model, band) GROUP BY model, band""")
def grid_bias_band(spark, cells):
    """[A10, P23]"""
    lats = cells.select("cell_id", "lat").distinct().withColumn("band", S.band(F.col("lat")))
    w = G.lat_weights(lats, keys=["band"]).select("cell_id", "band", "w")
    return rounded(G.scores(cells.join(F.broadcast(w), "cell_id"), ["model", "band"], ["bias", "activity"]))


@query("fx_cell_day", sql="""SELECT grouping_id(model, lead_h, cell_id) AS grouping, model, lead_h, cell_id, round(avg((pred-truth)*(pred-truth)), 2) AS mse FROM fx_cell_day GROUP BY GROUPING SETS ((model), (model, lead_h), (cell_id))""")
def mse_groupings(spark, cells):
    """[A13]"""
    out = G.error_groupings(cells, [["model"], ["model", "lead_h"], ["cell_id"]])
    return rounded(out.withColumn("grouping", F.col("grouping").cast("long")), 2)


@query("fx_cell_day", sql=f"""WITH t AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in THRESHOLDS)}]) AS threshold),
n AS (SELECT model, threshold, count(*) FILTER (pred >= threshold AND truth >= threshold) AS hits, count(*) FILTER (pred < threshold AND truth >= threshold) AS misses, count(*) FILTER (pred >= threshold AND truth < threshold) AS false_alarms, count(*) FILTER (pred < threshold AND truth < threshold) AS correct_negatives FROM fx_cell_day, t GROUP BY ALL),
r AS (SELECT *, hits/(hits+misses) AS h, false_alarms/(false_alarms+correct_negatives) AS f FROM n)
SELECT model, threshold, hits, misses, false_alarms, correct_negatives, round(hits/(hits+misses+false_alarms+1e-10), 4) AS csi,
  CASE WHEN h > 0 AND h < 1 AND f > 0 AND f < 1 THEN round((ln(f)-ln(h)-ln(1-f)+ln(1-h))/(ln(f)+ln(h)+ln(1-f)+ln(1-h)), 4) END AS sedi FROM r""")
def csi_thresholds(spark, cells):
    """[A14, A15, A16]"""
    return rounded(G.threshold_scores(cells, ["model"], THRESHOLDS))


@query("fx_cell_day", sql="""WITH t AS (SELECT unnest([0.0::DOUBLE, 1000.0, 2500.0]) AS threshold) SELECT model, lead_h, threshold, round(avg(CASE WHEN pred-truth > threshold THEN 1.0::DOUBLE ELSE 0 END), 4) AS poep FROM fx_cell_day, t GROUP BY ALL""")
def poep(spark, cells):
    """[A17]"""
    return rounded(G.exceedance_share(cells, ["model", "lead_h"], [0.0, 1000.0, 2500.0]))


@query("fx_cell_day", sql=f"""WITH {_W} SELECT model, lead_h, round(avg(w*w*(0.5*(pred/1e3*pred/1e3 + truth/1e3*truth/1e3) + 1004e0/54e1*clim/1e3*clim/1e3)), 4) AS energy FROM x GROUP BY ALL""")
def grid_energy(spark, cells):
    """[A18]"""
    x = weighted(cells).select("model", "lead_h", "w", (F.col("pred") / 1e3).alias("u"), (F.col("truth") / 1e3).alias("v"), (F.col("clim") / 1e3).alias("t"))
    return rounded(G.energy(x, ["model", "lead_h"]))


_MW = "lats AS (SELECT DISTINCT lat, cos(lat*(pi()/180)) AS c FROM fx_members), wt AS (SELECT lat, c/(avg(c) OVER ()) AS w FROM lats), m AS (SELECT * FROM fx_members JOIN wt USING (lat))"


@query("fx_members", sql=f"""WITH {_MW},
pairs AS (SELECT a.model, a.cell, sum(abs(a.pred-b.pred)) AS s FROM m a JOIN m b ON a.cell = b.cell AND a.model = b.model GROUP BY ALL),
c AS (SELECT model, cell, any_value(w) AS w, any_value(truth) AS truth, avg(pred) AS mean, var_samp(pred) AS var, avg(abs(pred-truth)) AS err, count(*) AS n FROM m GROUP BY ALL)
SELECT model, round(avg(w*(err - coalesce(s/nullif(2*n*(n-1), 0), 0))), 4) AS crps, round(sqrt(avg(w*var)), 4) AS spread, round(sqrt(avg(w*var))/sqrt(avg(w*(mean-truth)*(mean-truth))), 4) AS spread_skill FROM c JOIN pairs USING (model, cell) GROUP BY model""")
def ensemble_crps_spread(spark, members):
    """[A19, A20, J26]"""
    w = G.lat_weights(members.select("lat").distinct())
    return rounded(G.ensemble_scores(members.join(F.broadcast(w), "lat"), ["model"], ["cell"]))


@query("fx_cell_day", sql=f"""WITH {_W}, e AS (SELECT source, model, avg(w*(pred-truth)*(pred-truth)) AS mse FROM x GROUP BY ALL), v AS (SELECT * FROM (VALUES ('A', 2.0::DOUBLE), ('N', 1.0), ('R', 0.5)) AS t(model, weight))
SELECT source, model, round(mse, 2) AS mse FROM e UNION ALL SELECT source, NULL, round(sum(mse*weight)/sum(weight), 2) FROM e JOIN v USING (model) GROUP BY source""")
def weighted_mse(spark, cells):
    """[A21]"""
    v = spark.sql("SELECT * FROM VALUES ('A', 2e0), ('N', 1e0), ('R', 5e-1) AS t(model, weight)")
    return rounded(G.weighted_mse(weighted(cells), "model", v, ["source"]), 2)


@query("fx_cell_day", sql=f"""WITH {_W}, s AS (SELECT model, lead_h, day, sqrt(avg(w*(pred-truth)*(pred-truth))) AS r FROM x GROUP BY ALL) SELECT model, lead_h, round(avg(r), 4) AS rmse FROM s GROUP BY ALL""")
def mean_sample_rmse(spark, cells):
    """[A22]"""
    return rounded(G.mean_sample_rmse(weighted(cells), ["model", "lead_h"], ["day"]))


@query("fx_cell_day", sql="""WITH i AS (SELECT unnest([6, 12, 18]) AS interval_h), f AS (SELECT cell_id, source, lead_h, interval_h, avg(pred) + interval_h AS pred FROM fx_cell_day, i GROUP BY cell_id, source, lead_h, interval_h)
SELECT cell_id, source, lead_h, round(avg(pred), 4) AS pred, count(*) AS n FROM f WHERE lead_h % interval_h = 0 GROUP BY cell_id, source, lead_h""")
def interval_mean(spark, cells):
    """[A23]"""
    f = cells.withColumn("interval_h", F.explode(F.array(F.lit(6), F.lit(12), F.lit(18)))).groupBy("cell_id", "source", "lead_h", "interval_h").agg((F.avg("pred") + F.first("interval_h")).alias("pred"))
    return rounded(G.interval_mean(f, ["cell_id", "source"]))


@query("fx_cell_day", sql="""WITH t AS (SELECT cell_id, day, avg(truth) AS obs FROM fx_cell_day WHERE source = 'F' GROUP BY ALL), c AS (SELECT cell_id, strftime(day, '%m-%d') AS mmdd, avg(clim) AS normal FROM fx_cell_day WHERE source = 'O' GROUP BY ALL)
SELECT model, count(*) AS n, count(normal) AS n_clim, round(avg(pred - obs), 4) AS bias, round(avg(pred - normal), 4) AS anomaly FROM fx_cell_day JOIN t USING (cell_id, day) LEFT JOIN c ON fx_cell_day.cell_id = c.cell_id AND strftime(day, '%m-%d') = c.mmdd GROUP BY model""")
def truth_and_climatology(spark, cells):
    """[J1, J2, S22]"""
    truth = cells.where("source = 'F'").groupBy("cell_id", "day").agg(F.avg("truth").alias("obs"))
    clim = cells.where("source = 'O'").groupBy("cell_id", F.date_format("day", "MM-dd").alias("mmdd")).agg(F.avg("clim").alias("normal"))
    x = G.join_climatology(G.join_truth(cells.drop("clim"), truth, ["cell_id", "day"]), clim, "day", ["cell_id"])
    return rounded(x.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("normal").alias("n_clim"), F.avg(F.col("pred") - F.col("obs")).alias("bias"), F.avg(F.col("pred") - F.col("normal")).alias("anomaly")))


@query("fx_rows", sql="""WITH v AS (SELECT field_id, lat, generate_subscripts(vals, 1) - 1 AS j, unnest(vals)::DOUBLE AS x, len(vals) AS n FROM fx_rows),
k AS (SELECT unnest(generate_series(0, 32)) AS k), s AS (SELECT field_id, lat, k, sum(x*cos(2*pi()*k*j/n))/any_value(n) AS re, sum(x*sin(2*pi()*k*j/n))/any_value(n) AS im FROM v, k GROUP BY ALL)
SELECT field_id, k, round(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re*re+im*im) * 2*pi()*6371000*cos(radians(lat)), 1) AS power FROM s""")
def zonal_spectrum(spark, rows):
    """[F8]"""
    found = spectra.zonal_spectrum(rows, ["field_id"])
    return rounded(found.select("field_id", F.posexplode("power").alias("k", "power")).withColumn("k", F.col("k").cast("long")), 1)


@query("fx_rows", sql="""WITH v AS (SELECT field_id, lat_i, lat, generate_subscripts(vals, 1) - 1 AS j, unnest(vals)::DOUBLE AS x, len(vals) AS n FROM fx_rows),
k AS (SELECT unnest(generate_series(0, 32)) AS k), s AS (SELECT field_id, lat_i, lat, k, sum(x*cos(2*pi()*k*j/n))/any_value(n) AS re, sum(x*sin(2*pi()*k*j/n))/any_value(n) AS im FROM v, k GROUP BY ALL),
p AS (SELECT field_id % 5 AS init, lat, k, CASE WHEN k = 0 THEN 1 ELSE 2 END * (re*re+im*im) * 2*pi()*6371000*cos(radians(lat)) AS power FROM s)
SELECT init, k, round(sum(cos(radians(lat))*power)/sum(cos(radians(lat))), 0) AS power FROM p GROUP BY ALL""")
def spectrum_mean(spark, rows):
    """[F9, A46]"""
    found = spectra.zonal_spectrum(rows.withColumn("init", F.col("field_id") % 5), ["init"])
    return rounded(spectra.mean_spectrum(found, ["init"], weighted=True).withColumn("k", F.col("k").cast("long")), 0)


_SLOPE = "CASE WHEN {b} IS NULL AND {a} IS NULL THEN NULL ELSE (coalesce({a}, {x}) - coalesce({b}, {x})) / ((CASE WHEN {b} IS NULL THEN 0 ELSE 1 END + CASE WHEN {a} IS NULL THEN 0 ELSE 1 END) * 25e3) END"


@query("fx_grid", sql=f"""WITH n AS (SELECT *, lag(v) OVER r AS vb, lead(v) OVER r AS va, lag(u) OVER c AS ub, lead(u) OVER c AS ua FROM fx_grid WINDOW r AS (PARTITION BY model, lat_i ORDER BY lon_i), c AS (PARTITION BY model, lon_i ORDER BY lat_i))
SELECT model, lat_i, lon_i, round(1e6 * CASE WHEN lat_i >= 12 THEN -1 ELSE 1 END * ({_SLOPE.format(a="va", b="vb", x="v")} + {_SLOPE.format(a="ua", b="ub", x="u")}), 4) AS vorticity FROM n""")
def vorticity(spark, grid):
    """[W4]"""
    out = G.vorticity(grid, ["model"], rows=24)
    return rounded(out.select("model", "lat_i", "lon_i", (1e6 * F.col("vorticity")).alias("vorticity")))


@query("fx_grid", sql="""WITH k AS (SELECT *, max(value) OVER () AS top FROM fx_grid)
SELECT a.model, a.lat_i, a.lon_i, round(a.value, 4) AS value FROM fx_grid a WHERE a.value > 35000 AND a.lat_i BETWEEN 2 AND 21 AND a.lon_i BETWEEN 2 AND 33 AND NOT EXISTS (SELECT 1 FROM fx_grid b WHERE b.model = a.model AND abs(b.lat_i-a.lat_i) <= 2 AND abs(b.lon_i-a.lon_i) <= 2
  AND (b.value > a.value OR (b.value = a.value AND (b.lat_i < a.lat_i OR (b.lat_i = a.lat_i AND b.lon_i < a.lon_i)))))""")
def local_extrema(spark, grid):
    """[W5]"""
    out = G.local_extrema(grid, ["model"], 2, 35_000.0, border=2, rows=24, width=36)
    return rounded(out.select("model", "lat_i", "lon_i", "value"))


def _axes(spark):
    s_lat, s_lon = G.axis(spark, 24, -80.5, 7.0, "lat"), G.axis(spark, 36, 0.0, 10.0, "lon")
    t_lat, t_lon = G.axis(spark, 19, 90.0, -10.0, "lat"), G.axis(spark, 48, 0.0, 7.5, "lon")
    return G.linear_weights(s_lat, t_lat, "lat"), G.linear_weights(s_lon, t_lon, "lon", period=360.0)


@query("fx_grid", sql="""WITH ty AS (SELECT i, least(greatest((90 - 10*i + 80.5::DOUBLE)/7, 0), 23) AS y FROM range(19) r(i)), wy AS (SELECT i, least(floor(y), 22)::INT AS s, y - least(floor(y), 22) AS f FROM ty),
yy AS (SELECT i, s AS lat_i, 1-f AS w FROM wy UNION ALL SELECT i, s+1, f FROM wy), tx AS (SELECT j, j*0.75::DOUBLE AS x FROM range(48) r(j)), wx AS (SELECT j, floor(x)::INT % 36 AS s, x - floor(x) AS f FROM tx),
xx AS (SELECT j, s AS lon_i, 1-f AS w FROM wx UNION ALL SELECT j, (s+1) % 36, f FROM wx)
SELECT model, i::INT AS lat_i, j::INT AS lon_i, round(sum(yy.w*xx.w*value) + 1e-7, 4) AS value FROM fx_grid JOIN yy USING (lat_i) JOIN xx USING (lon_i) WHERE yy.w <> 0 AND xx.w <> 0 GROUP BY ALL""")
def regrid_bilinear(spark, grid):
    """[J9]"""
    return rounded(G.regrid_linear(grid, *_axes(spark), ["model"]), offset=1e-7)


@query("fx_grid", sql="""WITH sy AS (SELECT i, sin(radians(-90+7.5*i)) AS lo, sin(radians(-82.5+7.5*i)) AS hi FROM range(24) r(i)), ty AS (SELECT i, sin(radians(-90+20*i)) AS lo, sin(radians(-70+20*i)) AS hi FROM range(9) r(i)),
wy AS (SELECT ty.i, sy.i AS lat_i, least(sy.hi, ty.hi)-greatest(sy.lo, ty.lo) AS w FROM sy JOIN ty ON sy.lo < ty.hi AND ty.lo < sy.hi),
sx AS (SELECT i, 10*i - 5 + d AS lo, 10*i + 5 + d AS hi FROM range(36) r(i), (VALUES (-360), (0), (360)) v(d)), tx AS (SELECT i, 24*i - 12 AS lo, 24*i + 12 AS hi FROM range(15) r(i)),
wx AS (SELECT tx.i AS j, sx.i AS lon_i, sum(least(sx.hi, tx.hi)-greatest(sx.lo, tx.lo)) AS w FROM sx JOIN tx ON sx.lo < tx.hi AND tx.lo < sx.hi GROUP BY ALL)
SELECT model, wy.i::INT AS lat_i, j::INT AS lon_i, round(sum(wy.w*wx.w*value)/sum(wy.w*wx.w), 4) AS value FROM fx_grid JOIN wy USING (lat_i) JOIN wx USING (lon_i) GROUP BY ALL""")
def regrid_conservative(spark, grid):
    """[J11]"""
    def cells(n, lo, step, sine=False):
        f = (lambda c: F.sin(F.radians(c))) if sine else (lambda c: c)
        return spark.range(n).select(F.col("id").cast("int").alias("i"), f(lo + step * F.col("id")).alias("lo"), f(lo + step * (F.col("id") + 1)).alias("hi"))

    lat = G.overlap_weights(cells(24, -90.0, 7.5, True), cells(9, -90.0, 20.0, True))
    lon = G.overlap_weights(cells(36, -5.0, 10.0), cells(15, -12.0, 24.0), period=360.0)
    return rounded(G.regrid_conservative(grid, lat, lon, ["model"]))


@query("fx_grid", sql="""SELECT model, round(sqrt(avg(pow(value - truth, 2)))*2, 4) AS nrmse FROM fx_grid WHERE lat_i BETWEEN 3 AND 20 AND lon_i BETWEEN 3 AND 32 GROUP BY model""")
def nrmse_border(spark, grid):
    """[A12]"""
    return rounded(G.nrmse(grid.withColumn("std", F.lit(2.0)), ["model"], 24, 36, border=3, pred="value", std="std"))


@query("fx_cell_day", sql=f"""WITH {_W} SELECT model, lead_h, round(sqrt(avg(w*(pred-truth)*(pred-truth)))/9.80665, 4) AS wrmse_height FROM x GROUP BY ALL""")
def geopotential_error(spark, cells):
    """[A3]"""
    return rounded(G.scores(weighted(cells), ["model", "lead_h"], ["wrmse_height"]))


@query("fx_grid", sql="""WITH v AS (SELECT model, lat_i, lon_i, radians(80.5::DOUBLE - 7*lat_i) AS y, CASE WHEN value > 30000 THEN value END AS v FROM fx_grid), s AS (SELECT * FROM v WHERE v IS NOT NULL),
n AS (SELECT t.model, t.lat_i, t.lon_i, arg_min(s.v, (round(pow(sin((t.y - s.y)/2), 2) + cos(t.y)*cos(s.y)*pow(sin(radians(abs(t.lon_i - s.lon_i)*1e1)/2), 2), 12), s.lat_i, least(abs(t.lon_i - s.lon_i), 36 - abs(t.lon_i - s.lon_i)), s.lon_i)) AS v FROM v t JOIN s USING (model) WHERE t.v IS NULL GROUP BY ALL)
SELECT v.model, v.lat_i, v.lon_i, round(coalesce(v.v, n.v) + 1e-7, 4) AS value FROM v LEFT JOIN n USING (model, lat_i, lon_i)""")
def nearest_fill(spark, grid):
    """[J25] Cells of low value count as missing and take the nearest valid one's, by distance on the sphere."""
    gaps = grid.select("model", "lat_i", "lon_i", (80.5 - 7.0 * F.col("lat_i")).alias("lat"), F.when(F.col("value") > 30_000, F.col("value")).alias("value"))
    return rounded(G.filled_with_nearest(gaps, ["model"], width=36).drop("lat"), offset=1e-7)


_GAUSS = "[" + ", ".join(f"{math.exp(-0.5 * k * k)!r}" for k in range(-4, 5)) + "]"


@query("fx_grid", sql=f"""WITH a AS (SELECT x.model, x.lat_i, x.lon_i, sum(({_GAUSS})[y.lon_i - x.lon_i + 5]::DOUBLE*y.value)/sum(({_GAUSS})[y.lon_i - x.lon_i + 5]::DOUBLE) AS v FROM fx_grid x JOIN fx_grid y ON x.model = y.model AND x.lat_i = y.lat_i AND abs(x.lon_i - y.lon_i) <= 4 GROUP BY ALL)
SELECT x.model, x.lat_i, x.lon_i, round(sum(({_GAUSS})[y.lat_i - x.lat_i + 5]::DOUBLE*y.v)/sum(({_GAUSS})[y.lat_i - x.lat_i + 5]::DOUBLE), 3) AS value FROM a x JOIN a y ON x.model = y.model AND x.lon_i = y.lon_i AND abs(x.lat_i - y.lat_i) <= 4 GROUP BY ALL""")
def smoothed_grid(spark, grid):
    """[F11]"""
    return rounded(G.smooth(grid.select("model", "lat_i", "lon_i", "value"), ["model"]), 3)


@query("fx_grid", sql="""WITH ty AS (SELECT i, (90 - 10*i + 80.5::DOUBLE)/7 AS y FROM range(19) r(i)), wy AS (SELECT i, least(greatest(floor(y), 0), 22)::INT AS s, y - least(greatest(floor(y), 0), 22) AS f FROM ty),
yy AS (SELECT i, s AS lat_i, 1-f AS w FROM wy UNION ALL SELECT i, s+1, f FROM wy), xx AS (SELECT j, j*35/50e0 AS x FROM range(51) r(j)), wx AS (SELECT j, least(floor(x), 34)::INT AS s, x - least(floor(x), 34) AS f FROM xx),
zz AS (SELECT j, s AS lon_i, 1-f AS w FROM wx UNION ALL SELECT j, s+1, f FROM wx)
SELECT model, i::INT AS lat_i, j::INT AS lon_i, round(sum(yy.w*zz.w*value) + 1e-7, 3) AS value FROM fx_grid JOIN yy USING (lat_i) JOIN zz USING (lon_i) WHERE abs(yy.w) > 1e-12 AND abs(zz.w) > 1e-12 GROUP BY ALL""")
def regrid_zoom(spark, grid):
    """[J10, J12] Latitudes go on beyond the source's edges; longitudes are zoomed from end to end."""
    lat = G.linear_weights(G.axis(spark, 24, -80.5, 7.0, "lat"), G.axis(spark, 19, 90.0, -10.0, "lat"), "lat", extrapolate=True)
    lon = G.linear_weights(G.axis(spark, 36, 0.0, 1.0, "lon"), G.axis(spark, 51, 0.0, 0.7, "lon"), "lon")
    small = lambda w: w.where(F.abs("w") > 1e-12)
    return rounded(G.regrid_linear(grid, small(lat), small(lon), ["model"]), 3, offset=1e-7)
