"""Queries of objects on grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriskill.operators import objects as O
from veriskill.plans.register import query, rounded


#: Labels by reachability over pairs of neighbouring cells: small objects only, as on a sparse mask.
REACH = """r AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON r.g = e.g AND r.b = e.a), lb AS (SELECT g, a AS node, min(b) AS label FROM r GROUP BY ALL)"""
_FLAT = f"""c AS (SELECT *, printf('%05d-%05d', lat_i, lon_i) AS node FROM fx_mask),
e AS (SELECT a.day AS g, a.node AS a, b.node AS b FROM c a, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(i, j), c b WHERE b.day = a.day AND b.lat_i = a.lat_i + o.i AND b.lon_i = a.lon_i + o.j), {REACH},
l AS (SELECT c.*, label FROM c JOIN lb ON g = day AND lb.node = c.node)"""


@query("fx_mask", sql=f"""WITH {_FLAT}
SELECT day, label, count(*) AS cells, min(lat_i) AS lat_min, max(lat_i) AS lat_max, min(lon_i) AS lon_min, max(lon_i) AS lon_max, round(avg(lat_i), 4) AS lat_mean, round(avg(lon_i), 4) AS lon_mean, count(*)::DOUBLE AS severity FROM l GROUP BY ALL""")
def components_2d(spark, mask):
    """[O1, O3, A30] 4-connected objects of each month."""
    out = O.label(mask, ["day"], diagonal=False)
    return rounded(O.object_stats(out, ["day"], F.col("lat_i").cast("double"), F.lit(1.0)).select("day", "label", "cells", "lat_min", "lat_max", "lon_min", "lon_max", "lat_mean", "lon_mean", "severity"))


@query("fx_mask", sql=f"""WITH {_FLAT}, n AS (SELECT day, label, count(*) AS cells FROM l GROUP BY ALL) SELECT day, label, cells FROM n WHERE cells >= 2 QUALIFY row_number() OVER (PARTITION BY day ORDER BY cells DESC, label) = 1""")
def largest_objects(spark, mask):
    """[T5, O4] The largest object of each month, among those of two cells and more."""
    return O.largest_object(O.large_objects(O.label(mask, ["day"], diagonal=False), ["day"], 2), ["day"])


@query("fx_mask", sql=f"""WITH {_FLAT}, h AS (SELECT day, label, max((lat_i BETWEEN 20 AND 22 AND lon_i % 40 = 3)::INT) AS hit FROM l GROUP BY ALL), k AS (SELECT *, max(hit) OVER (PARTITION BY day) AS any_hit FROM h)
SELECT day, label, count(*) AS cells FROM l JOIN k USING (day, label) WHERE hit = 1 OR any_hit = 0 GROUP BY ALL""")
def touching_objects(spark, mask):
    """[J27] Objects that touch a box, or all of a month if none does."""
    labelled = O.label(mask, ["day"], diagonal=False)
    return O.touching(labelled, F.col("lat_i").between(20, 22) & (F.col("lon_i") % 40 == 3), ["day"]).groupBy("day", "label").agg(F.count(F.lit(1)).alias("cells"))


@query("fx_mask", sql="""SELECT day, round(least(greatest(avg(lat_i)*4 - 1e2 - 1e1, -9e1), 7e1), 4) AS south, round(least(greatest(avg(lat_i)*4 - 1e2 - 1e1, -9e1), 7e1) + 2e1, 4) AS north, round(((avg(lon_i) - 15e0) % 36e1 + 36e1) % 36e1, 4) AS west, round(((avg(lon_i) + 15e0) % 36e1 + 36e1) % 36e1, 4) AS east FROM fx_mask GROUP BY day""")
def placed_boxes(spark, mask):
    """[O9]"""
    centres = mask.groupBy("day").agg((F.avg("lat_i") * 4 - 100.0).alias("lat"), F.avg("lon_i").alias("lon"))
    return rounded(centres.select("day", *O.place_box(F.col("lat"), F.col("lon"), 20.0, 30.0)))


@query("fx_mask", sql=f"""WITH c AS (SELECT *, printf('%09d-%05d-%05d', day, lat_i, lon_i) AS node, cos(radians(lat_i*3e0 - 8e1)) AS w FROM fx_mask),
o AS (SELECT d.x AS d, i.x AS i, j.x AS j FROM (VALUES (-1), (0), (1)) d(x), (VALUES (-1), (0), (1)) i(x), (VALUES (-1), (0), (1)) j(x)),
e AS (SELECT 1 AS g, a.node AS a, b.node AS b FROM c a, o, c b WHERE b.day = a.day + o.d AND b.lat_i = a.lat_i + o.i AND b.lon_i = a.lon_i + o.j), {REACH},
d AS (SELECT label, day, sum(w) AS area, min(lat_i) AS lo, max(lat_i) AS hi FROM c JOIN lb USING (node) GROUP BY ALL),
s AS (SELECT label, count(*) AS days, sum(area) AS severity, arg_max(day, (round(area, 9), -day)) AS peak_day, max(area) AS peak_area, min(lo)::DOUBLE AS value_min, max(hi)::DOUBLE AS value_max FROM d GROUP BY label)
SELECT label, days, round(severity, 4) AS severity, peak_day, round(peak_area, 4) AS peak_area, value_min, value_max, row_number() OVER (ORDER BY round(severity, 6) DESC, label)::INT AS rank FROM s WHERE days >= 2 ORDER BY rank LIMIT 20""")
def components_3d(spark, mask):
    """[O2, T1, T2, A47, A48] 26-connected objects over months, the most severe ranked."""
    w = F.cos(F.radians(F.col("lat_i") * 3.0 - 80.0))
    return rounded(O.severest(O.label(mask, [], day="day"), "day", F.col("lat_i").cast("double"), w, 2, 20))


_BEST_FIRST = "ORDER BY iou DESC, ov DESC, prev, label"


@query("fx_wide_mask", sql=f"""WITH c AS (SELECT *, printf('%05d-%05d', lat_i, lon_i) AS node FROM fx_wide_mask), o AS (SELECT i.x AS i, j.x AS j FROM (VALUES (-1), (0), (1)) i(x), (VALUES (-1), (0), (1)) j(x)),
e AS (SELECT a.day AS g, a.node AS a, b.node AS b FROM c a, o, c b WHERE b.day = a.day AND b.lat_i = a.lat_i + o.i AND b.lon_i = a.lon_i + o.j), {REACH},
l AS (SELECT c.*, label FROM c JOIN lb ON g = day AND lb.node = c.node), n AS (SELECT day, label, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 3), k AS (SELECT l.*, n FROM l JOIN n USING (day, label)),
p AS (SELECT b.day, a.label AS prev, b.label, count(*) AS ov, count(*)/(a.n + b.n - count(*)) AS iou FROM k a JOIN k b ON b.day = a.day + 1 AND b.lat_i = a.lat_i AND b.lon_i = a.lon_i GROUP BY b.day, a.label, b.label, a.n, b.n HAVING count(*)/least(a.n, b.n) >= 0.3),
m AS (SELECT *, 0 AS final FROM p UNION ALL SELECT day, prev, label, ov, iou, top FROM (SELECT *, max(top) OVER (PARTITION BY day, prev) AS tp, max(top) OVER (PARTITION BY day, label) AS tl FROM
  (SELECT *, (row_number() OVER (PARTITION BY day, prev {_BEST_FIRST}) = 1 AND row_number() OVER (PARTITION BY day, label {_BEST_FIRST}) = 1)::INT AS top FROM m WHERE final = 0)) WHERE top = 1 OR (tp = 0 AND tl = 0)),
q AS (SELECT day, label, n, printf('%09d@', day) || label AS root FROM n WHERE (day, label) NOT IN (SELECT (day, label) FROM m WHERE final = 1)
  UNION ALL SELECT n.day, n.label, n.n, q.root FROM q JOIN m ON final = 1 AND m.day = q.day + 1 AND m.prev = q.label JOIN n ON n.day = m.day AND n.label = m.label)
SELECT root, min(day) AS start_day, max(day) AS end_day, count(*) AS days, round(avg(n), 4) AS mean_area, max(n) AS max_area FROM q GROUP BY root""")
def object_tracking(spark, mask):
    """[O4, O5, J16, W15, A49] Objects of each time step linked to the next one's, one to one, the largest overlap first."""
    labelled = O.large_objects(O.label(mask, ["day"]), ["day"], 3)
    return rounded(O.tracked_objects(labelled, [], "day"))


@query("fx_cell_day", sql="""WITH w AS (SELECT *, cos(radians(lat)) AS w FROM fx_cell_day WHERE pred > truth*1.05), p AS (SELECT model, day AS peak, sum(w) AS area FROM w GROUP BY model, day QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(sum(w), 9) DESC, day) = 1)
SELECT c.model, c.day, c.cell_id, round(avg(pred) + 1e-7, 4) AS pred, round(avg(truth) + 1e-7, 4) AS truth FROM fx_cell_day c JOIN p ON c.model = p.model AND c.day = p.peak WHERE lat BETWEEN -64 AND 64 GROUP BY ALL""")
def peak_day_map(spark, cells):
    """[O9, O10]"""
    daily = cells.where(F.col("pred") > F.col("truth") * 1.05).groupBy("model", "day").agg(F.round(F.sum(F.cos(F.radians("lat"))), 9).alias("area"))
    peak = O.peak_days(daily, ["model"], "day", "area")
    return rounded(O.map_extract(cells, peak, ["model"], "day", F.col("lat").between(-64, 64)).groupBy("model", "day", "cell_id").agg(F.avg("pred").alias("pred"), F.avg("truth").alias("truth")), offset=1e-7)


@query("fx_mask", sql="""SELECT day, lat_i, lon_i, round(v, 4) AS value FROM (SELECT day, lat_i, lon_i, ((lat_i*7 + lon_i*13 + day*5) % 101)::DOUBLE AS v, lon_i % 4 = 0 AS masked FROM fx_mask) QUALIFY row_number() OVER (PARTITION BY day ORDER BY NOT masked, v, lat_i, lon_i) = 1""")
def coldest_cell(spark, mask):
    """[T6, O9]"""
    x = mask.select("*", ((F.col("lat_i") * 7 + F.col("lon_i") * 13 + F.col("day") * 5) % 101).cast("double").alias("value"), (F.col("lon_i") % 4 == 0).alias("masked"))
    return rounded(O.coldest_cell(x, ["day"], "value", "masked"))


@query("fx_cell_day", sql="""WITH b AS (SELECT *, cos(radians(lat)) AS w FROM fx_cell_day WHERE lat BETWEEN -20 AND 60) SELECT day, """ + ", ".join(f"round(sum(w*pred) FILTER (model = '{m}')/sum(w) FILTER (model = '{m}') + 1e-7, 4) AS \"{m}\"" for m in "ANR") + ", round(sum(w*truth)/sum(w) + 1e-7, 4) AS truth FROM b GROUP BY day")
def box_timeseries_pivot(spark, cells):
    """[A31, P22]"""
    return rounded(O.box_series(cells, F.col("lat").between(-20, 60), "day", "model", ["A", "N", "R"]), offset=1e-7)


@query("fx_cell_day", sql="SELECT lead_h, " + ", ".join(f"round(avg(pred) FILTER (model = '{m}') - avg(truth) FILTER (model = '{m}'), 4) AS \"{m}\"" for m in "ANR") + " FROM fx_cell_day WHERE lat > 0 GROUP BY lead_h")
def bias_table(spark, cells):
    """[A32]"""
    return rounded(O.bias_table(cells, F.col("lat") > 0, "lead_h", "model", ["A", "N", "R"]))
