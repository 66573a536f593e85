"""Queries of heat- and coldwave verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriskill.operators import events as E
from veriskill.plans.register import query, rounded

_MED = "md AS (SELECT cell_id, median(tmax_truth) AS b FROM fx_daily GROUP BY cell_id), mk AS (SELECT d.*, tmax_pred > b AS mp, tmax_truth > b AS mt FROM fx_daily d JOIN md USING (cell_id))"


def _spans(mask: str, name: str) -> str:
    return f"""{name}_r AS (SELECT cell_id, lat, day, day - row_number() OVER (PARTITION BY cell_id ORDER BY day)::INT AS g FROM mk WHERE {mask}),
{name} AS (SELECT cell_id, lat, min(day) AS s, max(day) AS e, count(*) AS n FROM {name}_r GROUP BY cell_id, lat, g HAVING count(*) >= 3)"""


_MATCH = """mt AS (SELECT *, least(pe, te)-greatest(ps, ts)+1 AS o FROM (SELECT cell_id, s AS ps, e AS pe FROM sp) JOIN (SELECT cell_id, s AS ts, e AS te FROM st) USING (cell_id) WHERE ps <= te AND ts <= pe),
m AS (SELECT *, o / ((pe-ps+1)+(te-ts+1)-o) AS iou FROM mt WHERE o / ((pe-ps+1)+(te-ts+1)-o) >= 0.5)"""
_COUNTS = """cn AS (SELECT cell_id, lat, coalesce(tp,0) AS tp, coalesce(p,0) AS p, coalesce(t,0) AS t FROM (SELECT DISTINCT cell_id, lat FROM fx_daily) LEFT JOIN (SELECT cell_id, count(*) AS tp FROM m GROUP BY 1) USING (cell_id) LEFT JOIN (SELECT cell_id, count(*) AS p FROM sp GROUP BY 1) USING (cell_id) LEFT JOIN (SELECT cell_id, count(*) AS t FROM st GROUP BY 1) USING (cell_id) WHERE coalesce(p,0)+coalesce(t,0) > 0)"""
_SKILL = """sk AS (SELECT cell_id, lat, tp, p-tp AS fp, t-tp AS fn, p AS pred_total, t AS truth_total,
 CASE WHEN t=0 AND p=0 THEN NULL WHEN t=0 THEN 0 WHEN p=0 THEN NULL ELSE tp/p END AS precision, CASE WHEN t=0 THEN NULL WHEN p=0 THEN 0 ELSE tp/t END AS recall, CASE WHEN t=0 THEN NULL WHEN p=0 THEN 0 ELSE tp/t END AS pod,
 CASE WHEN t=0 AND p=0 THEN NULL WHEN t=0 THEN 1 WHEN p=0 THEN NULL ELSE (p-tp)/p END AS far, CASE WHEN t=0 OR p=0 THEN NULL ELSE 2*tp/(p+t) END AS f1, CASE WHEN t=0 AND p=0 THEN NULL WHEN t=0 OR p=0 THEN 0 ELSE tp/(p+t-tp) END AS csi FROM cn)"""
_ALL = f"{_MED}, {_spans('mp', 'sp')}, {_spans('mt', 'st')}, {_MATCH}, {_COUNTS}, {_SKILL}"


def masks(daily):
    md = daily.groupBy("cell_id").agg(F.median("tmax_truth").alias("b"))
    x = daily.join(md, "cell_id")
    return x.select("cell_id", "lat", "day", (F.col("tmax_pred") > F.col("b")).alias("mp"), (F.col("tmax_truth") > F.col("b")).alias("mt"))


def spans(daily, mask):
    return E.event_spans(masks(daily), ["cell_id", "lat"], mask=mask)


def skill(daily):
    pred, truth = spans(daily, "mp"), spans(daily, "mt")
    return E.event_skill(E.event_counts(pred, truth, E.match_events(pred, truth, ["cell_id", "lat"]), ["cell_id", "lat"]))


@query("fx_cell_day", sql="SELECT cell_id, model, day, round(max(pred), 4) AS tmax, round(min(pred), 4) AS tmin FROM fx_cell_day GROUP BY ALL")
def daily_extremes(spark, cells):
    """[A26]"""
    return rounded(E.daily_extremes(cells, ["cell_id", "model"], "day", "pred"))


@query("lineitem", "orders", sql="""WITH x AS (SELECT l_returnflag AS model, l_suppkey % 10 AS cell_id, cast(o_orderdate AS date) AS i, cast(l_shipdate AS date) AS day, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT model, cell_id, abs(date_diff('day', i, day)) % 12 + 1 AS lead_day, day, round(max(v), 4) AS tmax, round(min(v), 4) AS tmin FROM x WHERE abs(date_diff('day', i, day)) % 12 + 1 IN (1, 3, 7, 10) GROUP BY ALL""")
def lead_day_extremes(spark, lineitem, orders):
    """[A27, P10]"""
    valid = F.col("l_shipdate").cast("date")
    init = F.date_sub(valid, F.abs(F.datediff(valid, F.col("o_orderdate").cast("date"))) % 12)  # leads of one to twelve days
    x = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 10).alias("cell_id"), init.alias("init"), valid.alias("valid"), "l_extendedprice")
    out = E.lead_day_extremes(x, ["model", "cell_id"], "init", "valid", "l_extendedprice")
    return rounded(out.withColumn("lead_day", F.col("lead_day").cast("long")))


@query("fx_daily", sql="""WITH c AS (SELECT cell_id, tmax_truth AS v, (dayofyear(day) - 1 + o + 366) % 366 + 1 AS doy FROM fx_daily, (SELECT unnest(generate_series(-7, 7)) AS o))
SELECT cell_id, doy, round(quantile_cont(v, 0.9) + 1e-7, 2) AS p90, round(quantile_cont(v, 0.1) + 1e-7, 2) AS p10 FROM c GROUP BY ALL""")
def doy_percentile(spark, daily):
    """[A28, W16, F5]"""
    out = E.doy_percentile(daily, ["cell_id"], "tmax_truth", [90, 10])
    # Interpolation often ends on half a cent; the offset rounds it alike everywhere.
    return rounded(out.select("cell_id", F.col("doy").cast("long").alias("doy"), (F.col("p90") + 1e-7).alias("p90"), (F.col("p10") + 1e-7).alias("p10")), 2)


@query("fx_daily", sql="""WITH b AS (SELECT cell_id, dayofyear(day) AS doy, quantile_cont(tmax_truth, 0.5) AS p50 FROM fx_daily WHERE dayofyear(day) <= 200 GROUP BY ALL)
SELECT d.cell_id, count(*) AS days, count(*) FILTER (tmax_pred > p50) AS above, count(*) FILTER (p50 IS NULL) AS missing, round(sum(greatest(tmax_pred - p50, 0)), 2) AS amount FROM fx_daily d LEFT JOIN b ON d.cell_id = b.cell_id AND dayofyear(day) = doy GROUP BY d.cell_id""")
def exceed_mask(spark, daily):
    """[J13, P27]"""
    base = E.doy_percentile(daily.where(F.dayofyear("day") <= 200), ["cell_id"], "tmax_truth", [50], window=1)
    out = E.exceed_mask(daily, base, "tmax_pred", "p50", ["cell_id"])
    amount = F.when(F.col("p50").isNotNull(), F.greatest(F.col("tmax_pred") - F.col("p50"), F.lit(0.0)))
    return rounded(out.groupBy("cell_id").agg(F.count(F.lit(1)).alias("days"), F.count_if("mask").alias("above"), F.count_if(F.col("p50").isNull()).alias("missing"), F.sum(amount).alias("amount")), 2)


@query("fx_daily", sql=f"WITH {_MED}, {_spans('mp', 'sp')} SELECT cell_id, lat, s AS start_day, e AS end_day, n AS days FROM sp")
def event_spans(spark, daily):
    """[W1]"""
    return spans(daily, "mp")


@query("fx_daily", sql=f"""WITH {_MED}, {_spans('mp', 'sp')}, q AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY s) AS id FROM sp)
SELECT d.cell_id, d.day, coalesce(id, 0) AS event_id FROM fx_daily d LEFT JOIN q ON d.cell_id = q.cell_id AND d.day BETWEEN s AND e""")
def event_ids(spark, daily):
    """[W2]"""
    out = E.event_ids(masks(daily), ["cell_id"], mask="mp")
    return out.select("cell_id", "day", F.col("event_id").cast("long").alias("event_id"))


@query("fx_daily", sql=f"""WITH {_MED}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY day) AS r FROM mk), i AS (SELECT *, r - row_number() OVER (PARTITION BY cell_id ORDER BY day) AS g FROM r WHERE mp),
s AS (SELECT cell_id, min(day) AS start_day, max(day) AS end_day, count(*) AS rows FROM i GROUP BY cell_id, g HAVING count(*) >= 3)
SELECT *, (end_day - start_day + 1)::BIGINT AS duration, row_number() OVER (PARTITION BY cell_id ORDER BY start_day) AS event_id FROM s""")
def row_events(spark, daily):
    """[W3]"""
    out = E.row_events(masks(daily), ["cell_id"], mask="mp")
    return out.withColumn("duration", F.col("duration").cast("long")).withColumn("event_id", F.col("event_id").cast("long"))


@query("fx_daily", sql=f"WITH {_MED}, {_spans('mp', 'sp')}, {_spans('mt', 'st')}, {_MATCH} SELECT cell_id, ps AS pred_start, pe AS pred_end, ts AS truth_start, te AS truth_end, round(iou, 4) AS iou FROM m")
def iou_match(spark, daily):
    """[J14, J15, F4]"""
    return rounded(E.match_events(spans(daily, "mp"), spans(daily, "mt"), ["cell_id", "lat"]).drop("lat"))


@query("fx_daily", sql=f"WITH {_ALL} SELECT cell_id, lat, tp, fp, fn, pred_total, truth_total, round(precision, 4) AS precision, round(recall, 4) AS recall, round(pod, 4) AS pod, round(far, 4) AS far, round(f1, 4) AS f1, round(csi, 4) AS csi FROM sk")
def event_skill(spark, daily):
    """[A33, A34]"""
    return rounded(E.conserved(skill(daily)))


@query("fx_daily", sql=f"""WITH {_ALL}, b AS (SELECT *, CASE WHEN lat BETWEEN -30 AND 30 THEN 'tropics' WHEN lat > 30 THEN 'north' ELSE 'south' END AS band, cos(radians(lat)) AS w FROM sk)
SELECT coalesce(band, 'global') AS band, round(sum(w*pod)/sum(w) FILTER (pod IS NOT NULL), 4) AS pod, round(sum(w*far)/sum(w) FILTER (far IS NOT NULL), 4) AS far, round(sum(w*csi)/sum(w) FILTER (csi IS NOT NULL), 4) AS csi FROM b GROUP BY GROUPING SETS ((band), ())""")
def event_skill_band(spark, daily):
    """[A35, A29, P23]"""
    return rounded(E.skill_summary(skill(daily), "lat", ["pod", "far", "csi"]))


@query("fx_daily", sql="""WITH b AS (SELECT cell_id, median(tmax_truth) AS p90 FROM fx_daily GROUP BY cell_id) SELECT d.cell_id, count(*) FILTER (tmax_pred > p90 AND tmax_pred > 35 AND abs(lat) < 60) AS hot_days FROM fx_daily d JOIN b USING (cell_id) GROUP BY d.cell_id""")
def threshold_mask(spark, daily):
    """[P28]"""
    x = daily.join(daily.groupBy("cell_id").agg(F.median("tmax_truth").alias("p90")), "cell_id")
    return E.threshold_mask(x, "tmax_pred", "p90", "lat").groupBy("cell_id").agg(F.count_if("mask").alias("hot_days"))


@query("fx_daily", sql="""WITH e AS (SELECT min(day) AS a, max(day) AS b FROM fx_daily), c AS (SELECT unnest(generate_series(a, b, interval 1 day))::DATE AS day FROM e)
SELECT cell_id, count(*) AS days, count(*) - count(tmax_pred) AS gaps FROM (SELECT DISTINCT cell_id FROM fx_daily) CROSS JOIN c LEFT JOIN fx_daily USING (cell_id, day) GROUP BY cell_id""")
def gap_free_axis(spark, daily):
    """[W1] Days without a row become missing days."""
    return E.gap_free(daily, ["cell_id"]).groupBy("cell_id").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("tmax_pred").isNull()).alias("gaps"))
