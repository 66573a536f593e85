"""Queries of run bookkeeping, scans and time shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriskill.functions import scalars as S
from veriskill.operators import coverage as C
from veriskill.operators.tracks import keep_last
from veriskill.plans.register import query, rounded
from veriskill.sources import models, readers

_PRESENT = "p AS (SELECT DISTINCT l_returnflag AS model, cast(l_shipdate AS date) AS init_date, l_linenumber AS hour FROM lineitem)"
_EXPECTED = "e AS (SELECT model, d::DATE AS init_date, hour FROM (VALUES ('A'), ('N'), ('R'), ('X')) m(model), generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) t(d), (VALUES (1), (2), (3), (4)) h(hour))"
_KEYS = ["model", "init_date", "hour"]


def present(lineitem):
    return lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_shipdate").cast("date").alias("init_date"), F.col("l_linenumber").alias("hour")).distinct()


def expected(spark):
    grid = C.init_grid(spark, "1996-01-01", "1996-12-31", [1, 2, 3, 4])
    models = F.explode(F.array(*map(F.lit, "ANRX"))).alias("model")
    return grid.select(models, F.col("init_time").cast("date").alias("init_date"), F.hour("init_time").alias("hour"))


@query("lineitem", sql=f"WITH {_PRESENT}, {_EXPECTED} SELECT model, init_date, hour FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.model = e.model AND p.init_date = e.init_date AND p.hour = e.hour)")
def missing_inits(spark, lineitem):
    """[J19, P8]"""
    return C.missing(expected(spark), present(lineitem), _KEYS)


@query("lineitem", sql=f"WITH {_PRESENT}, {_EXPECTED}, j AS (SELECT e.model, p.hour AS got FROM e LEFT JOIN p USING (model, init_date, hour)) SELECT model, count(*) AS expected, count(got) AS present, count(*) - count(got) AS missing FROM j GROUP BY ROLLUP (model)")
def coverage_summary(spark, lineitem):
    """[A45]"""
    return C.coverage(expected(spark), present(lineitem), "model", _KEYS)


@query("events", sql="""WITH u AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT user_id, CASE min(user_id % 4) WHEN 0 THEN 'storm_end' WHEN 1 THEN 'tracker_fail' WHEN 2 THEN 'max_lead_reached' ELSE 'missing_file' END AS why FROM events GROUP BY 1)
SELECT user_id, event_type FROM u WHERE user_id NOT IN (SELECT user_id FROM d WHERE why IN ('storm_end', 'max_lead_reached'))""")
def resume_anti(spark, events):
    """[J20]"""
    m = F.min(F.col("user_id") % 4)
    ends = events.groupBy("user_id").agg(F.when(m == 0, "storm_end").when(m == 1, "tracker_fail").when(m == 2, "max_lead_reached").otherwise("missing_file").alias("terminate_reason"))
    return C.unfinished(events.select("user_id", "event_type").distinct(), ends, ["user_id"])


@query("lineitem", sql="""WITH r AS (SELECT l_returnflag AS model, cast(l_shipdate AS date) AS init_date, l_linenumber AS lead, l_linestatus AS root, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL)
SELECT model, init_date, lead, root, v FROM r QUALIFY row_number() OVER (PARTITION BY model, init_date, lead ORDER BY CASE root WHEN 'O' THEN 0 ELSE 1 END) = 1""")
def multi_root_priority(spark, lineitem):
    """[S14]"""
    r = lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_shipdate").cast("date").alias("init_date"), F.col("l_linenumber").alias("lead"), F.col("l_linestatus").alias("root")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return C.first_root([r.where("root = 'O'"), r.where("root = 'F'")], ["model", "init_date", "lead"])


@query("lineitem", sql="""WITH a AS (SELECT cast(l_shipdate AS date) AS day, round(avg(l_quantity), 4) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT cast(l_shipdate AS date) AS day, round(avg(l_quantity), 4) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT day, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'preferred' ELSE 'fallback' END AS source FROM a FULL JOIN b USING (day)""")
def fallback_scan(spark, lineitem):
    """[S6]"""
    x = lambda f: lineitem.where(F.col("l_returnflag") == f).groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    return C.fallback(x("A"), x("N"), ["day"])


@query("events", sql="""SELECT user_id, event_type AS name FROM (SELECT DISTINCT user_id, event_type FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END) = 1 AND event_type IN ('purchase', 'view', 'click')""")
def alternate_names(spark, events):
    """[S7]"""
    return C.preferred_name(events.select("user_id", F.col("event_type").alias("name")).distinct(), ["user_id"], "name", ["purchase", "view", "click"])


@query("events", sql="""WITH c AS (SELECT DISTINCT date_trunc('hour', ts) AS t, event_type AS v FROM events), f AS (SELECT t FROM c WHERE v IN ('click', 'view') GROUP BY t HAVING count(DISTINCT v) = 2) SELECT epoch(t)::BIGINT AS t FROM f WHERE t - INTERVAL 6 HOUR IN (SELECT t FROM f)""")
def complete_snapshots(spark, events):
    """[S5, S13, J24]"""
    c = events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), F.col("event_type").alias("v")).distinct()
    return C.complete_snapshots(c, "t", "v", ["click", "view"], 6).select(F.unix_timestamp(F.col("t").cast("timestamp")).alias("t"))


_HOURLY = "h AS (SELECT event_type AS k, date_trunc('hour', ts) AS t, round(avg(value), 4) AS v FROM events GROUP BY ALL)"


def hourly(events):
    return events.groupBy(F.col("event_type").alias("k"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.round(F.avg("value"), 4).alias("v"))


@query("events", sql=f"WITH {_HOURLY} SELECT a.k, epoch(a.t)::BIGINT AS t, a.v, b.v AS v_shifted FROM h a LEFT JOIN h b ON a.k = b.k AND b.t = a.t - INTERVAL 24 HOUR")
def shifted_join(spark, events):
    """[J24, W13]"""
    out = C.shifted(hourly(events), ["k"], "t", 24, ["v"])
    return out.select("k", F.unix_timestamp(F.col("t").cast("timestamp")).alias("t"), "v", "v_shifted")


@query("events", sql=f"WITH {_HOURLY} SELECT a.k, epoch(a.t)::BIGINT AS t, a.v AS input, b.v AS target FROM h a JOIN h b ON a.k = b.k AND b.t = a.t + INTERVAL 12 HOUR")
def training_pairs(spark, events):
    """[S25]"""
    return C.training_pairs(hourly(events), ["k"], "t", 6, 2, "v").withColumn("t", F.unix_timestamp(F.col("t").cast("timestamp")))


@query("events", sql=f"WITH {_HOURLY} SELECT k, epoch(t)::BIGINT AS t, v, round(v - lag(v) OVER (PARTITION BY k ORDER BY t), 4) AS difference FROM h")
def rollout_differences(spark, events):
    """[W14]"""
    return rounded(C.step_differences(hourly(events), ["k"], "t", "v").withColumn("t", F.unix_timestamp(F.col("t").cast("timestamp"))))


@query("events", sql="""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS t, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT event_id, user_id, (SELECT arg_min(v, (abs(epoch_us(t) - epoch_us(l.ts)), t)) FROM r WHERE r.user_id = l.user_id) AS value FROM l""")
def asof_nearest(spark, events):
    """[J23]"""
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    found = C.nearest_in_time(left.select("user_id", "ts").distinct(), right, ["user_id"], "ts", "value")
    return left.join(found, ["user_id", "ts"]).select("event_id", "user_id", "value")


@query("lineitem", sql="""WITH w AS (SELECT m, l FROM (VALUES ('A'), ('N'), ('R'), ('Q')) a(m), (VALUES (1), (2), (3), (8), (9)) b(l)), f AS (SELECT l_returnflag AS m, l_linenumber AS l, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY ALL) SELECT m, l, coalesce(value, 0.0::DOUBLE) AS value FROM w LEFT JOIN f USING (m, l)""")
def zero_fill(spark, lineitem):
    """[S8]"""
    w = spark.sql("SELECT m, l FROM VALUES ('A'), ('N'), ('R'), ('Q') AS a(m) CROSS JOIN VALUES (1), (2), (3), (8), (9) AS b(l)")
    f = lineitem.groupBy(F.col("l_returnflag").alias("m"), F.col("l_linenumber").alias("l")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    return C.zero_filled(f, w, ["m", "l"])


@query("lineitem", sql="""WITH a AS (SELECT DISTINCT l_linenumber*6 AS lead FROM lineitem WHERE l_returnflag = 'A'), w AS (SELECT unnest([6, 24, 999]) AS lead), w2 AS (SELECT unnest([500, 999]) AS lead)
SELECT 'some' AS k, lead FROM a WHERE lead IN (FROM w) UNION ALL SELECT 'none', lead FROM a""")
def common_leads(spark, lineitem):
    """[U5, U7]"""
    a = lineitem.where("l_returnflag = 'A'").select((F.col("l_linenumber") * 6).alias("lead")).distinct()
    w, w2 = (spark.sql(f"SELECT * FROM VALUES {v} AS t(lead)") for v in ("(6), (24), (999)", "(500), (999)"))
    return C.wanted_or_all(w, a, "lead").select(F.lit("some").alias("k"), "lead").unionByName(C.wanted_or_all(w2, a, "lead").select(F.lit("none").alias("k"), "lead"))


@query("lineitem", sql="""WITH o AS (SELECT l_returnflag AS variable, l_linenumber AS k, round(avg(l_quantity), 4) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), n AS (SELECT l_returnflag AS variable, l_linenumber AS k, round(avg(l_quantity) + 1, 4) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT * FROM o WHERE variable NOT IN (SELECT variable FROM n) UNION ALL SELECT * FROM n""")
def replace_variables(spark, lineitem):
    """[U1, U4]"""
    x = lambda s, d: lineitem.where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_quantity") + d, 4).alias("v"))
    return C.replaced(x("F", 0), x("O", 1), "variable")


@query("part", sql="""WITH c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'z_' || (p_size*20) WHEN 1 THEN 'T' || (p_size*20) WHEN 2 THEN 't2m' WHEN 3 THEN 'geopotential_' || (p_size*20) ELSE 'u10' END AS name FROM part)
SELECT p_partkey, name, lower(replace(name, '_', '')) AS key, CASE WHEN regexp_matches(name, '^[A-Za-z]+_?[0-9]{2,4}$') AND name <> 'u10' THEN lower(regexp_extract(name, '^([A-Za-z]+?)_?[0-9]+$', 1)) ELSE lower(name) END AS variable,
 CASE WHEN regexp_matches(name, '^[A-Za-z]+_?[0-9]{2,4}$') AND name <> 'u10' THEN regexp_extract(name, '([0-9]+)$', 1)::INT END AS level FROM c""")
def channel_parsing(spark, part):
    """[P1, P3]"""
    n = F.col("p_size") * 20
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("z_"), n)).when(F.col("p_size") % 5 == 1, F.concat(F.lit("T"), n)).when(F.col("p_size") % 5 == 2, "t2m").when(F.col("p_size") % 5 == 3, F.concat(F.lit("geopotential_"), n)).otherwise("u10")
    x = part.select("p_partkey", name.alias("name"))
    return x.select("p_partkey", "name", S.channel_key(F.col("name")).alias("key"), S.channel_variable(F.col("name")).alias("variable"), S.channel_level(F.col("name")).alias("level"))


@query("orders", sql="""WITH i AS (SELECT o_orderkey, cast(o_orderdate AS timestamp) AS init, 6 * (1 + o_orderkey % 40) AS lead FROM orders), v AS (SELECT *, init + lead * INTERVAL 1 HOUR AS valid FROM i)
SELECT o_orderkey, epoch(valid)::BIGINT AS valid, date_diff('day', init::DATE, valid::DATE) + 1 AS lead_day, round(sin(dayofyear(valid)/366*2*pi()), 4) + 0e0 AS sin_doy, round(cos(dayofyear(valid)/366*2*pi()), 4) + 0e0 AS cos_doy, round(sin(hour(valid)/24*2*pi()), 4) + 0e0 AS sin_hour, round(cos(hour(valid)/24*2*pi()), 4) + 0e0 AS cos_hour FROM v""")
def valid_times(spark, orders):
    """[P7, P10, F6]"""
    x = orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("init"), (6 * (1 + F.col("o_orderkey") % 40)).cast("int").alias("lead"))
    x = x.withColumn("valid", S.valid_time(F.col("init"), F.col("lead")))
    out = x.select("o_orderkey", F.unix_timestamp("valid").alias("valid"), S.lead_day(F.col("valid"), F.col("init")).cast("long").alias("lead_day"), *S.time_encoding(F.col("valid")))
    return rounded(out)


@query("customer", sql="""SELECT c_custkey, round(((c_acctbal % 360) + 360) % 360, 4) AS lon, round(((c_acctbal + 180) % 360 + 360) % 360 - 180, 4) AS signed_lon, round(c_acctbal*0.514444, 4) AS ms, round(CASE WHEN c_acctbal > 2000 THEN c_acctbal/100 ELSE c_acctbal END, 4) AS hpa, round(least(greatest(c_acctbal, 0), 1000), 4) AS mm FROM customer""")
def unit_conversions(spark, customer):
    """[P11, P14, P15, P17]"""
    x = F.col("c_acctbal").cast("double")
    return rounded(customer.select("c_custkey", S.lon_360(x).alias("lon"), S.lon_180(x).alias("signed_lon"), S.metres_per_second(x).alias("ms"), S.hectopascal(x).alias("hpa"), S.rain_mm(x / 1000).alias("mm")))


@query("lineitem", sql="""SELECT model, init, lead, v FROM (SELECT l_returnflag AS model, cast(l_shipdate AS date) AS init, l_linenumber*6 AS lead, max(l_partkey) AS v, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY cast(l_shipdate AS date)) AS r FROM lineitem WHERE l_linenumber IN (1, 4) AND cast(l_shipdate AS date) >= DATE '1996-03-01' GROUP BY 1, 2, 3) WHERE r <= 30""")
def lead_index(spark, lineitem):
    """[S11, T4]"""
    from veriskill.sources.readers import first_inits

    x = lineitem.where(F.col("l_linenumber").isin(1, 4) & (F.col("l_shipdate") >= F.lit("1996-03-01").cast("timestamp_ntz")))
    x = x.groupBy(F.col("l_returnflag").alias("model"), F.col("l_shipdate").cast("date").alias("init"), (F.col("l_linenumber") * 6).alias("lead")).agg(F.max("l_partkey").alias("v"))
    return first_inits(x, ["model"], "init", 30)


@query("lineitem", sql="""SELECT l_returnflag AS model, cast(l_shipdate AS date) AS init, l_linenumber AS lead, arg_max(l_extendedprice, (l_orderkey, l_extendedprice)) AS v FROM lineitem GROUP BY ALL""")
def metric_rows_keep_last(spark, lineitem):
    """[W12]"""
    x = lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_shipdate").cast("date").alias("init"), F.col("l_linenumber").alias("lead"), "l_orderkey", F.col("l_extendedprice").alias("v"))
    return keep_last(x, ["model", "init", "lead"], ["l_orderkey", "v"]).drop("l_orderkey")


@query("lineitem", sql="""SELECT l_returnflag AS model, l_linenumber AS init, count(*) AS n_vars, string_agg(v, ',' ORDER BY v) AS variables FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_linestatus || '_' || (l_suppkey % 3) AS v FROM lineitem) GROUP BY ALL""")
def variables_present(spark, lineitem):
    """[S13]"""
    from veriskill.sources.readers import variables_of

    x = lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("init"), F.col("l_linestatus").alias("variable"), (F.col("l_suppkey") % 3).alias("level_hpa"))
    return variables_of(x, ["model", "init"]).groupBy("model", "init").agg(F.count(F.lit(1)).alias("n_vars"), F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("variables"))


@query("lineitem", sql="""WITH s AS (SELECT l_linenumber AS variable, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1) SELECT l_returnflag AS model, round(avg(abs((l_extendedprice - m)/sd)), 4) AS z, round(avg((l_extendedprice - m)/sd*sd + m), 2) AS back FROM lineitem JOIN s ON l_linenumber = variable GROUP BY 1""")
def standardised_fields(spark, lineitem):
    """[P26]"""
    s = lineitem.groupBy(F.col("l_linenumber").alias("variable")).agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd"))
    x = lineitem.join(F.broadcast(s), F.col("l_linenumber") == F.col("variable")).withColumn("z", S.standardised(F.col("l_extendedprice"), F.col("m"), F.col("sd")))  # one row per variable
    return x.groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.avg(F.abs("z")), 4).alias("z"), F.round(F.avg(F.col("z") * F.col("sd") + F.col("m")), 2).alias("back"))


_FIELDS = "f AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'z' WHEN 1 THEN 't' WHEN 2 THEN 'r' WHEN 3 THEN 't2m' ELSE 'ciwc' END AS variable, CASE WHEN p_size % 5 <> 3 THEN CASE p_partkey % 4 WHEN 0 THEN 500 WHEN 1 THEN 850 WHEN 2 THEN 990 ELSE 1000 END END AS level_hpa FROM part)"


def part_fields(part):
    names = F.array(*map(F.lit, ("z", "t", "r", "t2m", "ciwc")))
    level = F.element_at(F.array(*map(F.lit, (500, 850, 990, 1000))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select("p_partkey", F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")).alias("variable"), F.when(F.col("p_size") % 5 != 3, level).alias("level_hpa"))


@query("part", sql=f"WITH {_FIELDS}, c AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {k}, '{v}', {'NULL' if level is None else level})" for m in models.CHANNELS for k, (v, level) in enumerate(models.channel_list(m)))}) AS t(model, ord, variable, level_hpa)) SELECT p_partkey, model, ord, f.variable, f.level_hpa FROM f JOIN c ON f.variable = c.variable AND f.level_hpa IS NOT DISTINCT FROM c.level_hpa")
def model_snapshots(spark, part):
    """[S2, S3, X2] The fields that each model's channel list asks for, in its order."""
    fields, sets = part_fields(part), models.channel_sets(spark)
    each = [readers.snapshot(fields, sets.where(F.col("model") == m)).withColumn("model", F.lit(m)) for m in models.CHANNELS]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.select("p_partkey", "model", "ord", "variable", "level_hpa")


@query("part", sql=f"WITH {_FIELDS}, n AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in models.LONG_NAMES.items())}) AS t(variable, long_name)) SELECT p_partkey, variable, long_name, long_name || coalesce('_' || level_hpa, '') AS channel FROM f LEFT JOIN n USING (variable)")
def long_names(spark, part):
    """[P4]"""
    x = part_fields(part).join(F.broadcast(models.names(spark)), "variable", "left")  # some twenty names
    return x.select("p_partkey", "variable", "long_name", F.concat("long_name", F.coalesce(F.concat(F.lit("_"), F.col("level_hpa").cast("string")), F.lit(""))).alias("channel"))


@query("part", sql="""WITH c AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'R500' WHEN 1 THEN 'q_850' WHEN 2 THEN 'TP6h' WHEN 3 THEN ' U10' WHEN 4 THEN 'Z_' || (p_size*20) ELSE 'Other' END AS name FROM part),
e AS (SELECT *, CASE WHEN lower(trim(name)) IN ('tp', 'tp6h') THEN 'tp' WHEN lower(trim(name)) IN ('msl', 't2m', 'u10', 'v10') THEN lower(trim(name)) WHEN regexp_matches(trim(name), '^[a-zA-Z]+_?[0-9]{2,4}$') THEN lower(regexp_extract(trim(name), '^([a-zA-Z]+)_?([0-9]{2,4})$', 1)) || '_' || regexp_extract(trim(name), '^([a-zA-Z]+)_?([0-9]{2,4})$', 2) ELSE lower(trim(name)) END AS eval_name FROM c)
SELECT p_partkey, name, eval_name, CASE WHEN name LIKE 'q\\_%' ESCAPE '\\' THEN 'r_' || substr(name, 3) ELSE name END AS saved FROM e WHERE eval_name NOT LIKE 'r\\_%' ESCAPE '\\'""")
def scored_channels(spark, part):
    """[P5]"""
    n = F.col("p_size") % 6
    name = F.when(n == 0, "R500").when(n == 1, "q_850").when(n == 2, "TP6h").when(n == 3, " U10").when(n == 4, F.concat(F.lit("Z_"), F.col("p_size") * 20)).otherwise("Other")
    x = part.select("p_partkey", name.alias("name")).where(S.is_scored(F.col("name")))
    return x.select("p_partkey", "name", S.eval_name(F.col("name")).alias("eval_name"), S.saved_name(F.col("name")).alias("saved"))


@query("orders", sql="SELECT o_orderkey, o_orderkey % 50 AS lead FROM orders WHERE o_orderkey % 50 BETWEEN 6 AND 40 AND o_orderkey % 50 % 6 = 0")
def lead_filter(spark, orders):
    """[P6]"""
    return C.lead_filter(orders.select("o_orderkey", (F.col("o_orderkey") % 50).alias("lead")), "lead", 40)


@query("orders", sql="SELECT o_orderkey FROM orders WHERE cast(o_orderdate AS timestamp) + (o_orderkey % 24) * INTERVAL 1 HOUR BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1996-05-31 18:00:00'")
def init_window(spark, orders):
    """[P9]"""
    init = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return C.init_bounds(orders.select("o_orderkey", init.alias("init")), "init", "19960301", "19960531").select("o_orderkey")


@query("part", sql="WITH l AS (SELECT p_partkey, p_size % 3 AS k, 500 + (p_partkey % 9 - 4)*2e-3 AS level_hpa FROM part) SELECT k, sum(p_partkey)::BIGINT AS keys, count(*) AS n, (SELECT bool_or(abs(m.level_hpa - 850) <= 1) FROM l m WHERE m.k = l.k) AS has_850 FROM l WHERE abs(level_hpa - 500) <= 1e-8 + 5e-3 GROUP BY k")
def level_select(spark, part):
    """[S12]"""
    fields = part.select("p_partkey", (F.col("p_size") % 3).alias("k"), (500 + (F.col("p_partkey") % 9 - 4) * 2e-3).alias("level_hpa"))
    there = readers.levels_present(fields, ["k"], 850.0).withColumnRenamed("has_level", "has_850")
    return readers.at_level(fields, 500.0).groupBy("k").agg(F.sum("p_partkey").alias("keys"), F.count(F.lit(1)).alias("n")).join(there, "k")


@query("part", sql="SELECT p_partkey, t AS input, round(p_retailprice, 4) AS value FROM part, (VALUES (0), (6)) AS v(t)")
def static_inputs(spark, part):
    """[S9] A static field at both input times."""
    times = spark.sql("SELECT * FROM VALUES (0), (6) AS t(input)")
    return C.repeated_over(part.select("p_partkey", F.round("p_retailprice", 4).alias("value")), times)


@query("lineitem", sql="""WITH l AS (SELECT DISTINCT l_suppkey, l_linestatus, l_linenumber*6 AS lead FROM lineitem), a AS (SELECT * FROM l WHERE l_linestatus = 'F'), b AS (SELECT * FROM l WHERE l_linestatus = 'O' AND lead > 36),
x AS (SELECT DISTINCT lead FROM a), y AS (SELECT DISTINCT lead FROM b), z AS (SELECT DISTINCT lead FROM a WHERE lead < 30)
SELECT 'common' AS k, lead FROM x WHERE lead IN (FROM y) UNION ALL SELECT 'either', lead FROM (FROM z UNION FROM y)""")
def leads_common_or_either(spark, lineitem):
    """[U6]"""
    rows = lineitem.select("l_linestatus", (F.col("l_linenumber") * 6).alias("lead"))
    a, b = rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O' AND lead > 36")
    return C.common_or_union(a, b, "lead").select(F.lit("common").alias("k"), "lead").unionByName(C.common_or_union(a.where("lead < 30"), b, "lead").select(F.lit("either").alias("k"), "lead"))


@query("orders", "lineitem", sql="""WITH r AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n < 2 OR q > 150 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n IS NULL THEN 'no result' WHEN n < 2 THEN 'few leads' WHEN q > 150 THEN 'out of range' END AS reason FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def unit_status(spark, orders, lineitem):
    """[X5]"""
    results = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return C.status_rows(orders.select("o_orderkey"), results, ["o_orderkey"], [("few leads", F.col("n") < 2), ("out of range", F.col("q") > 150)])


@query("customer", sql="""SELECT c_custkey, 720 - c_custkey % 721 AS flipped, (c_custkey % 1440 + 720) % 1440 AS rolled, round(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal - 273.15 ELSE c_acctbal END, 4) AS celsius, round(CASE WHEN c_acctbal < 5000 THEN c_acctbal*100 ELSE c_acctbal END, 4) AS pascal, round(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal ELSE c_acctbal*9.80665 END, 4) AS geopotential FROM customer""")
def field_scalars(spark, customer):
    """[P12, P13, P14, P16]"""
    x, even = F.col("c_acctbal").cast("double"), F.col("c_nationkey") % 2 == 0
    return rounded(customer.select(
        "c_custkey", S.flipped(F.col("c_custkey") % 721).alias("flipped"), S.rolled(F.col("c_custkey") % 1440).alias("rolled"), S.celsius(x, F.when(even, "K").otherwise("degC")).alias("celsius"),
        S.pascal(x, x).alias("pascal"), S.geopotential(x, F.when(even, "m2 s-2").otherwise("gpm")).alias("geopotential")))


@query("orders", sql="""WITH k AS (SELECT o_orderkey, o_custkey::VARCHAR || '|' || strftime(cast(o_orderdate AS timestamp), '%Y-%m-%dT%H:%M:%S') || '|' || (o_orderkey % 40) AS eval_key FROM orders) SELECT o_orderkey, eval_key, split_part(eval_key, '|', 1) AS sid, epoch(cast(o_orderdate AS timestamp))::BIGINT AS at FROM k JOIN orders USING (o_orderkey)""")
def keys_and_cases(spark, orders):
    """[F12, F13]"""
    init = F.col("o_orderdate").cast("timestamp")
    x = orders.select("o_orderkey", S.eval_key(F.col("o_custkey").cast("string"), init, F.col("o_orderkey") % 40).alias("eval_key"), F.concat(F.col("o_custkey").cast("string"), F.lit("@"), F.date_format(init, "yyyy-MM-dd HH:mm:ss")).alias("case"))
    sid, at = S.case_parts(F.col("case"))
    return x.select("o_orderkey", "eval_key", sid.alias("sid"), F.unix_timestamp(at).alias("at"))


@query("customer", sql="""SELECT c_custkey, least(greatest(ceil((9e1 - c_acctbal/60e0)/0.25e0 - 0.5e0), 0), 720)::INT AS lat_i, ((ceil((c_acctbal/7e0)/0.25e0 - 0.5e0)::INT % 1440) + 1440) % 1440 AS lon_i FROM customer""")
def nearest_grid_points(spark, customer):
    """[J25]"""
    from veriskill.operators.grid import nearest_index

    x = F.col("c_acctbal").cast("double")
    return customer.select("c_custkey", nearest_index(x / 60, 721, 90.0, -0.25).alias("lat_i"), nearest_index(x / 7, 1440, 0.0, 0.25, periodic=True).alias("lon_i"))
