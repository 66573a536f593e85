"""Analytic cases and brute-force comparisons of operators that SQL cannot express, and of scans, sinks and streams."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriskill.functions import metrics, scalars
from veriskill.operators import coverage, detect, events, grid, objects, stations, tracks
from veriskill.plans.fixtures import view
from veriskill.sources import readers, sinks
from veriskill.streaming import streams

DIR = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flood(cells, near):
    left, found = set(cells), {}
    while left:
        stack, seen = [left.pop()], []
        while stack:
            c = stack.pop()
            seen.append(c)
            for d in [x for x in left if near(c, x)]:
                left.discard(d)
                stack.append(d)
        for c in seen:
            found[c] = frozenset(seen)
    return found


def same_partition(found, labels):
    by = {}
    for c, l in labels.items():
        by.setdefault(l, set()).add(c)
    return {frozenset(v) for v in by.values()} == set(found.values())


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_2d(spark, diagonal):
    mask = view(spark, DIR, "fx_wide_mask").where("day = 50")
    got = {(r.lat_i, r.lon_i): r.label for r in objects.label(mask, ["day"], diagonal=diagonal).collect()}
    near = lambda a, b: (abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1) if diagonal else abs(a[0] - b[0]) + abs(a[1] - b[1]) <= 1
    assert got and same_partition(flood(got, near), got)


def test_components_3d_and_severity(spark):
    mask = view(spark, DIR, "fx_mask").where("day BETWEEN 50 AND 56")
    labelled = objects.label(mask, [], day="day")
    got = {(r.day, r.lat_i, r.lon_i): r.label for r in labelled.collect()}
    found = flood(got, lambda a, b: all(abs(x - y) <= 1 for x, y in zip(a, b, strict=True)))
    assert same_partition(found, got)
    best = objects.severest(labelled, "day", F.col("lat_i").cast("double"), F.lit(1.0), 2, 3).orderBy("rank").collect()
    sizes = sorted((len(o) for o in set(found.values()) if len({c[0] for c in o}) >= 2), reverse=True)[:3]
    assert [int(r.severity) for r in best] == sizes


def test_tracked_objects_follow_a_moving_blob(spark):
    rows = [(d, i, d + j) for d in range(5) for i in range(3) for j in range(4)] + [(d, 15 + i, 2) for d in (0, 1, 3) for i in range(3)]
    cells = spark.createDataFrame(rows, "day int, lat_i int, lon_i int")
    out = objects.tracked_objects(objects.label(cells, ["day"]), [], "day").orderBy("days", "start_day").collect()
    assert [(r.start_day, r.end_day, r.days, r.max_area) for r in out] == [(3, 3, 1, 3), (0, 1, 2, 3), (0, 4, 5, 12)]


def test_object_tracking_takes_all_lines(spark, tmp_path):
    """Every line is a cell of its own, far beyond 24 x 36, and every object and link is a plain loop's."""
    from veriskill.plans.registry import queries

    rng = np.random.default_rng(5)
    lines = [(int(250 * x), float(q), f"199{2 + m // 12}-{m % 12 + 1:02d}-15") for m in range(15) for x in (*range(8), *range(2000, 2008)) for q in range(1, 51) if rng.random() < 0.25]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, d string").select("*", F.to_date("d").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    days = {}
    for key, q, d in lines:
        days.setdefault(12 * (int(d[:4]) - 1992) + int(d[5:7]), set()).add((int(q), key // 250))
    assert sum(map(len, days.values())) == len(lines)
    per_day = {d: sorted({o for o in flood(cells, lambda a, b: abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1).values() if len(o) >= 3}, key=min) for d, cells in days.items()}
    chain = {}  # object -> its chain
    want = []
    for d in sorted(per_day):
        pairs = []
        for b in per_day[d]:
            for a in per_day.get(d - 1, []):
                n = len(a & b)
                if n and n / min(len(a), len(b)) >= 0.3:
                    pairs.append((-n / len(a | b), -n, min(a), min(b), a, b))
        taken = set()
        for *_, a, b in sorted(pairs, key=lambda x: x[:4]):
            if ("a", a) not in taken and ("b", b) not in taken:
                taken |= {("a", a), ("b", b)}
                chain[d, b] = chain[d - 1, a]
        for b in per_day[d]:
            if (d, b) not in chain:
                want.append([])
                chain[d, b] = want[-1]
            chain[d, b].append((d, len(b)))
    got = queries()["object_tracking"](spark, str(tmp_path)).collect()
    assert max(len(c) for c in want) > 1
    assert sorted((r.start_day, r.end_day, r.days, round(r.mean_area, 4), r.max_area) for r in got) == sorted((c[0][0], c[-1][0], len(c), round(sum(n for _, n in c) / len(c), 4), max(n for _, n in c)) for c in want)


def test_perfect_forecast(spark):
    x = spark.range(50).selectExpr("id AS i", "cast(id AS double) AS pred", "cast(id AS double) AS truth", "cast(id % 7 AS double) AS clim", "1e0 AS w")
    r = grid.scores(x, []).first()
    assert (r.wrmse, r.bias, r.mae) == (0, 0, 0) and abs(r.acc - 1) < 1e-12
    none = grid.scores(x.withColumn("clim", F.lit(None).cast("double")), []).first()
    assert none.activity is None and none.acc is None


def test_registry_refuses_unknown_metrics():
    with pytest.raises(KeyError, match="known"):
        metrics.metric("nope")


def test_regrid_of_a_constant_is_constant(spark):
    cells = spark.range(24 * 36).selectExpr("cast(id / 36 AS int) AS lat_i", "cast(id % 36 AS int) AS lon_i", "5e0 AS value", "'m' AS model")
    lat = grid.linear_weights(grid.axis(spark, 24, -80.5, 7.0, "lat"), grid.axis(spark, 31, 90.0, -6.0, "lat"), "lat")
    lon = grid.linear_weights(grid.axis(spark, 36, 0.0, 10.0, "lon"), grid.axis(spark, 50, 0.0, 7.2, "lon"), "lon", period=360.0)
    out = grid.regrid_linear(cells, lat, lon, ["model"]).collect()
    assert len(out) == 31 * 50 and all(abs(r.value - 5) < 1e-12 for r in out)


def greedy_plain(pairs):
    used_p, used_t, out = set(), set(), []
    for iou, p, t in sorted(pairs, key=lambda x: (-x[0], x[2], x[1])):
        if p not in used_p and t not in used_t:
            used_p.add(p)
            used_t.add(t)
            out.append((p, t))
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.2])
def test_match_events_is_greedy(spark, least):
    rng = np.random.default_rng(2)

    def runs(mask):
        out, s = [], None
        for k, v in enumerate([*mask, False]):
            if v and s is None:
                s = k
            if not v and s is not None:
                out.append((s, k - 1))
                s = None
        return out

    rows = {"p": [], "t": []}
    want = {}
    for cell in range(40):
        one, two = runs(rng.random(90) < 0.7), runs(rng.random(90) < 0.7)
        rows["p"] += [(cell, *x) for x in one]
        rows["t"] += [(cell, *x) for x in two]
        iou = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1) / (max(a[1], b[1]) - min(a[0], b[0]) + 1)
        want[cell] = greedy_plain([(i, a[0], b[0]) for a, b in itertools.product(one, two) if (i := iou(a, b)) >= least])
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c))
    table = lambda k: spark.createDataFrame(rows[k], "cell int, s int, e int").select("cell", day("s").alias("start_day"), day("e").alias("end_day"))
    got = {}
    for r in events.match_events(table("p"), table("t"), ["cell"], least).collect():
        origin = __import__("datetime").date(2020, 1, 1)
        got.setdefault(r.cell, []).append(((r.pred_start - origin).days, (r.truth_start - origin).days))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_conservation_is_checked(spark):
    bad = spark.createDataFrame([(1, 1, 0, 0, 2, 1)], "cell int, tp int, fp int, fn int, pred_total int, truth_total int")
    with pytest.raises(Exception, match="do not add up"):
        events.conserved(bad).collect()


def test_percentages_are_checked(spark):
    with pytest.raises(ValueError, match="between"):
        events.doy_percentile(spark.range(1).selectExpr("id AS c", "1e0 AS v", "current_date() AS day"), ["c"], "v", [0])


def test_link_paths_matches_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(r, s, float(10 + rng.normal(0, 2)), float(120 + rng.normal(0, 2))) for r in range(6) for s in range(8) for _ in range(int(rng.integers(0, 4)))]
    points = spark.createDataFrame(rows, "run int, step int, lat double, lon double")
    got = sorted((r.run, r.step, r.lat, r.lon, r.path_id) for r in tracks.link_paths(points, ["run"]).collect())
    want = []
    for run in range(6):
        paths = []
        for step in range(8):
            here = sorted((y, x) for r, s, y, x in rows if (r, s) == (run, step))
            pairs = sorted((6371 * np.hypot(np.radians(y - p[1]), np.radians(x - p[2])), i, k) for k, p in enumerate(paths) for i, (y, x) in enumerate(here) if 1 <= step - p[0] <= 2)
            ids = [-1] * len(here)
            for km, i, k in pairs:
                if km < (step - paths[k][0]) * 300 and ids[i] < 0 and k not in ids:
                    ids[i] = k
            for i, (y, x) in enumerate(here):
                if ids[i] < 0:
                    ids[i] = len(paths)
                    paths.append(None)
                paths[ids[i]] = (step, y, x)
                want.append((run, step, y, x, ids[i]))
    assert got == sorted(want)


def test_dead_paths_are_dropped():
    paths, begun = [], 0
    for step in range(2000):
        _, begun = tracks.step_paths(paths, begun, step, np.array([float(step % 80)]), np.array([float(40 * step % 360)]), 300.0, 2)
    assert begun == 2000 and len(paths) <= 2


def test_path_linking_query_matches_a_plain_loop(spark):
    from veriskill.plans.registry import queries

    groups = {}
    for r in view(spark, DIR, "fx_track").collect():
        groups.setdefault(r.sid, []).append((r.lead_h // 6, r.pred_lat, r.pred_lon))
    want = []
    for sid, points in groups.items():
        paths, found = [], {}
        for step in sorted({p[0] for p in points}):
            here = sorted(p[1:] for p in points if p[0] == step)
            pairs = sorted((6371 * np.hypot(np.radians(y - p[1]), np.radians(x - p[2])), i, k) for k, p in enumerate(paths) for i, (y, x) in enumerate(here) if 1 <= step - p[0] <= 2)
            ids = [-1] * len(here)
            for km, i, k in pairs:
                if km < (step - paths[k][0]) * 300 and ids[i] < 0 and k not in ids:
                    ids[i] = k
            for i, (y, x) in enumerate(here):
                if ids[i] < 0:
                    ids[i] = len(paths)
                    paths.append(None)
                paths[ids[i]] = (step, y, x)
                found.setdefault(ids[i], []).append(step)
        want += [(sid, k, len(v), min(v), max(v)) for k, v in found.items()]
    assert sorted(tuple(r) for r in queries()["path_linking"](spark, DIR).collect()) == sorted(want)


def test_layers_and_simple_tracks(spark):
    rows = [(c, v, lev, float(lev + c + (v == "t"))) for c in range(3) for v in ("z", "t") for lev in (200, 300, 500, 850)]
    fields = spark.createDataFrame(rows, "cell int, variable string, level_hpa int, value double")
    assert {r.cell: r.thickness for r in detect.layer_thickness(fields, ["cell"]).collect()} == {c: -650.0 for c in range(3)}
    assert {r.cell: r["mean"] for r in detect.layer_mean(fields, ["cell"], (300, 500)).collect()} == {c: 401.0 + c for c in range(3)}
    cells = [("s", 6 * k, 10.0 + i, 120.0 + j, 100_000.0 + 100 * ((10 + i - 12 - k / 2) ** 2 + (120 + j - 122 - k / 2) ** 2), 20.0, 0.0) for k in range(1, 5) for i in range(10) for j in range(10)]
    crops = spark.createDataFrame(cells, "sid string, lead_h long, lat double, lon double, msl double, u10 double, v10 double")
    got = detect.minimum_pressure_track(crops, spark.createDataFrame([("s", 12.0, 122.0)], "sid string, lat double, lon double"), ["sid"]).orderBy("lead_h").collect()
    assert [(r.lead_h, r.max_wind) for r in got] == [(6 * k, 20.0) for k in range(1, 5)] and all(abs(r.lat - 12 - r.lead_h / 12) <= 0.5 for r in got)


def test_detected_centres_are_linked_to_paths(spark):
    """A detector's centres of each step, through the path linker."""
    frames = []
    for step in range(4):
        frames.append(blob(spark).withColumn("step", F.lit(step)).withColumn("lon", F.col("lon") + 0.5 * step))
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    centres = detect.warm_cores(whole, ["run", "step"], rows=40, width=40)
    linked = tracks.link_paths(centres.select("run", "step", "lat", "lon"), ["run"]).collect()
    assert sorted((r.step, r.path_id) for r in linked) == [(s, 0) for s in range(4)]


def test_observations_meet_forecasts_and_tails_split(spark):
    obs = spark.createDataFrame([("a", "t2m", "2024-01-01 06:00:00", 1.0), ("b", "t2m", "2024-01-01 06:00:00", 2.0)], "station string, variable string, valid_time string, obs double").withColumn("valid_time", F.col("valid_time").cast("timestamp"))
    fc = obs.select("station", "variable", "valid_time", (F.col("obs") + 1).alias("pred")).where("station = 'a'")
    assert [(r.station, r.pred, r.obs) for r in readers.observations_at(obs, fc).collect()] == [("a", 2.0, 1.0)]


def test_storm_tracker_follows_a_hollow(spark):
    from veriskill.plans.registry import queries

    out = queries()["storm_tracker"](spark, DIR).collect()
    assert out and all(r.reason == "max_lead_reached" and r.fails == 0 for r in out)
    best = {r.sid: (r.lat0, r.lon0) for r in view(spark, DIR, "fx_track").where("model = 'click' AND sid < 20").groupBy("sid").agg(F.avg("true_lat").alias("lat0"), F.avg("true_lon").alias("lon0")).collect()}
    for r in out:
        lat0, lon0 = best[r.sid]
        k = r.lead_h / 6
        assert abs(r.lat - lat0 - 0.4 * k) <= 1.1 and abs(r.lon - lon0 - 0.6 * k) <= 1.1


def test_storm_tracker_takes_every_storm_and_step(spark, tmp_path):
    from veriskill.plans.registry import queries

    rows = [(100 * sid + k, sid, f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00", "click", 20.0 + (7 * k + sid) % 60) for sid in (3, 20, 45) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.sid, r.lead_h): r for r in queries()["storm_tracker"](spark, str(tmp_path)).collect()}
    assert set(got) == {(sid, 6 * (k + 1)) for sid in (3, 20, 45) for k in range(30)}
    for sid in (3, 20, 45):
        mine = [r for r in rows if r[1] == sid]
        lat0, lon0 = np.mean([10 + r[4] / 25 for r in mine]), np.mean([120 + r[0] % 47 / 5 for r in mine])
        for k, row in enumerate(mine, 1):
            y, x, r, v = lat0 + 0.4 * k, lon0 + 0.6 * k, got[sid, 6 * k], 10 + row[4] / 20
            near = [(i - y) ** 2 + (j - x) ** 2 for i in range(90) for j in range(90, 180) if abs(i - r.lat) <= 1.5 and abs(j - r.lon) <= 1.5]
            assert abs(r.lat - y) <= 1.1 and abs(r.lon - x) <= 1.1 and r.reason == "max_lead_reached" and r.fails == 0
            assert abs(r.min_msl - (101_000 - (3000 + 10 * v) * np.exp(-min(near) / 8))) < 1e-6 and abs(r.max_wind - (20 + v / 10) * np.exp(-min(near) / 20)) < 1e-6


def blob(spark, wide=1.0):
    i, j = np.mgrid[0:40, 0:40]
    r2 = ((i - 20) / wide) ** 2 + (j - 20) ** 2
    v = 4e-4 * np.exp(-r2 / 20)
    rows = [(int(a), int(b), 30 - 0.25 * a, 120 + 0.25 * b, float(v[a, b]), 101_000 - 3e6 * float(v[a, b]), 30e3 * float(v[a, b]), 0.0, float(v[a, b]) * 1e4, float(v[a, b]) * 1e6) for a in range(40) for b in range(40)]
    return spark.createDataFrame(rows, "lat_i int, lon_i int, lat double, lon double, vorticity double, msl double, u10 double, v10 double, warm double, thickness double").withColumn("run", F.lit(1))


def test_vorticity_objects_are_round(spark):
    box = scalars.in_box(F.col("lat"), F.col("lon"), 0, 40, 100, 180)
    r = detect.vorticity_objects(blob(spark), ["run"], box).collect()
    assert len(r) == 1 and abs(r[0].lat - 25) < 0.01 and abs(r[0].lon - 125) < 0.01
    assert detect.vorticity_objects(blob(spark, 0.3), ["run"], box).count() == 0
    assert detect.vorticity_objects(blob(spark), ["run"], scalars.in_box(F.col("lat"), F.col("lon"), -40, 0, 100, 180)).count() == 0


def test_warm_core_is_found(spark):
    out = detect.warm_cores(blob(spark), ["run"], rows=40, width=40).collect()
    assert [(r.lat_i, r.lon_i) for r in out] == [(20, 20)]


def test_hull_area():
    assert detect.convex_area(np.array([(0, 0), (0, 1), (1, 0), (1, 1)], float)) == 4
    assert detect.convex_area(np.array([(0, 0), (0, 2), (2, 0)], float)) == 9 - 2


def test_near_points_by_distance(spark):
    rng = np.random.default_rng(3)
    a = [(1, k, float(rng.uniform(-90, 90)), float(rng.uniform(0, 360))) for k in range(300)]
    b = [(1, k, float(rng.uniform(-90, 90)), float(rng.uniform(0, 360))) for k in range(300)]
    df = lambda x: spark.createDataFrame(x, "run int, k int, lat double, lon double")
    for km in (200.0, 900.0):
        got = {r.k for r in tracks.near_points(df(a), df(b), ["run"], km).collect()}
        rad = np.radians
        hav = lambda p, q: 2 * 6371 * np.arcsin(np.sqrt(min(1, (1 - np.cos(rad(q[2] - p[2])) + np.cos(rad(p[2])) * np.cos(rad(q[2])) * (1 - np.cos(rad(q[3] - p[3])))) / 2)))
        assert got == {p[1] for p in a if any(hav(p, q) <= km for q in b)}


def test_station_values_and_missing_corners(spark):
    rows = spark.createDataFrame([("m", i, [float(10 * i + j) for j in range(4)] if i != 2 else [None, 1.0, 2.0, 3.0]) for i in range(4)], "model string, lat_i int, vals array<double>")
    st = spark.createDataFrame([("a", 75.0, 45.0), ("b", 95.0, 0.0), ("c", 45.0, 315.0), ("d", None, 1.0), ("e", 70.0, -45.0)], "station string, lat double, lon double")
    got = {r.station: r.value for r in stations.to_stations(rows, stations.corners(st, 4, 4, 90.0, -30.0), ["model"]).collect()}
    assert got["a"] == pytest.approx(5.5) and got["e"] == pytest.approx(0.5 * 2 / 6 * 0 + (1 / 3) * (3 / 2) + (2 / 3) * (10 + 3 / 2)) and got["c"] is None and set(got) == {"a", "c", "e"}


def test_channel_subset_refuses_unknown(spark):
    have = spark.createDataFrame([(1, "Z500"), (2, "z_500"), (3, "t2m")], "ord int, name string")
    key = scalars.channel_key(F.col("name"))
    good = coverage.channel_subset(have, spark.createDataFrame([(1, "T2M"), (2, "z500")], "ord int, name string"), key).orderBy("ord").collect()
    assert [r.channel for r in good] == ["t2m", "Z500"]
    with pytest.raises(Exception, match="unknown channel"):
        coverage.channel_subset(have, spark.createDataFrame([(1, "q700")], "ord int, name string"), key).collect()


def test_npy_scan_and_snapshot(spark, tmp_path):
    for day, hour, mark in (("2024-01-01", "06", ":"), ("2024-01-02", "00", "-")):
        d, one = tmp_path / "2024" / day, tmp_path / "single" / "2024" / day
        d.mkdir(parents=True)
        one.mkdir(parents=True)
        np.save(d / f"{hour}{mark}00{mark}00-z-500.0.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
        np.save(one / f"{hour}{mark}00{mark}00-t2m.npy", np.array([[1, np.nan, 3], [4, 5, 6]], np.float32))
    fields = readers.npy_fields(spark, str(tmp_path), "era5", flip=True)
    got = {(str(r.valid_time), r.variable, r.level_hpa, r.lat_i): r.vals for r in fields.collect()}
    assert got["2024-01-01 06:00:00", "z", 500, 0] == [3, 4, 5] and got["2024-01-02 00:00:00", "t2m", None, 1] == [1, None, 3] and len(got) == 8
    channels = spark.createDataFrame([("t2m", None, 0), ("z", 500, 1), ("q", 1, 2)], "variable string, level_hpa int, ord int")
    assert readers.snapshot(fields.where("valid_time = '2024-01-01 06:00:00'"), channels).select("ord").distinct().count() == 2


def test_text_scans(spark, tmp_path):
    (tmp_path / "tracks.csv").write_text(
        "SID,NAME,BASIN,SUBBASIN,SEASON,ISO_TIME,LAT,LON,WMO_PRES,WMO_WIND\n , , , ,Year, ,degrees_north,degrees_east,mb,kts\n"
        "a1, ANNA ,,WP,2024,2024-07-01 06:00:00,10.5,-170.0,990,35\na1,ANNA,,WP,2024,2024-07-01 06:00:00,11.5,-170.0,, \na1,ANNA,NA,WP,2024,2024-07-01 07:30:00,10,1,1,1\na1,ANNA,NA,WP,2024,2024-07-01 12:00:00,x,1,1,1\n")  # fmt: skip
    t = readers.best_tracks(spark, str(tmp_path / "tracks.csv")).orderBy("iso_time").collect()
    assert [(r.lat, r.lon, r.wmo_pres, r.basin) for r in t] == [(11.5, 190.0, None, "UNKNOWN"), (None, 1.0, 1.0, "NA")]
    assert readers.storm_lookup(readers.best_tracks(spark, str(tmp_path / "tracks.csv")), 2024, "ann", "2024-07-01 00:00:00", "2024-07-02 00:00:00", 6).count() == 1
    (tmp_path / "s.psv").write_text("DATE|STATION|LATITUDE|LONGITUDE|ELEVATION|temperature|wind_direction|extra\n2024-01-01T00:00:00|X1|1|2|******|3.5|999|z\n")
    r = readers.station_files(spark, str(tmp_path / "s.psv")).first()
    assert (r.station, r.temperature, r.wind_direction, r.elevation) == ("X1", 3.5, None, None) and "extra" not in r and r.precipitation_3_hour is None
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.psv").write_text("DATE|STATION|temperature|precipitation_6_hour\n2024-01-01T00:00:00|X1|1.5|2\n")
    (tmp_path / "two" / "b.psv").write_text("STATION|precipitation_6_hour|DATE\nX2|7|2024-01-01T00:00:00\n")
    assert sorted((r.station, r.temperature, r.precipitation_6_hour) for r in readers.station_files(spark, str(tmp_path / "two")).collect()) == [("X1", 1.5, 2.0), ("X2", None, 7.0)]
    (tmp_path / "c.json").write_text('{"X1": {"latitude": 1.5, "longitude": 2}}')
    assert readers.station_catalog(spark, str(tmp_path / "c.json")).first().asDict() == {"station": "X1", "lat": 1.5, "lon": 2.0}
    d = tmp_path / "fc" / "m" / "2024010100"
    d.mkdir(parents=True)
    for n in ("2024-0101-06.nc", "2024-0101-12_3.nc", "junk.nc"):
        (d / n).write_text("x")
    got = sorted((r.model, r.lead_hours, r.member) for r in readers.forecast_catalog(spark, str(tmp_path / "fc")).collect())
    assert got == [("m", 6, None), ("m", 12, 3)]
    (tmp_path / "m.csv").write_text("init_time,lead_hours,variable,bias\n2024010100,6,t2m,1\n2024010100,6,t2m,2\n")
    assert [(r.bias, r.acc) for r in readers.metric_tables(spark, str(tmp_path / "m.csv")).collect()] == [(2.0, None)]
    (tmp_path / "ms").mkdir()
    (tmp_path / "ms" / "a.csv").write_text("init_time,lead_hours,variable,wrmse,bias\n2024010100,6,t2m,1,2\n")
    (tmp_path / "ms" / "b.csv").write_text("acc,bias,variable,lead_hours,init_time\n0.9,5,\"z_500\",12,2024010100\n")
    assert sorted((r.lead_hours, r.variable, r.wrmse, r.bias, r.acc) for r in readers.metric_tables(spark, str(tmp_path / "ms")).collect()) == [(6, "t2m", 1.0, 2.0, None), (12, "z_500", None, 5.0, 0.9)]
    for source, text in (("era5", "Storm_ID,Lead_Time,Track_Error_km,Status\ns1,6,10.5,OK\ns1,12,x,ok\ns1,18,3,failed\n"), ("ifs", "Lead_Time,Storm_ID,Track_Error_km\n24,s2,7\n")):
        d = tmp_path / "tc" / f"source={source}" / "model=m"
        d.mkdir(parents=True)
        (d / "raw.csv").write_text(text)
    assert sorted((r.source, r.model, r.Storm_ID, r.Lead_Time, r.Track_Error_km) for r in readers.track_tables(spark, str(tmp_path / "tc")).collect()) == [("era5", "m", "s1", 6, 10.5), ("ifs", "m", "s2", 24, 7.0)]
    (tmp_path / "days").mkdir()
    for day in ("20240101", "20240102", "20240105"):
        (tmp_path / "days" / f"era5.2_metre_temperature.{day}.nc").write_text("x")
    (tmp_path / "days" / "other.20240102.nc").write_text("x")
    assert sorted(str(r.day) for r in readers.dated_files(spark, str(tmp_path / "days"), "2024-01-02", "2024-01-05").collect()) == ["2024-01-02", "2024-01-05"]


def test_sinks(spark, tmp_path):
    fields = spark.createDataFrame([("m", "2024010100", h, v, 500, 0, [1.0]) for h in (6, 12, 18) for v in ("z", "t")], "model string, init_time string, lead_hours int, variable string, level_hpa int, lat_i int, vals array<double>")
    dims = spark.createDataFrame([("z", "m2 s-2"), ("t", "K")], "variable string, unit string")
    for _ in range(2):
        sinks.save_forecast(fields, dims, f"{tmp_path}/f", leads=(6, 12), variables=["z"])
    assert [(r.lead_hours, r.unit) for r in spark.read.parquet(f"{tmp_path}/f").orderBy("lead_hours").collect()] == [(6, "m2 s-2"), (12, "m2 s-2")]
    sinks.save_forecast(fields.where("lead_hours = 18"), dims, f"{tmp_path}/f")
    assert sorted((r.lead_hours, r.variable) for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [(6, "z"), (12, "z"), (18, "t"), (18, "z")]
    members = fields.where("lead_hours = 6").withColumn("member", F.lit(2))
    sinks.save_forecast(members, dims, f"{tmp_path}/fm")
    sinks.save_forecast(members.withColumn("member", F.lit(3)), dims, f"{tmp_path}/fm")
    assert sorted(r.member for r in spark.read.parquet(f"{tmp_path}/fm").collect()) == [2, 2, 3, 3]
    sinks.save_by_init(fields.select("model", "init_time", "lead_hours"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 6
    sinks.save_bundle(fields.drop("vals"), {"by_lead": lambda x: x.groupBy("lead_hours").count()}, f"{tmp_path}/b")
    assert spark.read.option("header", True).csv(f"{tmp_path}/b/by_lead").count() == 3
    sinks.save_metadata(fields, f"{tmp_path}/d", f"{tmp_path}/meta", {"a": 1})
    assert spark.read.json(f"{tmp_path}/meta").first().rows == 6
    sinks.save_baseline(spark.createDataFrame([(1, 90.0), (1, 10.0)], "cell int, p double"), f"{tmp_path}/base")
    assert {r.tail for r in spark.read.parquet(f"{tmp_path}/base").collect()} == {"heat", "cold"}
    sinks.save_cells(spark.createDataFrame([(1, 2, 3.0)], "lat_i int, lon_i int, v double"), f"{tmp_path}/cells")
    made = []

    def make(todo):
        made.append(sorted(r.k for r in todo.collect()))
        return todo.withColumn("v", F.lit(len(made)))

    wanted = spark.createDataFrame([("m", 1), ("m", 2), ("n", 3)], "model string, k int")
    once = sinks.cached(spark, f"{tmp_path}/c", {"x": 1}, wanted.where("k < 3"), ["model", "k"], make)
    assert once.count() == 2
    again = sinks.cached(spark, f"{tmp_path}/c", {"x": 1}, wanted, ["model", "k"], make, refresh=["m"])
    assert made == [[1, 2], [1, 2, 3]] and {r.v for r in again.collect()} == {2} and again.count() == 3


def test_streams(spark, tmp_path):
    for part, hours in enumerate(([0, 6], [12, 30])):
        rows = [("s", f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{m:02d}:00", float(h + m)) for h in hours for m in (0, 10, 40)]
        spark.createDataFrame(rows, "station string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
    obs = spark.readStream.schema("station string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/obs")
    q = streams.slot_stream(obs, ["station"], "ts", ["v"]).writeStream.outputMode("append").format("memory").queryName("slots").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r.slot), r.v, r.n_obs) for r in spark.table("slots").collect())
    assert got[:3] == [("2024-01-01 00:00:00", 5.0, 2), ("2024-01-01 06:00:00", 11.0, 2), ("2024-01-01 12:00:00", 17.0, 2)]

    for part in ([(1, 5.0), (1, 6.0)], [(1, 7.0), (2, 8.0)]):
        spark.createDataFrame(part, "k int, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/new")
    rows = spark.readStream.schema("k int, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/new")
    streams.append_new(rows, f"{tmp_path}/target", ["k"], f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/target").collect())[-1] == (2, 8.0) and spark.read.parquet(f"{tmp_path}/target").count() == 2

    streams.append_new(rows, f"{tmp_path}/target2", ["k"], f"{tmp_path}/c4", within="k").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/target2").collect()) == sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/target").collect())

    steps = [("r", s, 10 + 0.5 * s, 120.0 + s) for s in range(6)] + [("r", 3, 40.0, 10.0)]
    for s in range(6):
        spark.createDataFrame([x for x in steps if x[1] == s], "run string, step int, lat double, lon double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pts{s // 3}")
    points = spark.read.parquet(f"{tmp_path}/pts0", f"{tmp_path}/pts1")
    whole = sorted((r.step, r.lat, r.path_id) for r in tracks.link_paths(points, ["run"]).collect())
    import os, shutil

    os.makedirs(f"{tmp_path}/all")
    for k in range(2):
        spark.read.parquet(f"{tmp_path}/pts{k}").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/one")
        for f in sorted(os.listdir(f"{tmp_path}/one")):
            if f.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/one/{f}", f"{tmp_path}/all/{k}.parquet")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = streams.path_stream(stream, "run").writeStream.outputMode("append").format("memory").queryName("paths").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.step, r.lat, r.path_id) for r in spark.table("paths").collect()) == whole
