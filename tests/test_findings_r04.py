"""Findings of round 4: storms by the task, and ties as SQL decides them."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veriskill.operators import stations, tracks
from veriskill.plans.registry import oracle_sql, queries
from veriskill.streaming import streams

DIR = "/root/testdata/sf0.01"

#: Query, user, and the number of its rows in the first of two files.
CUTS = [("eye_intensity", 486, 27), ("minimum_pressure_track", 710, 3)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_storm_tracker_makes_cells_where_it_follows(spark):
    """No cell is exploded or shuffled: a row of the plan is a step of a storm."""
    assert "Generate" not in plan(queries()["storm_tracker"](spark, DIR))


def test_storms_of_a_task_do_not_touch_each_other(spark):
    """Tracks that end in all ways, with gaps in the fields, are the same alone and side by side."""
    rng, rows, starts = np.random.default_rng(4), [], []
    for sid, (jump, weak, flat) in enumerate([(0, 9, 9), (4, 9, 9), (0, 3, 9), (0, 9, 2), (0, 9, 1), (5, 4, 3)]):
        lat0, lon0 = 10.3 * sid - 20, (357.2 + 7 * sid) % 360
        starts.append((sid, float(lat0), float(lon0)))
        for k in range(1, 7):
            y, x = lat0 + 0.6 * k + 12 * (0 < jump <= k), lon0 + 0.7 * k
            for i in np.arange(np.floor(y) - 6, np.floor(y) + 7):
                for j in np.arange(np.floor(x) - 6, np.floor(x) + 7):
                    d2 = (i - y) ** 2 + (j - x) ** 2
                    low = 101_000 + (10 * i + 3 * j if k >= flat else rng.normal() - 2000 * np.exp(-d2 / 6))
                    if rng.random() > 0.001:
                        rows.append((sid, 6 * k, float(i), float(j % 360), float(low), (2.0 if k >= weak else 20.0) * float(np.exp(-d2 / 30)), 0.0))
    crops = spark.createDataFrame(rows, "sid long, lead_h int, lat double, lon double, msl double, u10 double, v10 double").cache()
    begun = spark.createDataFrame(starts, "sid long, lat double, lon double")
    got = sorted(map(tuple, tracks.track_storms(crops, begun, ["sid"], size=3).collect()))
    alone = [r for sid in range(6) for r in sorted(map(tuple, tracks.track_storms(crops.where(f"sid = {sid}"), begun, ["sid"], size=3).collect()))]
    assert got == alone and {r[-1] for r in got} == {"max_lead_reached", "corridor_exceeded", "tracker_fail"} and max(r[-2] for r in got) > 0


def test_eye_box_compares_plain_differences(spark):
    """A cell whose longitude differs by a bit more than the radius, as SQL takes the difference, is outside; the globe still closes."""
    eye = float(np.nextafter(124.9, 0))
    cells = [("a", 10.0, 126.4, 900.0), ("a", 10.0, 126.0, 990.0), ("b", 10.0, 359.5, 980.0), ("b", 10.0, 1.5, 970.0), ("b", 10.0, 2.5, 900.0)]
    crops = spark.createDataFrame([(*c, 3.0, 4.0) for c in cells], "sid string, lat double, lon double, msl double, u10 double, v10 double")
    eyes = spark.createDataFrame([("a", 10.0, eye), ("b", 10.0, 0.5)], "sid string, eye_lat double, eye_lon double")
    assert 126.4 - eye > 1.5
    assert {r.sid: (r.min_msl, r.max_wind) for r in tracks.eye_intensity(crops, eyes, ["sid"]).collect()} == {"a": (990.0, 5.0), "b": (970.0, 5.0)}


def test_slots_end_at_the_microsecond(spark):
    """An observation 15 minutes and a fraction of a second from the synoptic time is in no slot."""
    times = {"05:44:59.999999": 0, "05:45:00": 1, "06:15:00": 1, "06:15:00.000001": 0, "06:15:00.9": 0, "12:15:00.5": 0, "23:59:59.999999": 1}
    obs = spark.createDataFrame([(t, f"2024-01-01 {t}", 1.0) for t in times], "station string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.station for r in stations.slots(obs, ["station"], "ts", ["v"]).collect()} == {t for t, n in times.items() if n}
    got = {r.station: str(r.slot) for r in stations.slots(obs, ["station"], "ts", ["v"]).collect()}
    assert got["23:59:59.999999"] == "2024-01-02 00:00:00" and got["05:45:00"] == got["06:15:00"] == "2024-01-01 06:00:00"


def test_streamed_slots_end_at_the_microsecond(spark, tmp_path):
    obs = spark.createDataFrame([(f"2024-01-0{d} {t}", 1.0) for d, t in ((1, "06:15:00"), (1, "06:15:00.5"), (1, "05:44:59.9"), (2, "12:00:00"))], "ts string, v double")
    obs.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/obs")
    rows = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/obs")
    streams.slot_stream(rows, [], "ts", ["v"]).writeStream.format("memory").queryName("r04_slots").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [(str(r.slot), r.n_obs) for r in spark.table("r04_slots").collect()] == [("2024-01-01 06:00:00", 1)]


@pytest.mark.parametrize(("name", "user", "cut"), CUTS)
def test_means_do_not_depend_on_the_files(spark, tmp_path, name, user, cut):
    """Where the last bit of a mean decides a tie, rows in two files give what SQL gives when it adds them in order."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = {user} ORDER BY event_id")
    (tmp_path / "events.parquet").mkdir()
    for k, rows in enumerate(("LIMIT", "OFFSET")):
        con.execute(f"COPY (SELECT * FROM events ORDER BY event_id {rows} {cut}) TO '{tmp_path}/events.parquet/{k}.parquet'")
    got, want = queries()[name](spark, str(tmp_path)).toPandas(), con.sql(oracle_sql()[name]).df()
    by = list(want.columns[:2])
    assert got[list(want.columns)].sort_values(by).values.tolist() == want.sort_values(by).values.tolist()


def test_values_at_stations_are_not_shuffled(spark):
    """No aggregate and no shuffle follows the join of fields and stations, whose rows are their product."""
    fields = spark.createDataFrame([("m", i, [float(10 * i + j) for j in range(4)]) for i in range(4)], "model string, lat_i int, vals array<double>")
    places = spark.createDataFrame([("a", 75.0, 45.0)], "station string, lat double, lon double")
    top = plan(stations.to_stations(fields, stations.corners(places, 4, 4, 90.0, -30.0), ["model"])).split("Join")[0]
    assert "Aggregate" not in top and "Exchange" not in top


def test_values_at_stations_with_gaps(spark):
    """Against a plain loop: fields without a row, rows without a cell, stations on rows, columns and edges, more fields than one share."""
    rng = np.random.default_rng(6)
    grids = {m: {i: [None if rng.random() < 0.1 else float(rng.normal()) for _ in range(6)] for i in range(5) if rng.random() < 0.8} for m in range(30)}
    places = {k: (float(rng.uniform(-35, 35)), float(rng.uniform(-180, 360))) for k in range(40)} | {100: (30.0, 0.0), 101: (-30.0, 359.0), 102: (15.0, 60.0), 103: (0.0, -60.0), 104: (-30.0, 300.0), 105: (31.0, 0.0)}
    fields = spark.createDataFrame([(m, i, v) for m, g in grids.items() for i, v in g.items()], "model int, lat_i int, vals array<double>")
    at = spark.createDataFrame([(k, *p) for k, p in places.items()], "station int, lat double, lon double")
    want = {}
    for m, g in grids.items():
        for k, (lat, lon) in places.items():
            y, x = (30 - lat) / 15, lon % 360 / 60
            i, j = min(max(int(np.floor(y)), 0), 3), int(np.floor(x)) % 6
            cells = [(g[i + a][(j + b) % 6], (y - i if a else 1 - y + i) * (x - np.floor(x) if b else 1 - x + np.floor(x))) for a in (0, 1) for b in (0, 1) if i + a in g]
            if 0 <= y <= 4 and cells:
                known = [v * w for v, w in cells if v is not None]
                want[m, k] = None if not known or any(v is None and w > 0 for v, w in cells) else sum(known)
    got = {(r.model, r.station): r.value for r in stations.to_stations(fields, stations.corners(at, 5, 6, 30.0, -15.0), ["model"]).collect()}
    assert set(got) == set(want) and all(got[k] == (v if v is None else pytest.approx(v, abs=1e-12)) for k, v in want.items())
