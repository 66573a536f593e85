"""Detected centres as paths, and where a pressure track ends."""

from __future__ import annotations

import numpy as np

from veriskill.operators import detect
from veriskill.plans.registry import queries

DIR = "/root/testdata/sf0.01"


def plain_paths(points, radius, memory=2):
    """``(step, lat, lon)`` of one run to path numbers, nearest pair first."""
    paths, ids = [], {}
    for step in sorted({p[0] for p in points}):
        here = sorted(p for p in points if p[0] == step)
        near = []
        for k, p in enumerate(paths):
            for i, q in enumerate(here):
                km = 6371 * np.hypot(np.radians(q[1] - p[1]), np.radians(q[2] - p[2]))
                if 1 <= step - p[0] <= memory and km < (step - p[0]) * radius:
                    near.append((km, i, k))
        got = {}
        for _, i, k in sorted(near):
            if i not in got and k not in got.values():
                got[i] = k
        for i, q in enumerate(here):
            if i not in got:
                got[i] = len(paths)
                paths.append(None)
            paths[got[i]] = q
            ids[q] = got[i]
    return ids


def test_detection_paths(spark):
    centres = queries()["warm_core_detection"](spark, DIR).collect()
    place = lambda r: (r.step, 80.5 - 7.0 * r.lat_i, 10.0 * r.lon_i)
    want = {(run, *k): n for run in {r.run for r in centres} for k, n in plain_paths([place(r) for r in centres if r.run == run], 2500.0).items()}
    got = {(r.run, *place(r)): r.path_id for r in queries()["detection_paths"](spark, DIR).collect()}
    assert got == want and len(got) == len(centres) and len(set(got.values())) > 3


def test_short_paths_are_left_out(spark):
    rows = [("r", s, 10.0 + s, 120.0) for s in range(4)] + [("r", 1, -30.0, 10.0)]
    df = spark.createDataFrame(rows, "run string, step int, lat double, lon double")
    assert detect.centre_paths(df, ["run"], least=2).count() == 4 and detect.centre_paths(df, ["run"]).count() == 5


def track(spark, rows, start, **more):
    crops = spark.createDataFrame([("s", *r) for r in rows], "sid string, lead_h long, lat double, lon double, msl double, u10 double, v10 double")
    starts = spark.createDataFrame([("s", *start)], "sid string, lat double, lon double")
    return [(r.lead_h, r.lat, r.lon) for r in detect.minimum_pressure_track(crops, starts, ["sid"], **more).orderBy("lead_h").collect()]


def test_ends_of_pressure_tracks(spark):
    step = lambda k, lat, lon, msl=100_000.0, wind=20.0: (6 * k, lat, lon, msl, wind, 0.0)
    assert track(spark, [step(1, 60.0, 4.5), step(1, 60.0, 0.0, 100_100.0)], (60.0, 0.0), lats=(-90, 90)) == [(6, 60.0, 4.5)]  # a box is wider in degrees near the poles
    assert track(spark, [step(1, 0.0, 359.0), step(2, 0.0, 1.0)], (0.0, 1.0)) == [(6, 0.0, 359.0), (12, 0.0, 1.0)]  # round the globe
    assert track(spark, [step(1, 1.0, 10.0), step(2, 1.0, 11.0, msl=101_201.0), step(3, 1.0, 12.0)], (0.0, 10.0)) == [(6, 1.0, 10.0)]
    assert track(spark, [step(1, 1.0, 10.0, wind=10.1)], (0.0, 10.0)) == []
    assert track(spark, [step(1, 1.0, 10.0, wind=1.0), step(1, 60.0, 60.0, 101_000.0)], (0.0, 10.0)) == [(6, 1.0, 10.0)]  # strong wind far off counts
    assert track(spark, [step(1, 1.0, 10.0, wind=1.0), step(1, 60.0, 60.0, 101_000.0)], (0.0, 10.0), wind_deg=5.0) == []
    assert track(spark, [step(1, 51.0, 10.0)], (50.0, 10.0)) == []  # out of bounds
    assert track(spark, [step(1, 2.4, 12.4), step(1, 0.0, 10.0, 100_500.0)], (0.0, 10.0)) == []  # in the box, beyond the radius
    assert track(spark, [step(1, 9.0, 10.0)], (0.0, 10.0)) == []  # nothing in the box
    assert track(spark, [step(k, 0.0, 10.0) for k in range(1, 60)], (0.0, 10.0)) == [(6 * k, 0.0, 10.0) for k in range(1, 42)]
    assert track(spark, [step(1, 1.0, 10.0), step(1, 2.0, 9.0), step(1, 2.0, 11.0)], (1.0, 10.0)) == [(6, 2.0, 9.0)]  # ties
