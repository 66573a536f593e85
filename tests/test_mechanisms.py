"""Labelling in tiles, matching in rounds, sliding percentiles and nearest fill against plain loops."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest

from veriskill.operators import components, events, grid, objects


def flood(cells, steps):
    left, found = set(cells), {}
    while left:
        stack, seen = [left.pop()], []
        while stack:
            c = stack.pop()
            seen.append(c)
            for s in steps:
                d = tuple(x + y for x, y in zip(c, s, strict=True))
                if d in left:
                    left.discard(d)
                    stack.append(d)
        for c in seen:
            found[c] = min(seen)
    return found


def steps(axes, corners):
    return [s for s in itertools.product((-1, 0, 1), repeat=axes) if any(s) and (corners or sum(map(abs, s)) == 1)]


@pytest.mark.parametrize("diagonal,share", [(True, 0.12), (False, 0.33)])
@pytest.mark.parametrize("origin", [(20250101, 0, 0), (-40, -70, -130), (0, 3_000_000, 10**12)])
def test_labels_over_days_cross_tiles(spark, diagonal, share, origin):
    rng = random.Random(7)
    box = (36, 70, 140)
    cells = {tuple(o + rng.randrange(n) for o, n in zip(origin, box, strict=True)) for _ in range(int(share * math.prod(box) / 3))}
    want = flood(cells, steps(3, diagonal))
    df = spark.createDataFrame([(*c, "x") for c in cells] + [(*next(iter(cells)), "again"), (None, 1, 1, "null")], "day long, lat_i long, lon_i long, tag string")
    got = objects.label(df, [], day="day", diagonal=diagonal).collect()
    assert len(got) == len(cells) + 1 and {(r.day, r.lat_i, r.lon_i): r.label for r in got} == {c: "%09d-%05d-%05d" % m for c, m in want.items()}
    assert len(set(want.values())) > 5


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels_of_groups_with_null_and_odd_names(spark, diagonal):
    rng = random.Random(8)
    cells = {(g, rng.randrange(-200, 200), rng.randrange(-200, 200)) for g in ("a", "b") for _ in range(9000)}
    got = objects.label(spark.createDataFrame([(*c, 1) for c in cells], "`_d` string, lat_i int, lon_i int, day int").withColumnRenamed("_d", "group"), ["group"], diagonal=diagonal).collect()
    want = {(g, *c): m for g in "ab" for c, m in flood({c[1:] for c in cells if c[0] == g}, steps(2, diagonal)).items()}
    assert {(r.group, r.lat_i, r.lon_i): r.label for r in got} == {c: "%05d-%05d" % m for c, m in want.items()}


def test_labels_of_nothing(spark):
    assert objects.label(spark.createDataFrame([], "day int, lat_i int, lon_i int"), [], day="day").count() == 0


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_connected_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(120)] + [(5, 5)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in near:
        seen, stack = {n}, [n]
        while stack:
            for d in near[stack.pop()] - seen:
                seen.add(d)
                stack.append(d)
        if min(seen) != n:
            want[n] = min(seen)
    got = components.connected(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_greedy_in_rounds(spark):
    rng = random.Random(3)
    pairs = [(g, rng.randrange(12), rng.randrange(12), rng.randrange(5) / 4, rng.randrange(3)) for g in range(20) for _ in range(60)]
    pairs = list({p[:3]: p for p in pairs}.values()) + [(99, k // 2, (k + 1) // 2, float(k), 0) for k in range(12)]
    got = events.greedy(spark.createDataFrame(pairs, "g int, a int, b int, iou double, n int"), ["g"], ["a"], ["b"], [("iou", False), ("n", True), ("a", True)]).collect()
    want, used = [], set()
    for p in sorted(pairs, key=lambda p: (p[0], -p[3], p[4], p[1], p[2])):
        if (p[0], "a", p[1]) not in used and (p[0], "b", p[2]) not in used:
            used |= {(p[0], "a", p[1]), (p[0], "b", p[2])}
            want.append(p)
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert events.greedy(spark.createDataFrame([], "g int, a int, b int, iou double"), ["g"], ["a"], ["b"], [("iou", False)]).count() == 0


@pytest.mark.parametrize("window", [1, 15, 401])
def test_sliding_percentiles(spark, window):
    rng = np.random.default_rng(4)
    start = dt.date(2015, 1, 1)
    rows = []
    for cell, years, share in (("a", 6, 0.7), ("b", 1, 0.05), (None, 2, 1.0), ("c", 3, 0.5)):
        for k in range(366 * years):
            if rng.random() < share:
                rows.append((cell, start + dt.timedelta(k), float(rng.integers(0, 30)) if cell == "c" else float(rng.normal())))
    rows += [("a", start, None), ("a", start, float("nan")), ("d", start, None)]
    got = {(r.cell, r.doy): (r.p90, r.p2_5, r.p50) for r in events.doy_percentile(spark.createDataFrame(rows, "cell string, day date, v double"), ["cell"], "v", [90, 2.5, 50], window=window).collect()}
    want, half = {}, min(window // 2, 183)
    for cell in ("a", "b", None, "c"):
        by_doy = {}
        for c, d, v in rows:
            if c == cell and v is not None and v == v:
                by_doy.setdefault(d.timetuple().tm_yday, []).append(v)
        for doy in range(1, 367):
            pool = [v for d in {(doy + o - 1) % 366 + 1 for o in range(-half, half + 1)} for v in by_doy.get(d, [])]
            if pool:
                want[cell, doy] = tuple(np.quantile(pool, [0.9, 0.025, 0.5]))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


@pytest.mark.parametrize("width", [30, None])
def test_nearest_fill_is_nearest_on_the_sphere(spark, width):
    rng = random.Random(6)
    rows, want = [], {}
    for field in range(4):
        holes = [(rng.randrange(19), rng.randrange(30), rng.randrange(2, 9)) for _ in range(5)]
        values = {}
        for i, j in itertools.product(range(19), range(30)):
            hole = field == 3 or any(abs(i - a) + min(abs(j - b), 30 - abs(j - b)) < r for a, b, r in holes) or (field == 2 and (i, j) != (4, 29))
            values[i, j] = None if hole else float(100 * i + j)
        step = 12.0 if width else 0.5
        lat = lambda i: 90 - 10 * i if width else 60 + 0.5 * i
        for (i, j), v in values.items():
            rows.append((field, i, j, float(lat(i)), v, "kept"))
            y = math.radians(lat(i))
            far = lambda a, b: round(math.sin((y - math.radians(lat(a))) / 2) ** 2 + math.cos(y) * math.cos(math.radians(lat(a))) * math.sin(math.radians((j - b) * step) / 2) ** 2, 12)  # noqa: B023, E731
            valid = [(far(a, b), a, min(abs(j - b), 30 - abs(j - b)) if width else abs(j - b), b) for (a, b), x in values.items() if x is not None]
            best = min(valid, default=None)
            want[field, i, j] = v if v is not None else best and values[best[1], best[3]]
    df = spark.createDataFrame(rows, "field int, lat_i int, lon_i int, lat double, value double, other string")
    got = grid.filled_with_nearest(df, ["field"], width=width, step=None if width else 0.5)
    assert got.columns == df.columns and {(r.field, r.lat_i, r.lon_i): r.value for r in got.collect()} == want
