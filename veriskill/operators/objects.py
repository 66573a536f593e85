"""Connected objects on grids: labels, extents, severity, tracking over days and case extracts."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from veriskill.operators.chunks import in_groups
from veriskill.operators.components import connected, least_reached
from veriskill.operators.events import greedy
from veriskill.sources.scratch import freed, written


#: Days, rows and columns of a tile, with a day axis and without.
TILES = {True: (16, 32, 64), False: (1, 128, 128)}


def _steps(reach: tuple[int, int, int], corners: bool) -> list[tuple[int, int, int]]:
    """Half of the neighbours of a cell; the others are the other way round."""
    each = itertools.product(*(range(-r, r + 1) for r in reach))
    return [s for s in each if s > (0, 0, 0) and (corners or sum(map(abs, s)) == 1)]


def _label_tiles(batch: pa.RecordBatch, starts: np.ndarray, size: tuple[int, int, int], steps: Sequence[tuple[int, int, int]]) -> pa.RecordBatch:
    """Cells of whole tiles with the number of their component and its first cell. Columns: tile, day, row, column, others."""
    at = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3, 6)]
    tile = np.repeat(np.arange(len(starts)), np.diff([*starts, batch.num_rows]))
    code = tile
    for x, n in zip(at, size, strict=True):
        code = code * (n + 2) + (x % n + 1)  # a margin, so that no step leads into another row
    code, cells, places = np.unique(code, return_index=True, return_inverse=True)
    ends = []
    for step in steps:
        move = 0
        for d, n in zip(step, size, strict=True):
            move = move * (n + 2) + d
        other = np.searchsorted(code, code + move)
        other[other == len(code)] = 0
        hit = np.flatnonzero(code[other] == code + move)
        ends.append((hit, other[hit]))
    first = least_reached(len(code), *(np.concatenate(x) for x in zip(*ends, strict=True)))[places]
    number = (TaskContext.get().partitionId() << 40) + _numbers(len(code)) + first
    return pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(number), *(pa.array(x[cells[first]]) for x in at)], [*batch.schema.names[3:], "_comp", "_d0", "_i0", "_j0"])


_used: dict[int, int] = {}


def _numbers(n: int) -> int:
    """The first of ``n`` numbers that this task has not given yet."""
    task = TaskContext.get().taskAttemptId()
    for other in [t for t in _used if t != task]:
        del _used[other]
    begun = _used.get(task, 0)
    _used[task] = begun + n
    return begun


def label(cells: DataFrame, by: Sequence[str], day: str | None = None, diagonal: bool = True) -> DataFrame:
    """[O1, O2] Cells with ``label``: 4- or 8-connected within each group, or 6- or 26-connected over ``day`` too (an integer).

    Two levels: tiles of days, rows and columns are labelled inside, many at a time in Arrow tasks, after one shuffle of
    the cells. Components that touch across tile faces are the nodes of a far smaller graph, whose components are
    contracted. The label is the object's smallest (day,) row and column, padded with zeros; any whole numbers do. Labels
    of parts up to nine (five) digits that are not negative sort like their numbers. A cell with null in a key or an
    index has no label and is left out; repeated cells stay.
    """
    size, where = TILES[day is not None], [*([day] if day else []), "lat_i", "lon_i"]
    others = [c for c in cells.columns if c not in where]
    plain = {c: f"x{k}" for k, c in enumerate(others)}
    groups = [plain[c] for c in by]
    at = [F.col(day).cast("long") if day else F.lit(0).cast("long"), F.col("lat_i").cast("long"), F.col("lon_i").cast("long")]
    rows = cells.select(*(x.alias(n) for x, n in zip(at, ("_d", "_r", "_c"), strict=True)), *(column(c).alias(x) for c, x in plain.items())).dropna(subset=["_d", "_r", "_c", *groups])
    tile = [F.expr(f"({c} - pmod({c}, {n})) div {n}").alias(f"_t{k}") for k, (c, n) in enumerate(zip(("_d", "_r", "_c"), size, strict=True))]
    rows = rows.select(*tile, "*")
    steps = _steps((1 if day else 0, 1, 1), diagonal)
    schema = StructType(rows.schema.fields[3:])
    for name in ("_comp", "_d0", "_i0", "_j0"):
        schema = schema.add(name, "long")
    known = written(in_groups(rows, [*groups, "_t0", "_t1", "_t2"], lambda b, s: _label_tiles(b, s, size, steps), schema))
    edges = written(_across(known, groups, size, steps))
    joined = connected(edges)
    first = F.struct("_d0", "_i0", "_j0")
    # each component's smallest cell, over those that touch another tile's
    touched = known.join(edges.select(F.explode(F.array("a", "b")).alias("_comp")).distinct(), "_comp", "left_semi").groupBy("_comp").agg(F.min(first).alias("first"))
    touched = touched.join(joined.withColumnRenamed("node", "_comp"), "_comp", "left").withColumn("component", F.coalesce("component", "_comp"))
    least = touched.groupBy("component").agg(F.min("first").alias("least"))
    moved = written(touched.join(least, "component").select("_comp", "least"))
    freed(edges, None)
    freed(joined, None)
    name = lambda k, width: F.format_string(f"%0{width}d", F.coalesce(F.col("least")[k], F.col(k)))
    text = F.concat_ws("-", *([name("_d0", 9)] if day else []), name("_i0", 5), name("_j0", 5))
    real = dict(zip(where, ("_d", "_r", "_c") if day else ("_r", "_c"), strict=True)) | plain
    return known.join(moved, "_comp", "left").select(*(F.col(real[c]).cast(cells.schema[c].dataType).alias(c) for c in cells.columns), text.alias("label"))


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _across(known: DataFrame, by: Sequence[str], size: tuple[int, int, int], steps: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Pairs of components whose cells are neighbours in different tiles."""
    axes = ("_d", "_r", "_c")

    def leaves(step: tuple[int, int, int]) -> Column:
        out = F.lit(False)
        for c, d, n in zip(axes, step, size, strict=True):
            if d:
                out = out | (F.pmod(F.col(c), F.lit(n)) == (n - 1 if d > 0 else 0))
        return out

    def to(step: tuple[int, int, int]) -> Column:
        return F.struct(*((F.col(c) + d).alias(c) for c, d in zip(axes, step, strict=True)))

    gone = known.select(*by, F.col("_comp").alias("a"), F.explode(F.filter(F.array(*(F.when(leaves(s), to(s)) for s in steps)), lambda x: x.isNotNull())).alias("to")).select(*by, "a", "to.*")
    met = F.lit(False)  # cells that a step of another tile can reach
    for c, n in zip(axes, size, strict=True):
        met = met | (F.pmod(F.col(c), F.lit(n)).isin([0, n - 1]) if n > 1 else F.lit(False))
    return gone.join(known.where(met).select(*by, *axes, F.col("_comp").alias("b")), [*by, *axes]).select("a", "b").where("a <> b").distinct()


def large_objects(labelled: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """[O4] Cells of objects with at least that many cells."""
    n = labelled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return labelled.join(n.drop("_n"), [*by, "label"], "left_semi")


def object_stats(labelled: DataFrame, by: Sequence[str], value: Column, w: Column) -> DataFrame:
    """[O3, A30, A47] Extent, size, weighted centroid, severity and value range of each object."""
    return labelled.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("cells"), F.min("lat_i").alias("lat_min"), F.max("lat_i").alias("lat_max"), F.min("lon_i").alias("lon_min"), F.max("lon_i").alias("lon_max"),
        (F.sum(w * F.col("lat_i")) / F.sum(w)).alias("lat_mean"), (F.sum(w * F.col("lon_i")) / F.sum(w)).alias("lon_mean"), F.sum(w).alias("severity"), F.min(value).alias("value_min"), F.max(value).alias("value_max"))


def severest(labelled: DataFrame, day: str, value: Column, w: Column, min_days: int, top: int) -> DataFrame:
    """[T1, T2, A47, A48] The most severe objects that last long enough, with their peak day, ranked."""
    daily = labelled.groupBy("label", day).agg(F.sum(w).alias("area"), F.avg(value).alias("value_mean"), F.min(value).alias("value_min"), F.max(value).alias("value_max"))
    size = F.round("area", 9)  # equal areas tie whatever the order of their sums
    each = daily.groupBy("label").agg(F.count(F.lit(1)).alias("days"), F.sum("area").alias("severity"), F.max_by(day, F.struct(size, -F.col(day))).alias("peak_day"), F.max("area").alias("peak_area"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"))
    order = [F.desc(F.round("severity", 6)), F.asc("label")]
    best = each.where(F.col("days") >= min_days).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top rows


def largest_object(labelled: DataFrame, by: Sequence[str]) -> DataFrame:
    """[T5] The largest object of each group, the first label on ties."""
    n = labelled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("cells"))
    w = Window.partitionBy(*by).orderBy(F.desc("cells"), "label")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def coldest_cell(cells: DataFrame, by: Sequence[str], value: str, masked: str) -> DataFrame:
    """[T6, O9] Position of the lowest value, masked cells first."""
    key = F.struct((~F.col(masked)).alias("m"), F.col(value).alias("v"), "lat_i", "lon_i")
    return cells.groupBy(*by).agg(F.min(key).alias("k")).select(*by, F.col("k.lat_i").alias("lat_i"), F.col("k.lon_i").alias("lon_i"), F.col("k.v").alias(value))


def touching(labelled: DataFrame, box: Column, by: Sequence[str]) -> DataFrame:
    """[J27] Objects that touch the box, or all of a group if none does."""
    hit = labelled.groupBy(*by, "label").agg(F.max(F.when(box, 1).otherwise(0)).alias("_hit"))
    some = hit.withColumn("_any", F.max("_hit").over(Window.partitionBy(*by))).where("(_hit = 1) OR (_any = 0)").select(*by, "label")
    return labelled.join(some, [*by, "label"], "left_semi")


def day_matches(labelled: DataFrame, by: Sequence[str], day: str, min_overlap: float = 0.3) -> DataFrame:
    """[J16] Objects of one day and the next that share enough cells, one to one, the best overlap first. ``day`` is an integer."""
    size = labelled.groupBy(*by, day, "label").agg(F.count(F.lit(1)).alias("n"))
    before = labelled.select(*by, (F.col(day) + 1).alias(day), "lat_i", "lon_i", F.col("label").alias("prev"))
    shared = labelled.join(before, [*by, day, "lat_i", "lon_i"]).groupBy(*by, day, "prev", "label").agg(F.count(F.lit(1)).alias("overlap"))
    prev = size.select(*by, (F.col(day) + 1).alias(day), F.col("label").alias("prev"), F.col("n").alias("n_prev"))
    pairs = shared.join(size, [*by, day, "label"]).join(prev, [*by, day, "prev"])
    pairs = pairs.withColumn("iou", F.col("overlap") / (F.col("n") + F.col("n_prev") - F.col("overlap"))).where(F.col("overlap") / F.least("n", "n_prev") >= min_overlap)
    return greedy(pairs, [*by, day], ["prev"], ["label"], [("iou", False), ("overlap", False), ("prev", True), ("label", True)])


def tracked_objects(labelled: DataFrame, by: Sequence[str], day: str, min_overlap: float = 0.3, min_days: int = 1) -> DataFrame:
    """[O5, W15, A49] Chains of matched daily objects: start, end, days present and mean and largest area.

    Each object has one successor at most, so that chains are followed by doubling: every round an object's root
    becomes its root's root.
    """
    labelled = written(labelled.select(*by, day, "label", "lat_i", "lon_i"))
    matches = day_matches(labelled, by, day, min_overlap)
    node = lambda d, x: F.concat_ws("@", F.lpad((F.col(day) + d).cast("string"), 9, "0"), F.col(x))
    up = matches.select(*by, node(0, "label").alias("node"), node(-1, "prev").alias("root"))
    size = labelled.groupBy(*by, day, "label").agg(F.count(F.lit(1)).alias("area")).withColumn("node", node(0, "label"))
    roots = written(size.select(*by, "node").join(up, [*by, "node"], "left").select(*by, "node", F.coalesce("root", "node").alias("root")))
    while True:
        further = roots.select(*by, F.col("node").alias("root"), F.col("root").alias("_next"))
        new = written(roots.join(further, [*by, "root"], "left").select(*by, "node", F.col("root").alias("_old"), F.coalesce("_next", "root").alias("root")))
        moving = new.where("root <> _old").count()
        roots = freed(roots, new.drop("_old"))
        roots._written_to = new._written_to
        if not moving:
            break
    out = size.join(roots, [*by, "node"]).groupBy(*by, "root").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count(F.lit(1)).alias("days"), F.avg("area").alias("mean_area"), F.max("area").alias("max_area"))
    return out.where(F.col("days") >= min_days)


def peak_days(daily: DataFrame, by: Sequence[str], day: str, area: str) -> DataFrame:
    """[O9, A48] The day of the largest area, the first on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(area), day)
    return daily.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, day)


def place_box(lat: Column, lon: Column, height: float, width: float) -> list[Column]:
    """[O9] A box of fixed size around a centre, moved inside the poles; longitudes are normalised and may wrap."""
    south = F.least(F.greatest(lat - height / 2, F.lit(-90.0)), F.lit(90.0 - height))
    return [south.alias("south"), (south + height).alias("north"), F.pmod(lon - width / 2, F.lit(360.0)).alias("west"), F.pmod(lon + width / 2, F.lit(360.0)).alias("east")]


def map_extract(cells: DataFrame, peaks: DataFrame, by: Sequence[str], day: str, box: Column) -> DataFrame:
    """[O10] Cells of each group's peak day inside the box."""
    return cells.where(box).join(peaks, [*by, day], "left_semi")


def box_series(cells: DataFrame, box: Column, day: str, model: str, models: Sequence[str], value: str = "pred", truth: str = "truth", lat: str = "lat") -> DataFrame:
    """[A31] Cosine-weighted mean in the box for each day, a column for each model and the truth."""
    w = F.cos(F.radians(lat))
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))
    rows = cells.where(box)
    wide = rows.groupBy(day).pivot(model, list(models)).agg(mean(value))
    return wide.join(rows.groupBy(day).agg(mean(truth).alias("truth")), day)


def bias_table(cells: DataFrame, box: Column, lead: str, model: str, models: Sequence[str]) -> DataFrame:
    """[A32] Mean of forecasts less mean of truth for each lead, a column for each model."""
    return cells.where(box).groupBy(lead).pivot(model, list(models)).agg(F.avg("pred") - F.avg("truth"))
