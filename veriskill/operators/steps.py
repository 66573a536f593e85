"""Storms followed through their fields step by step, all storms of a task at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps whose fields are held at a time.
CHUNK = 256

#: Fields of equal shape: places of their rows in the frame, ``lat`` and ``lon`` of each (ascending), and values by name.
Fields = tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]


def cell_fields(names: Sequence[str]) -> Callable[[pd.DataFrame], Iterator[Fields]]:
    """Fields of rows whose columns ``lat, lon`` and ``names`` list the cells; a cell that is missing is NaN, one that occurs twice the mean."""

    def field(y: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
        flat, ok = i * len(x) + j, ~np.isnan(v)
        total, n = (np.bincount(flat[ok], w, len(y) * len(x)) for w in (v[ok], None))
        with np.errstate(invalid="ignore"):
            return (total / n).reshape(len(y), len(x))

    def make(frame: pd.DataFrame) -> Iterator[Fields]:
        shapes: dict[tuple[int, int], list] = {}
        for r, (lat, lon, *values) in enumerate(zip(*(frame[c] for c in ("lat", "lon", *names)), strict=True)):
            (y, i), (x, j) = (np.unique(np.asarray(a, float), return_inverse=True) for a in (lat, lon))
            # A height with a gap is not searched.
            grids = [field(y, x, i, j, np.asarray(v, float) if c != "z850" or not np.isnan(np.asarray(v, float)).any() else np.full(len(i), np.nan)) for c, v in zip(names, values, strict=True)]
            shapes.setdefault((len(y), len(x)), []).append((r, y, x, *grids))
        for rows in shapes.values():
            at, lat, lon, *values = map(np.array, zip(*rows, strict=True))
            yield at, lat, lon, dict(zip(names, values, strict=True))

    return make


class Tracks:
    """The last positions of the storms of a task. A storm is numbered at its first step, ``n`` counts its positions."""

    def __init__(self, keep: int) -> None:
        self.number: dict[tuple, int] = {}
        self.at, self.n, self.fails, self.reason = np.empty((0, 2, keep)), np.empty(0, int), np.empty(0, int), np.empty(0, object)

    def numbers(self, keys: list[tuple], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        known = len(self.n)
        s = np.array([self.number.setdefault(k, len(self.number)) for k in keys], int)
        more = len(self.number) - known
        if more:
            at = np.zeros((more, *self.at.shape[1:]))
            at[s[s >= known] - known, :, -1] = np.stack([lat, lon], axis=1)[s >= known]
            self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, np.ones(more, int)])
            self.fails, self.reason = np.concatenate([self.fails, np.zeros(more, int)]), np.concatenate([self.reason, np.full(more, None, object)])
        return s

    def add(self, s: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> None:
        self.at[s] = np.concatenate([self.at[s][:, :, 1:], np.stack([lat, lon], axis=1)[:, :, None]], axis=2)
        self.n[s] += 1


def follow(
    crops: DataFrame, starts: DataFrame, by: Sequence[str], lead: str, names: Sequence[str], keep: int, columns: dict[str, str], reason: str | None,
    step: Callable[[Tracks, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]],
    field: Callable[[pd.DataFrame], Iterator[Fields]] | None = None,
) -> DataFrame:
    """Rows of ``by, lead`` and ``columns`` for every step that ``step`` accepts, from storms' first positions ``starts`` (``lat, lon``).

    ``crops`` has a row for each cell, or, with ``field``, a row for each step, from which ``field`` makes the cells in
    the task that follows the storm, so that they are never shuffled. A task takes its rows by lead, in chunks: ``step``
    gets the storms' numbers and fields of one lead, adds positions to the tracks and returns which of them it accepts,
    with their values; a storm with a reason is over. Tasks keep the last positions of their storms and the values of
    accepted steps, but no fields. ``reason`` adds the reason of each storm's end, itself where there is none.
    """
    types = {f.name: f.dataType.simpleString() for f in crops.schema if f.name in by}
    schema = ", ".join(f"`{c}` {t}" for c, t in (types | {lead: "long"} | columns | ({"reason": "string"} if reason else {})).items())
    made = field or cell_fields(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracks, found = Tracks(keep), []
        for frame in frames:
            for now, rows in frame.groupby(lead, sort=True):
                s = tracks.numbers(list(zip(*(rows[c] for c in by), strict=True)), rows["start_lat"].to_numpy(float), rows["start_lon"].to_numpy(float))
                for k in range(0, len(rows), CHUNK):
                    here = s[k : k + CHUNK]
                    live = tracks.reason[here] == None  # noqa: E711
                    for at, lat, lon, values in made(rows.iloc[k : k + CHUNK][live]) if live.any() else ():
                        mine = here[live][at]
                        good, got = step(tracks, mine, lat, lon, values)
                        found.append((mine[good], np.full(int(good.sum()), int(now)), *(got[c] for c in columns)))
        if not found:
            return
        s, *values = (np.concatenate(v) for v in zip(*found, strict=True))
        storms = pd.DataFrame(list(tracks.number), columns=list(by))
        for k in range(0, len(s), 1 << 16):
            part = storms.iloc[s[k : k + (1 << 16)]].reset_index(drop=True).assign(**{c: v[k : k + (1 << 16)] for c, v in zip((lead, *columns), values, strict=True)})
            yield part.assign(reason=[r or reason for r in tracks.reason[s[k : k + (1 << 16)]]]) if reason else part

    begun = crops.join(starts.select(*by, F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon")), list(by))
    begun = begun.repartition(int(crops.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)  # few bytes, much work: not to be coalesced
    if field is None:
        cells = F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("lat", "lon", *names))))
        begun = begun.groupBy(*by, lead, "start_lat", "start_lon").agg(cells.alias("_c")).select(*by, lead, "start_lat", "start_lon", *(F.col(f"_c.{c}").alias(c) for c in ("lat", "lon", *names)))
    return begun.sortWithinPartitions(lead).mapInPandas(run, schema)
