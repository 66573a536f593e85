"""Zonal energy spectra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0


def zonal_spectrum(rows: DataFrame, keys: Sequence[str], lat: str = "lat", values: str = "vals") -> DataFrame:
    """[F8] ``keys, lat, power array<double>`` of latitude rows: |rfft / n|^2, doubled beyond wavenumber 0, times the circle's length.

    Rows of a batch with equal lengths are transformed together. A null row or value gives null.
    """
    kept = rows.select(*keys, F.col(lat).cast("double").alias("lat"), F.col(values).alias("_v"))
    names = [*keys, "lat", "power"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_v") + ", power array<double>"

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column("_v").to_pylist()
            lats = batch.column("lat").to_numpy(zero_copy_only=False)
            power: list[list[float] | None] = [None] * len(arrays)
            by_size: dict[int, list[int]] = {}
            for i, a in enumerate(arrays):
                if a and None not in a:
                    by_size.setdefault(len(a), []).append(i)
            for n, which in by_size.items():
                p = np.abs(np.fft.rfft(np.array([arrays[i] for i in which], float), axis=1) / n) ** 2
                p[:, 1:] *= 2
                p *= (2 * np.pi * RADIUS_M * np.cos(np.radians(lats[which])))[:, None]
                for i, x in zip(which, p.tolist(), strict=True):
                    power[i] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, "lat"]), pa.array(power, pa.list_(pa.float64()))], names)

    return kept.mapInArrow(transform, schema)


def mean_spectrum(spectra: DataFrame, by: Sequence[str], weighted: bool = False) -> DataFrame:
    """[F9, A46] ``by, k, power``: mean over the rows of a group, by the cosine of latitude if ``weighted``."""
    each = spectra.select(*by, "lat", F.posexplode("power").alias("k", "p"))
    w = F.cos(F.radians("lat")) if weighted else F.lit(1.0)
    return each.groupBy(*by, "k").agg((F.sum(w * F.col("p")) / F.sum(F.when(F.col("p").isNotNull(), w))).alias("power"))
