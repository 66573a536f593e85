"""A Spark data source of field trees in NPY files, with pushed filters.

Folders ``<YYYY>/<YYYY-MM-DD>`` below any path hold files ``<HH:MM:SS>-<variable>[-<level>].npy`` (or ``-`` for ``:``),
one field of two dimensions each. Filters on time, variable and level choose folders and files before anything is
opened; filters on ``lat_i`` choose the rows of a file, which are read by their offset.
"""

from __future__ import annotations

import datetime as dt
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from veriskill.operators.chunks import in_groups

SCHEMA = "valid_time timestamp, variable string, level_hpa int, lat_i int, vals array<float>"
_FILE = re.compile(r"(\d{2})[-:](\d{2})[-:](\d{2})-([A-Za-z0-9_]+?)(?:-([0-9]+)(?:\.0+)?)?\.npy")
_COMPARE: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Bytes of the files of one partition.
PART_BYTES = 1 << 27


@dataclass
class Files(InputPartition):
    """Path, time, variable and level of each file."""

    files: list[tuple[str, dt.datetime, str, int | None]]


def _utc(x: dt.datetime) -> dt.datetime:
    return x.astimezone(dt.timezone.utc) if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)


class NpyReader(DataSourceReader):
    def __init__(self, path: str, flip: bool):
        self.path, self.flip = path, flip
        self.tests: dict[str, list[tuple[str, object]]] = {"valid_time": [], "variable": [], "level_hpa": [], "lat_i": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons with a value and lists of values are applied here in full; Spark gets the others back."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if name in self.tests and len(f.attribute) == 1 and (type(f) in _COMPARE or isinstance(f, In)) and all(v is not None for v in values):
                values = tuple(_utc(v) for v in values) if name == "valid_time" else tuple(values)
                self.tests[name].append((type(f).__name__, values))
            else:
                yield f

    def passes(self, name: str, value: object) -> bool:
        """Whether a value passes all filters on its column; a missing one passes none."""
        return all(value is not None and (value in values if kind == "In" else _COMPARE[_KINDS[kind]](value, values[0])) for kind, values in self.tests[name])

    def _overlaps(self, low: dt.datetime, high: dt.datetime) -> bool:
        """Whether a time in [low, high) can pass."""
        ends = {"EqualTo": lambda v: low <= v[0] < high, "In": lambda v: any(low <= x < high for x in v), "GreaterThan": lambda v: high > v[0], "GreaterThanOrEqual": lambda v: high > v[0], "LessThan": lambda v: low < v[0], "LessThanOrEqual": lambda v: low <= v[0]}
        return all(ends[kind](values) for kind, values in self.tests["valid_time"])

    def _folders(self, fs: pafs.FileSystem, at: str) -> Iterator[tuple[str, int, tuple]]:
        """Path, size and key of the files that pass; folders of years and days that can't are not listed."""
        day = re.search(r"/(\d{4})-(\d{2})-(\d{2})$", at)
        for info in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda i: i.path):
            name = info.base_name
            if info.type == pafs.FileType.Directory:
                begin = re.fullmatch(r"(\d{4})(?:-(\d{2})-(\d{2}))?", name)
                try:
                    low = dt.datetime(*(int(x or 1) for x in begin.groups()), tzinfo=dt.timezone.utc) if begin else None
                except ValueError:
                    low = None
                if low is None or self._overlaps(low, low.replace(year=low.year + 1) if len(name) == 4 and low.year < 9999 else low + dt.timedelta(days=1)):
                    yield from self._folders(fs, info.path)
            elif day and (m := _FILE.fullmatch(name)):
                try:
                    time = dt.datetime(*map(int, (*day.groups(), *m.groups()[:3])), tzinfo=dt.timezone.utc)
                except ValueError:
                    continue
                level = int(m[5]) if m[5] else None
                if self.passes("valid_time", time) and self.passes("variable", m[4]) and self.passes("level_hpa", level):
                    yield info.path, info.size, (time, m[4], level)

    def partitions(self) -> Sequence[Files]:
        fs, root = _opened(self.path)
        parts, held = [Files([])], 0
        for path, size, key in self._folders(fs, root.rstrip("/")):
            if held + size > PART_BYTES and parts[-1].files:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append((path, *key))
            held += size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs = _opened(self.path)[0]
        for path, time, variable, level in partition.files:
            with fs.open_input_file(path) as file:
                version = np.lib.format.read_magic(file)
                shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
                if len(shape) != 2 or kind.hasobject:
                    raise ValueError(f"{path} has {len(shape)} dimensions of {kind}, not two of numbers")
                start, (n, width) = file.tell(), shape
                wanted = np.array([i for i in range(n) if self.passes("lat_i", i)], np.int64)
                if not len(wanted):
                    continue
                rows = n - 1 - wanted if self.flip else wanted
                first, last = int(rows.min()), int(rows.max())
                if by_column:
                    field = np.frombuffer(file.read(), kind).reshape(width, n).T
                else:
                    file.seek(start + first * width * kind.itemsize)
                    field = np.frombuffer(file.read((last + 1 - first) * width * kind.itemsize), kind).reshape(-1, width)
                    rows = rows - first
                flat = field[rows].astype(np.float32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                same = lambda v, t: pa.array([v] * len(wanted), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(time, pa.timestamp("us", "UTC")), same(variable, pa.string()), same(level, pa.int32()), pa.array(wanted, pa.int32()), lists], ["valid_time", "variable", "level_hpa", "lat_i", "vals"])


_KINDS = {k.__name__: k for k in _COMPARE}


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_fields"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], self.options.get("flip", "false").lower() == "true")


def npy_table(spark: SparkSession, path: str, dataset: str, flip: bool = False) -> DataFrame:
    """[S1, S4] A row for each latitude row of a tree of NPY files, like :func:`~veriskill.sources.readers.npy_fields`, but by pushed filters.

    Times of files are UTC; NaN becomes null; ``flip`` numbers rows from the last. Files of other names are left out. The
    path is one that pyarrow opens on all machines (a shared folder, or an object store); elsewhere use ``npy_fields``.
    Sets ``spark.sql.python.filterPushdown.enabled`` in the session, without which Spark reads all and filters itself.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_fields").option("flip", str(flip).lower()).load(path).withColumn("dataset", F.lit(dataset))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def touch(names: DataFrame, path: str) -> DataFrame:
    """A file of one byte below ``path`` for each value of the column ``name`` (Spark lists no empty ones); gives the names, and writes as it is read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs.create_dir(f"{root.rstrip('/')}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root.rstrip('/')}/{name}") as file:
                    file.write(b"x")
            yield batch

    return names.select("name").mapInArrow(write, "name string")


def save_npy(cells: DataFrame, path: str, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Fields of cells (``variable, level_hpa, lat_i, lon_i``) as a tree of NPY files; gives ``path, cells`` of each, and writes as it is read.

    A field is one Arrow group. Cells that are not there are NaN; a file is written under another name, then renamed, so
    that a task that runs again replaces it.
    """
    rows = cells.select(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy/yyyy-MM-dd/HH-mm-ss").alias("at"), F.concat_ws("-", "variable", "level_hpa").alias("channel"), F.col("lat_i").cast("int"), F.col("lon_i").cast("int"), F.col(value).cast("double").alias("value"))

    def write(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        fs, root = _opened(path)
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            i, j = (batch.column(k).to_numpy(zero_copy_only=False)[a:b] for k in (2, 3))
            field = np.full((i.max() + 1, j.max() + 1), np.nan, np.float32)
            field[i, j] = batch.column(4).to_numpy(zero_copy_only=False)[a:b]
            name = f"{root.rstrip('/')}/{batch.column(0)[a].as_py()}-{batch.column(1)[a].as_py()}"
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{name}.part") as file:
                np.lib.format.write_array(file, field, allow_pickle=False)
            fs.move(f"{name}.part", f"{name}.npy")
            out.append((f"{name}.npy", b - a))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["path", "cells"])

    return in_groups(rows, ["at", "channel"], write, StructType().add("path", "string").add("cells", "long"))
