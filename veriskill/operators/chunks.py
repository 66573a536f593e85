"""Whole groups of rows in Arrow chunks: one shuffle on the keys, then as many groups at a time as a chunk holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def group_starts(table: pa.RecordBatch, keys: Sequence[int]) -> np.ndarray:
    """Rows of a sorted batch that start a group; null equals null."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        col = table.column(k)
        if table.num_rows > 1:
            differ = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            gone = col.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= differ | (gone[1:] != gone[:-1])
    return np.flatnonzero(new)


def in_groups(rows: DataFrame, keys: Sequence[str], function: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: StructType, least: int = 100_000) -> DataFrame:
    """``function(batch, starts)`` over batches of whole groups of ``keys``, at least ``least`` rows each where there are so many.

    Rows of a group come together, in no order. A batch holds ``least`` rows and one group at most; groups must be of
    bounded size. Columns may have any name.
    """
    names, at = rows.columns, [rows.columns.index(k) for k in keys]
    plain, out = [f"c{k}" for k in range(len(names))], [f"o{k}" for k in range(len(schema))]

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < least:
                continue
            both = whole(held)
            starts = group_starts(both, at)
            held = [both]
            if len(starts) > 1:  # the last group may go on
                held = [both.slice(starts[-1])]
                yield named(both.slice(0, starts[-1]), starts[:-1])
        if held:
            both = whole(held)
            yield named(both, group_starts(both, at))

    def named(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        found = function(pa.RecordBatch.from_arrays(batch.columns, names), starts)
        return pa.RecordBatch.from_arrays(found.columns, out)

    dealt = rows.toDF(*plain)
    by = [plain[k] for k in at]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by) if by else dealt.coalesce(1)
    found = dealt.mapInArrow(run, StructType([StructField(n, f.dataType) for n, f in zip(out, schema, strict=True)]))
    return found.toDF(*(f.name for f in schema))
