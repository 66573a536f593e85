"""Periodic runs of words by online dyadic square catching.

Words come in a stream. On level ``L``, a power of two, every completed block of ``L`` words is a catcher. Each appended
word makes one suffix comparison a level: the suffix of ``L`` words that it ends starts ``q`` words after a block's
start, ``L <= q < 2 L``, and a fingerprint tells whether it repeats the block of that one live catcher. Two neighbouring
blocks that repeat at the same distance ``q`` catch a square; it lives on while further blocks do so. Caught squares are
merged: those inside a run of a smaller period belong to it, the others are compared word by word to both sides, which
gives the run. A run of at least four periods ``q`` always holds two such blocks of the level ``L <= q < 2 L``, so that
none is missed. Fingerprints are checked in full; should one be wrong, the stream is read again with another seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from veriskill.llm.common import column, slices, table

#: Odd factors of the fingerprints.
ODD1, ODD2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Least exponent and length of a run.
EXPONENT, SHORTEST = 4, 6
#: Words appended at a time; rows and bytes of documents read together.
STRIDE, ROWS, SIZE = 1 << 20, 5000, 1 << 22
RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of pairs."""
    x = a * ODD1
    x += b
    x ^= x >> np.uint64(29)
    x *= ODD2
    x ^= x >> np.uint64(32)
    return x


class Level:
    """Catchers of one block length, and the squares they have caught."""

    def __init__(self, length: int):
        self.length = length
        self.names = np.zeros(0, np.uint64)  # of suffixes that wait for the row of their block to fill
        self.block: np.uint64 | None = None  # the live catcher
        self.row = 0
        self.since = np.full(length, -1, np.int64)  # for each distance, the first of the blocks that repeat without a gap
        self.caught: list[np.ndarray] = []

    def append(self, names: np.ndarray) -> None:
        """Fingerprints of the suffixes that the appended words end. Row r of suffixes meets the catcher r - 1."""
        length = self.length
        names = np.concatenate([self.names, names]) if len(self.names) else names
        rows = len(names) // length
        self.names = names[rows * length :].copy()
        if not rows:
            return
        grid = names[: rows * length].reshape(rows, length)
        blocks = np.concatenate([[self.block], grid[:-1, 0]]) if self.block is not None else grid[:-1, 0]
        grid = grid[rows - len(blocks) :]
        first, self.block = self.row + rows - len(blocks) - 1, names[(rows - 1) * length]
        self.row += rows
        if len(blocks):
            self._compare(grid == blocks[:, None].astype(np.uint64), first)

    def _compare(self, same: np.ndarray, first: int) -> None:
        """``same[k, j]``: block ``first + k`` comes again ``length + j`` words later."""
        before = np.vstack([self.since >= 0, same[:-1]])
        begun_at, begun = np.nonzero((same & ~before).T)
        ended_at, ended = np.nonzero((~same & before).T)
        # in each column begins and ends alternate; a square that was alive before comes first
        column_of = np.concatenate([np.flatnonzero(self.since >= 0), begun_at])
        begins = np.concatenate([self.since[self.since >= 0], begun + first])
        order = np.lexsort([begins, column_of])
        column_of, begins = column_of[order], begins[order]
        alive = np.flatnonzero(same[-1])
        ends = np.concatenate([ended + first, np.full(len(alive), first + len(same))])
        end_order = np.lexsort([ends, np.concatenate([ended_at, alive])])
        ends = ends[end_order]
        over = np.ones(len(ends), bool)
        over[end_order >= len(ended)] = False
        self.since[:] = -1
        self.since[column_of[~over]] = begins[~over]
        self._keep(column_of[over], begins[over], ends[over])

    def _keep(self, columns: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        two = ends - begins >= 2
        if two.any():
            self.caught.append(np.stack([self.length + columns[two], begins[two] * self.length, ends[two] * self.length]))

    def close(self) -> np.ndarray:
        """Period, start and end of the blocks of every square caught."""
        if len(self.names):
            fill = np.zeros(self.length - len(self.names), np.uint64)
            self.append(fill)
        left = np.flatnonzero(self.since >= 0)
        self._keep(left, self.since[left], np.full(len(left), self.row - 1))
        return np.concatenate(self.caught, axis=1) if self.caught else np.zeros((3, 0), np.int64)


class SquareCatcher:
    """Runs of a stream of whole numbers. Words appended must start and end with one that occurs nowhere else."""

    def __init__(self, longest: int, seed: int = 0):
        """``longest``: words of the longest text, which bounds the levels."""
        self.seed = np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        self.levels = [Level(1 << k) for k in range(max(1, (longest // EXPONENT).bit_length()))]
        self.tails = [np.zeros(0, np.uint64) for _ in self.levels]
        self.words: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        self.words.append(words)
        names = _joined(words.astype(np.uint64) + self.seed, np.full(len(words), self.seed | np.uint64(1)))
        for k, level in enumerate(self.levels):
            level.append(names)
            if level is self.levels[-1]:
                break
            # a suffix of twice the length is the suffix that its first half ends, then this one
            held = np.concatenate([self.tails[k], names])
            self.tails[k] = held[max(0, len(held) - level.length) :]
            names = _joined(held[: -level.length], held[level.length :]) if len(held) > level.length else names[:0]

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Start, length and period of all runs by period; None if a fingerprint was wrong."""
        x = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        found = np.zeros((3, 0), np.int64)
        for level in self.levels:
            period, start, end = level.close()
            inside = _inside(found, start, end + period)
            period, start, end = period[~inside], start[~inside], end[~inside]
            for k in range(len(period)):
                if not np.array_equal(x[start[k] : end[k]], x[start[k] + period[k] : end[k] + period[k]]):
                    return None
            start, end = _stretched(x, period, start, end, level.length)
            length = end - start + period
            enough = length >= np.maximum(SHORTEST, EXPONENT * period)
            found = np.concatenate([found, np.stack([start, length, period])[:, enough]], axis=1)
        return found[0], found[1], found[2]


def _inside(found: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run found so far holds the stretch."""
    if not found.shape[1]:
        return np.zeros(len(start), bool)
    order = np.argsort(found[0], kind="stable")
    furthest = np.maximum.accumulate((found[0] + found[1])[order])
    at = np.searchsorted(found[0][order], start, side="right") - 1
    return (at >= 0) & (furthest[np.maximum(at, 0)] >= end)


def _stretched(x: np.ndarray, period: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of words that equal the word a period later, grown by less than ``most`` to both sides."""
    start, end = start.copy(), end.copy()
    for bound, step, side in ((start, -1, -1), (end, 1, 0)):
        if most > 64:
            for k, q in enumerate(period.tolist()):
                b = int(bound[k])
                lo, hi = (max(0, b - most), b) if step < 0 else (b, min(len(x) - q, b + most))
                other = np.flatnonzero(x[lo:hi] != x[lo + q : hi + q])
                bound[k] = (hi - lo if not len(other) else other[0] if step > 0 else hi - lo - 1 - other[-1]) * step + b
            continue
        alive = np.arange(len(period))
        while len(alive):
            here = bound[alive] + side
            alive = alive[x[here] == x[here + period[alive]]]
            bound[alive] += step
    return start, end


def runs_of(words: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and period of all runs of texts that lie one after the other, by text, start, period.

    Texts whose lengths have the same power of two make one stream, divided by words of their own.
    """
    starts = np.cumsum(lengths) - lengths
    divider = int(words.max(initial=0)) + 1
    out = []
    sizes = np.frompyfunc(int.bit_length, 1, 1)(lengths.astype(object)).astype(np.int64) if len(lengths) else lengths
    for size in np.unique(sizes[lengths >= SHORTEST]).tolist():
        texts = np.flatnonzero((sizes == size) & (lengths >= SHORTEST))
        n = lengths[texts]
        begins = np.cumsum(n + 1) - n  # in the stream, after a divider each
        stream = np.empty(int(n.sum()) + len(n) + 1, np.int64)
        stream[np.concatenate([begins - 1, [len(stream) - 1]])] = divider + np.arange(len(n) + 1)
        inside = np.ones(len(stream), bool)
        inside[np.concatenate([begins - 1, [len(stream) - 1]])] = False
        stream[inside] = words[np.repeat(starts[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        found, seed = None, 0
        while found is None:
            catcher = SquareCatcher(int(n.max()), seed)
            for k in range(0, len(stream), stride):
                catcher.append(stream[k : k + stride])
            found, seed = catcher.close(), seed + 1
        at = np.searchsorted(begins, found[0], side="right") - 1
        out.append((texts[at], found[0] - begins[at], found[1], found[2]))
    text, start, length, period = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    order = np.lexsort([period, start, text])
    return text[order], start[order], length[order], period[order]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and their number in each. Blanks are space and \\x09 to \\x0D; null has no words."""
    lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(upto[np.concatenate([[0], ends])])


def _find(batch: pa.RecordBatch, rewrite: Callable[[object, int], np.ndarray | None] | None) -> pa.RecordBatch:
    words, lengths = _split(batch.column(1))
    starts = np.cumsum(lengths) - lengths
    places = np.arange(len(words))
    if rewrite:
        for k, (key, n) in enumerate(zip(batch.column(0).to_pylist(), lengths.tolist(), strict=True)):
            if n and (order := rewrite(key, n)) is not None:
                places[starts[k] : starts[k] + n] = starts[k] + order
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[places]
    text, start, length, period = runs_of(numbers, lengths)
    # covered from the second period on: up at its start, down at its end
    deep = np.zeros(len(words) + 1, np.int64)
    np.add.at(deep, starts[text] + start + period, 1)
    np.add.at(deep, starts[text] + start + length, -1)
    kept = np.cumsum(deep)[:-1] == 0
    upto = np.concatenate([[0], np.cumsum(kept)])
    offsets = upto[np.concatenate([starts, [len(words)]])]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(places[kept]))), pa.scalar(" ", pa.large_string()))
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(lengths) + 1)), pa.int32()), runs)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int64)), listed, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs array<struct<start, length, period>>, collapsed``.

    A run is a stretch of consecutive words, not longer on either side, with smallest period ``period`` (words a period
    apart are identical) and at least six words and four periods. Runs are sorted by start, then period. ``collapsed``
    joins by one space the words that no run holds after its first period. Null and blank texts have no words, no runs
    and the empty ``collapsed``. Repeated rows give equal rows. A very long text is read whole, in time that grows by its
    length times the logarithm of that. ``rewrite`` may give, for an id and a number of words, the numbers of the words
    to read instead. Other columns are ignored; an empty table stays empty.
    """
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"]]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ROWS, SIZE):
                yield _find(part, rewrite)

    return rows.mapInArrow(find, schema)


def repeated_tail(key: object, n: int) -> np.ndarray | None:
    """In a tenth of the documents, by crc32 of the id, a stretch repeats to the end. A null id is not among them."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.less) div longest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
