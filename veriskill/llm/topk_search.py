"""Exact top-k search of inner products by columnar branch and bound.

Vectors lie in blocks, one row for each dimension. Query groups meet every block of the other side in cells of a grid:
queries of a cell stay in memory, blocks stream past them. In a cell, products are summed one block of dimensions after
the other; what the rest can add is at most the product of the remaining norms of both sides. Candidates whose sum and
rest stay below the query's k-th best so far are left out, and once few are alive, only those go on, compacted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.llm.common import column, materialize, shuffle_partitions, table

#: Vectors of a stored block, of a chunk that is searched at once, and queries of a tile.
BLOCK, CHUNK, TILE = 1024, 4096, 256
#: Queries that a cell holds, their bytes, and blocks of candidates that make a cell of their own.
HELD, HELD_BYTES, LEAST_BLOCKS = 1 << 18, 1 << 26, 2
DIMS = 16
#: Below this share of living candidates a tile goes on with those alone.
FEW = 0.25
#: Vectors of a larger squared norm could give scores beyond a long.
LARGEST = 1 << 62
NO_SCORE = -(1 << 63)


def blocks_of(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Blocks of whole-number vectors of one length: ids, dimension-major components in the narrowest type, its size."""
    for batch in batches:
        vectors = batch.column(1)
        lengths = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        lengths[pc.or_(batch.column(0).is_null(), vectors.is_null()).to_numpy(zero_copy_only=False)] = -1
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[lengths >= 0]).tolist():
            rows = np.flatnonzero(lengths == d)
            for k in range(0, len(rows), BLOCK):
                part = rows[k : k + BLOCK]
                values = flat[starts[part][:, None] + np.arange(d)]
                with np.errstate(invalid="ignore", over="ignore"):
                    values = np.floor(scale * values)
                    fits = np.isfinite(values).all(1) & ((values * values).sum(1) < LARGEST)
                if fits.any():
                    yield _block(ids[part[fits]], values[fits].astype(np.int64))


def _block(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    most = int(np.abs(values).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    data = np.ascontiguousarray(values.T.astype(f"i{width}")).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([width], pa.int32()), pa.array([values.shape[1]], pa.int32())], ["ids", "data", "width", "d"])


def unpacked(ids: bytes, data: bytes, width: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, f"i{width}").reshape(d, len(own))


def _asked(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The queries among blocks, one row each."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, values = unpacked(**row)
            own = np.flatnonzero(ids % every == 0)
            if len(own):
                vectors = [v.tobytes() for v in np.ascontiguousarray(values[:, own].T)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(vectors, pa.binary()), *(pa.array([row[x]] * len(own), pa.int32()) for x in ("width", "d"))], ["id", "data", "width", "d"])


class Search:
    """The best ``k`` candidates so far of the queries of one cell, all of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), NO_SCORE, np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.norm = np.concatenate([np.sqrt((vectors[t : t + TILE].astype(float) ** 2).sum(1)) for t in range(0, len(ids), TILE)])

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        """``values`` has one row for each dimension. Dimensions of the greatest mass go first."""
        squares = values.astype(float) ** 2
        order = np.argsort(-squares.sum(1), kind="stable")
        norms = np.sqrt(squares.sum(0))
        most = float(norms.max(initial=0)) * float(self.norm.max(initial=0))
        kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64  # sums are exact
        cuts = [*range(0, len(order), DIMS), len(order)]
        rest = [np.sqrt(squares[order[x:]].sum(0)) * (1 + 1e-6) for x in cuts]
        slack = 1 + most * 1e-12  # with the factor above: rounding makes a bound too high, never too low
        c = values[order].astype(kind)
        for t in range(0, len(self.ids), TILE):
            part = slice(t, t + TILE)
            if (self.norm[part] * rest[0].max(initial=0) + slack < self.scores[part, -1]).all():
                continue
            q = self.q[part][:, order]
            left = [np.sqrt((q[:, x:].astype(float) ** 2).sum(1)) for x in cuts]
            self._tile(part, ids, c, q.astype(kind), cuts, left, rest, slack)

    def _tile(self, part: slice, ids: np.ndarray, c: np.ndarray, q: np.ndarray, cuts: list[int], left: list[np.ndarray], rest: list[np.ndarray], slack: float) -> None:
        limit = self.scores[part, -1]
        bounded = limit.min() > NO_SCORE
        sums = np.zeros((len(q), len(ids)), c.dtype)
        rows = kept = None
        for k in range(len(cuts) - 1):
            dims = slice(cuts[k], cuts[k + 1])
            if rows is None:
                sums += q[:, dims] @ c[dims]
            else:
                kept += (q[rows, dims] * c[dims].T[cols]).sum(1, dtype=c.dtype)
            if not bounded or k == len(cuts) - 2:
                continue
            if rows is None:
                alive = sums + np.outer(left[k + 1], rest[k + 1]) >= limit[:, None] - slack
                if alive.mean() < FEW:
                    rows, cols = np.nonzero(alive)
                    kept = sums[rows, cols]
            else:
                alive = kept + left[k + 1][rows] * rest[k + 1][cols] >= limit[rows] - slack
                rows, cols, kept = rows[alive], cols[alive], kept[alive]
            if rows is not None and not len(rows):
                return
        if rows is None:
            own = self.ids[part][:, None] == ids
            if not bounded and sums.shape[1] > self.k:
                others = np.where(own, -np.inf if sums.dtype.kind == "f" else NO_SCORE, sums)
                best = np.partition(others, sums.shape[1] - self.k, axis=1)[:, sums.shape[1] - self.k]
                limit = np.maximum(limit, np.where(np.isfinite(best), best, NO_SCORE).astype(np.int64) if best.dtype.kind == "f" else best)
            rows, cols = np.nonzero((sums >= limit[:, None]) & ~own)
            kept = sums[rows, cols]
        else:
            keep = (kept >= limit[rows]) & (self.ids[part][rows] != ids[cols])
            rows, cols, kept = rows[keep], cols[keep], kept[keep]
        self._merge(part, rows, kept.astype(np.int64), ids[cols])

    def _merge(self, part: slice, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        old, held = self.scores[part][touched], self.found[part][touched]
        there = old > NO_SCORE
        rows = np.concatenate([rows, np.repeat(touched, there.sum(1))])
        scores, ids = np.concatenate([scores, old[there]]), np.concatenate([ids, held[there]])
        order = np.lexsort([ids, -scores, rows])
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        rows, place = rows[best] + part.start, place[best]
        self.scores[rows, place], self.found[rows, place] = scores[best], ids[best]

    def results(self) -> pa.RecordBatch:
        at, place = np.nonzero(self.scores > NO_SCORE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.found[at, place]), pa.array(self.scores[at, place])], ["query_id", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, queries first; blocks then stream past the queries of their cell."""
    cell, asked, searches, waiting = None, {}, {}, {}

    def flush(d: int) -> None:
        held = waiting.pop(d, [])
        if held and d in searches:
            searches[d].add(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held], axis=1))

    def finish() -> Iterator[pa.RecordBatch]:
        for d in [*waiting]:
            flush(d)
        for found in searches.values():
            yield found.results()

    for batch in batches:
        for n in range(batch.num_rows):
            row = {f: batch.column(f)[n].as_py() for f in batch.schema.names}
            if row["cell"] != cell:
                yield from finish()
                cell, asked, searches, waiting = row["cell"], {}, {}, {}
            ids, values = unpacked(row["ids"], row["data"], row["width"], row["d"])
            if row["kind"] == 0:
                asked.setdefault(row["d"], []).append((ids, values))
                continue
            for d, parts in asked.items():
                searches[d] = Search(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts], axis=1).T, k)
            asked = {}
            held = waiting.setdefault(row["d"], [])
            held.append((ids, values))
            if sum(len(i) for i, _ in held) >= CHUNK:
                flush(row["d"])
    yield from finish()


def exact_topk(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products of each query, ties to the smaller id.

    Components count as floor(scale * x). Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's id, fewer than ``k`` give all. Repeated rows are candidates each; if rows share a
    query's id, one of their shortest vectors, the smallest by its bytes, asks once. Null ids and vectors, vectors with null or non-finite components, and
    those whose scores might not fit in a long (squared norm of 2^62 and more) take no part; vectors of another length
    than the query's, the empty one too, don't take part in its result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(column(id_col).cast("long"), column(vector_col))
    blocks = materialize(rows.mapInArrow(lambda b: blocks_of(b, scale), "ids binary, data binary, width int, d int"), "vector-blocks")
    asked = blocks.mapInArrow(lambda b: _asked(b, every), "id long, data binary, width int, d int")
    asked = materialize(asked.groupBy("id").agg(F.min(F.struct("d", "width", "data")).alias("v")).select("id", "v.*"), "query-vectors")
    n_blocks = blocks.count()
    n_asked, widest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("data")), F.lit(0))).first()
    groups = max(1, math.ceil(n_asked / HELD), math.ceil(n_asked * widest / HELD_BYTES))
    parts = max(1, min(math.ceil(shuffle_partitions(spark) / groups), n_blocks // LEAST_BLOCKS))
    first, dealt = F.pmod(F.xxhash64("id"), F.lit(groups)) * parts, F.pmod(F.xxhash64("ids"), F.lit(parts))
    queries = asked.select(F.explode(F.sequence(first, first + parts - 1)).alias("cell"), F.lit(0).alias("kind"), _bytes_of("id"), "data", "width", "d")
    others = blocks.select(F.explode(F.sequence(dealt, dealt + (groups - 1) * parts, F.lit(parts).cast("long"))).alias("cell"), F.lit(1).alias("kind"), "ids", "data", "width", "d")
    met = queries.unionByName(others).repartition(groups * parts, "cell").sortWithinPartitions("cell", "kind")
    best = met.mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bytes_of(name: str):
    """A long's eight bytes, lowest first."""
    digits = F.lpad(F.hex(F.col(name)), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))).alias("ids")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v as q join v as c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify rank <= 20
"""
