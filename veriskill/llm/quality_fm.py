"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

The score is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``. The pairwise sum is taken in linear time as
half of the squared sum minus the sum of squares, per factor. Training is plain numpy on a bounded sample of labelled
documents; scoring reads whole texts in Spark tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriskill.llm.common import WORD_TABLE, column, hash_sample, held_out, map_arrow, table

WORD_SLOTS = 4096
#: Bins of each structure statistic.
BINS = 8
STATS = ("log_chars", "word_len", "upper", "punct", "digit", "white", "marks_per_word", "distinct", "top_word", "line_repeat", "line_len", "non_ascii", "echo")
SIZE = WORD_SLOTS + BINS * len(STATS)
#: Upper bin edges of each statistic, in its own unit.
EDGES = {
    "log_chars": (3, 4, 5, 6, 7, 8, 9), "word_len": (3, 4, 4.5, 5, 5.5, 6, 8), "upper": (0.005, 0.01, 0.02, 0.04, 0.1, 0.3, 0.6),
    "punct": (0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4), "digit": (0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4), "white": (0.05, 0.1, 0.13, 0.16, 0.2, 0.25, 0.35),
    "marks_per_word": (0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6), "distinct": (0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95), "top_word": (0.02, 0.04, 0.06, 0.09, 0.13, 0.2, 0.4),
    "line_repeat": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75), "line_len": (20, 50, 90, 150, 250, 500, 1500), "non_ascii": (0.01, 0.03, 0.06, 0.1, 0.15, 0.3, 0.6),
    "echo": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
}

_CLASS = np.zeros(256, np.int8)  # 0 other letter, 1 upper, 2 digit, 3 white, 4 mark, 5 beyond ASCII
_CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 1, 2, 3, 5
for _c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]:
    _CLASS[_c] = 4
_CLASS = bytes(_CLASS.tolist())


def _slot(word: bytes, cache: dict[bytes, int]) -> int:
    k = cache.get(word)
    if k is None:
        if len(cache) > 200_000:
            cache.clear()
        k = cache[word] = xxhash.xxh64_intdigest(word) % WORD_SLOTS
    return k


def statistics(raw: bytes, sequence: list[bytes], words: Counter) -> list[float]:
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw.translate(_CLASS), np.uint8), minlength=6)[:6] if raw else np.zeros(6)
    total = max(1, sum(words.values()))
    lines = [x for x in raw.split(b"\n") if x]
    return [
        math.log1p(len(raw)), sum(len(w) * c for w, c in words.items()) / total, kinds[1] / n, kinds[4] / n, kinds[2] / n, kinds[3] / n, kinds[4] / total,
        len(words) / total, max(words.values(), default=0) / total, 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), kinds[5] / n,
        sum(map(eq, sequence, sequence[1:])) / total,
    ]


def features(text: str | None, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: word slots with damped counts at unit length, and one bin of each statistic."""
    raw = (text or "").encode()
    sequence = raw.translate(WORD_TABLE).split()
    words = Counter(sequence)
    at = np.fromiter((_slot(w, cache) for w in words), np.int64, len(words))
    slots, where = np.unique(at, return_inverse=True)
    counts = np.bincount(where, weights=np.fromiter(words.values(), float, len(words)), minlength=len(slots)) if len(words) else np.zeros(0)
    values = np.log1p(counts)
    values = values / max(1e-9, float(np.sqrt((values**2).sum())))
    bins = [WORD_SLOTS + BINS * k + int(np.searchsorted(EDGES[name], x)) for k, (name, x) in enumerate(zip(STATS, statistics(raw, sequence, words), strict=True))]
    return np.concatenate((slots, bins)).astype(np.int32), np.concatenate((values, np.full(len(bins), 0.5))).astype(np.float32)


@dataclass
class FactorisationMachine:
    w0: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        at = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows])[:, None]
        starts = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1]))
        linear = np.add.reduceat(self.w[at, None] * x, starts, axis=0)[:, 0]
        vx = self.v[at] * x
        pairs = 0.5 * (np.add.reduceat(vx, starts, axis=0) ** 2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.w0[0] + linear + pairs, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = 8, steps: int = 400, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> FactorisationMachine:
    """Adam on cross entropy; without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(np.zeros(1, np.float32), np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32))
    if not rows:
        return fm
    params = [fm.w0, fm.w, fm.v]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order, at = rng.permutation(len(rows)), 0
    for step in range(1, steps + 1):
        if at + batch > len(order):
            order, at = rng.permutation(len(rows)), 0
        pick = order[at : at + batch]
        at += batch
        x = np.zeros((len(pick), SIZE), np.float32)
        for i, k in enumerate(pick):
            x[i, rows[k][0]] = rows[k][1]
        xv = x @ fm.v
        z = fm.w0[0] + x @ fm.w + 0.5 * (xv**2 - (x**2) @ (fm.v**2)).sum(axis=1)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
        gv = x.T @ (xv * d[:, None]) - fm.v * ((x**2).T @ d)[:, None]
        for k, (p, g) in enumerate(zip(params, (np.array([d.sum()]), x.T @ d, gv), strict=True)):
            g = g + decay * p
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return fm


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500) -> pd.DataFrame:
    """Features of at most ``per_label`` documents for each label, from rows outside the held-out fold, chosen by hash.

    Ids are chosen from the label table alone (of an id with several labels, the lowest row counts), so that only chosen texts are read.
    """
    known = labels.where(column(label_col).isin(0, 1) & ~held_out(column(id_col))).groupBy(column(id_col).alias("_id")).agg(F.min(column(label_col)).alias("_y"))
    chosen = F.broadcast(hash_sample(known, "_y", "_id", per_label).select("_id", "_y"))  # at most twice per_label
    picked = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")).join(chosen, "_id").select("_id", "_y", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            rows = [features(t, cache) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["id", "y", "at", "x"])

    found = picked.mapInArrow(encode, "id string, y int, at array<int>, x array<float>")
    # An id that many rows repeat is one training row.
    return found.groupBy("id").agg(F.min_by(F.struct("y", "at", "x"), F.xxhash64("at", "x")).alias("r")).select("id", "r.*").toPandas().sort_values("id")


def fit(docs: DataFrame, labels: DataFrame, **names: str) -> FactorisationMachine:
    known = training_rows(docs, labels, **names)
    return train([(np.asarray(a), np.asarray(x)) for a, x in zip(known["at"], known["x"], strict=True)], known.y.to_numpy(np.float32))


def score(docs: DataFrame, fm: FactorisationMachine, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` in 0..1 from the whole text alone.

    Null text counts as empty and is scored like it. A very long text is read whole, its words counted in one task. Empty tables stay empty, repeated rows get equal scores, other
    columns pass through; an input column ``quality_score`` is replaced. Without labels every score is 0.5.
    """
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(fm)
    schema = StructType([*docs.schema.fields]).add("quality_score", "double")
    names = [f.name for f in schema]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for b in batches:
            out, texts = [], b.column(text_col)
            for i in range(0, b.num_rows, 256):
                out.append(model.scores([features(t, cache) for t in texts.slice(i, 256).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*out, np.zeros(0)]).astype(float))], names)

    return map_arrow(docs, rate, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    s = F.col("quality_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), F.when(s >= 0.3, 1).otherwise(0).alias("predicted"))
