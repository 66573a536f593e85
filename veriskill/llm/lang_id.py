"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over the
window is kept, and a softmax layer names the language. Training is plain numpy on a bounded sample of labelled text;
scoring runs on batches of windows inside Spark tasks, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriskill.llm.common import column, hash_sample, held_out, map_arrow, table, whole_text

WIDTHS = (2, 3, 4, 5)
UNDETERMINED = "und"


@dataclass
class ByteCNN:
    """``emb`` (256, d), ``filters`` (max width, d, n) zero beyond each filter's width, ``bias`` (n), ``out`` (n, classes), ``out_bias``."""

    langs: list[str]
    window: int
    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(n, positions, width * d) patches of ``windows`` (n, window) bytes."""
        x = self.emb[windows]
        wide = self.filters.shape[0]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), wide * x.shape[2], axis=1)
        return view[:, :: x.shape[2]]

    def features(self, windows: np.ndarray, chunk: int = 32) -> np.ndarray:
        flat = self.filters.reshape(-1, self.filters.shape[2])
        found = np.empty((len(windows), flat.shape[1]), np.float32)
        for i in range(0, len(windows), chunk):
            p = self.patches(windows[i : i + chunk])
            z = np.ascontiguousarray(p).reshape(-1, flat.shape[0]) @ flat
            found[i : i + chunk] = z.reshape(len(p), -1, flat.shape[1]).max(axis=1)
        return np.maximum(found + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.features(windows) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def to_windows(raw: bytes, window: int) -> np.ndarray:
    """Consecutive windows over all bytes; the last one is moved back to be full, or padded if the text is shorter."""
    n = len(raw)
    if n <= window:
        return np.frombuffer(raw.ljust(window, b"\0"), np.uint8)[None]
    a = np.frombuffer(raw, np.uint8)
    full = a[: n // window * window].reshape(-1, window)
    return full if n % window == 0 else np.concatenate((full, a[None, n - window :]))


def train(texts: list[bytes], labels: list[str], *, window: int = 192, dim: int = 8, per_width: int = 10, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Adam on cross entropy. Of each text the first ``window`` bytes and one tail of random length are learned, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    wide, n = max(WIDTHS), per_width * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w)[:, None], per_width, 1) for w in WIDTHS], axis=1)[:, None, :].astype(np.float32)
    net = ByteCNN(
        langs, window, rng.normal(0, 0.5, (256, dim)).astype(np.float32), (rng.normal(0, 0.25, (wide, dim, n)) * mask).astype(np.float32),
        np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    net.emb[0] = 0
    code = {x: k for k, x in enumerate(langs)}
    xs, ys = [], []
    for raw, label in zip(texts, labels, strict=True):
        short = int(rng.integers(6, window))
        for part in (raw[:window], raw[-short:]):
            xs.append(np.frombuffer(part.ljust(window, b"\0"), np.uint8))
            ys.append(code[label])
    if not xs:
        return net
    x, y = np.stack(xs), np.array(ys)
    params = [net.emb, net.filters, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            pick = order[i : i + batch]
            step += 1
            for k, (p, g) in enumerate(zip(params, _gradients(net, x[pick], y[pick], mask), strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteCNN, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    wide, dim, n = net.filters.shape
    b = len(x)
    patches = np.ascontiguousarray(net.patches(x))
    z = (patches.reshape(-1, wide * dim) @ net.filters.reshape(-1, n)).reshape(b, -1, n)
    at = z.argmax(axis=1)  # (b, n)
    top = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.bias
    f = np.maximum(top, 0)
    d = softmax(f @ net.out + net.out_bias)
    d[np.arange(b), y] -= 1
    d /= b
    df = (d @ net.out.T) * (top > 0)
    won = patches[np.arange(b)[:, None], at]  # (b, n, wide * dim)
    dfilters = np.einsum("bnk,bn->kn", won, df).reshape(wide, dim, n) * mask
    dpatch = df[:, :, None, None] * net.filters.transpose(2, 0, 1)[None]  # (b, n, wide, dim)
    which = x[np.arange(b)[:, None, None], at[:, :, None] + np.arange(wide)]
    demb = np.stack([np.bincount(which.ravel(), dpatch[..., k].ravel(), 256) for k in range(dim)], axis=1).astype(np.float32)
    demb[0] = 0  # padding
    return [demb, dfilters, df.sum(0), f.T @ d, d.sum(0)]


def training_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1200, chars: int = 300) -> pd.DataFrame:
    """At most ``per_lang`` pieces of ``chars`` characters for each label, from rows outside the held-out fold, chosen by hash."""
    text = whole_text(column(text_col))
    h = F.xxhash64(column(id_col).cast("string"))
    start = F.pmod(h, F.greatest(F.char_length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where(column(lang_col).isNotNull() & ~held_out(column(id_col)) & (F.char_length(text) > 0)).select(column(lang_col).alias("lang"), F.substring(text, start, F.lit(chars)).alias("piece"), h.alias("h"))
    return hash_sample(rows, "lang", "h", per_lang).toPandas().sort_values(["lang", "h", "piece"])


def fit(docs: DataFrame, **names: str) -> ByteCNN:
    sample = training_sample(docs, **names)
    return train([x.encode() for x in sample.piece], list(sample.lang))


def classify(docs: DataFrame, net: ByteCNN, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``: the language with the highest mean probability over all windows.

    A null text, one without a letter, or a network without classes gives ``und`` and score 0; of equally probable
    languages the first by name counts. A very long text is read whole, all its windows in one task. Empty tables stay
    empty, repeated rows get equal results, other columns pass through; input columns of the two names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("lang_score", "double")
    names = [f.name for f in schema]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pred, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(text_col).to_pylist()
            for group in _groups(texts, 1 << 20) if model.langs else []:
                parts = [to_windows(texts[i].encode(), model.window) for i in group]
                probs = model.probabilities(np.concatenate(parts))
                counts = np.array([len(p) for p in parts])
                mean = np.add.reduceat(probs, np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
                for i, row in zip(group, mean, strict=True):
                    k = int(row.argmax())
                    pred[i], score[i] = model.langs[k], min(1.0, float(row[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names)

    return map_arrow(docs, label, schema)


def _groups(texts: list[str | None], limit: int) -> Iterator[list[int]]:
    """Indices of texts with letters, in groups of about ``limit`` characters."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t and any(map(str.isalpha, t)):
            group.append(i)
            size += len(t)
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def keep_identified(docs: DataFrame, *, min_score: float = 0.35, **names: str) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or scored below ``min_score``; columns unchanged."""
    found = classify(docs, fit(docs, **names), text_col=names.get("text_col", "text"))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= min_score)).select(*(column(c) for c in docs.columns))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
