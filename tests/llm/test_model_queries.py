"""The registered queries of the language network and the quality classifier, recomputed document by document in plain loops."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import documents
from veriskill.llm import lang_id, quality_fm


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    documents(spark, 90).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def held(key):
    return key is None or zlib.crc32(str(key).encode()) % 5 == 0


def plain_language(net, text):
    """Every window by itself: each filter at each place, its maximum, the softmax, then the mean."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, n = text.encode(), net.window
    ends = [*range(n, len(raw) + 1, n)]
    windows = [raw[e - n : e] for e in ends] + ([raw[-n:]] if len(raw) % n and len(raw) > n else []) + ([raw + b"\0" * (n - len(raw))] if len(raw) < n else [])
    total = np.zeros(len(net.langs))
    for w in windows:
        x = net.emb[list(w)].astype(float)
        top = np.full(net.filters.shape[2], -np.inf)
        for p in range(n - len(net.filters) + 1):
            top = np.maximum(top, np.einsum("jd,jdk->k", x[p : p + len(net.filters)], net.filters))
        z = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    k = int(total.argmax())
    return net.langs[k], total[k] / len(windows)


def test_language_query_matches_plain_loops(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = lang_id.fit(docs)
    want = sorted((str(r.doc_id), held(r.doc_id), *plain_language(net, r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in lang_id.op2_language_id(spark, folder).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)
    assert {w[2] for w in want} == {"en", "fr", "und"}


def plain_features(text):
    raw = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = re.findall(rb"[a-z0-9\x80-\xff]+", lower)
    slots = {}
    for w in set(words):
        k = xxhash.xxh64_intdigest(w) % quality_fm.WORD_SLOTS
        slots[k] = slots.get(k, 0) + words.count(w)
    damped = {k: math.log1p(c) for k, c in slots.items()}
    size = max(1e-9, math.sqrt(sum(v * v for v in damped.values())))
    x = {k: v / size for k, v in damped.items()}
    n, total = max(1, len(raw)), max(1, len(words))
    share = lambda good: sum(map(good, raw)) / n
    upper, digit, white = share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b"\t\n\x0b\x0c\r ")
    marks = sum(33 <= c <= 126 and not chr(c).isalnum() for c in raw)
    lines = [s for s in raw.split(b"\n") if s]
    stats = {
        "log_chars": math.log1p(len(raw)), "word_len": sum(map(len, words)) / total, "upper": upper, "punct": marks / n, "digit": digit, "white": white, "marks_per_word": marks / total,
        "distinct": len(set(words)) / total, "top_word": max(map(words.count, set(words)), default=0) / total, "line_repeat": 1 - len(set(lines)) / max(1, len(lines)), "line_len": n / max(1, len(lines)),
        "non_ascii": share(lambda c: c >= 128), "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / total,
    }
    for k, name in enumerate(quality_fm.STATS):
        x[quality_fm.WORD_SLOTS + quality_fm.BINS * k + sum(edge < stats[name] for edge in quality_fm.EDGES[name])] = 0.5
    return x


def plain_quality(fm, text):
    """Every pair of features by itself."""
    x = plain_features(text)
    slots = sorted(x)
    z = float(fm.w0[0]) + sum(float(fm.w[k]) * x[k] for k in slots)
    v = fm.v[slots].astype(float) * np.array([x[k] for k in slots])[:, None]
    for i in range(len(slots)):
        z += float((v[i + 1 :] @ v[i]).sum())
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_quality_query_matches_plain_loops(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fm = quality_fm.fit(docs, labels)
    want = sorted((str(r.doc_id), held(r.doc_id), plain_quality(fm, r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.held_out, r.score) for r in quality_fm.op7_quality(spark, folder).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)
    assert {r.predicted for r in quality_fm.op7_quality(spark, folder).where("score < 0.3").collect()} <= {0} and np.std([w[2] for w in want]) > 0.05
