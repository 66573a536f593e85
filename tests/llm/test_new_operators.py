"""Periodic runs, fill-in-middle and exact top-k against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veriskill.llm import fill_middle, periodic_runs, topk_search


def plain_runs(words):
    """Every maximal stretch of every period, kept if that is its smallest and it is long enough."""
    out = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    kind = rng.random()
    n = rng.randint(0, 90)
    words = [rng.choice("ab" if kind < 0.4 else "abcdefgh") for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if words:
            at, piece = rng.randrange(len(words)), [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words[at:at] = (piece * rng.randint(2, 9))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("stride", [1, 7, 64, 1 << 20])
def test_runs_of_any_stride(stride):
    rng = random.Random(stride)
    texts = [random_words(rng) for _ in range(60 if stride == 1 else 300)] + [["a"] * 700, ["a", "b", "c"] * 300, []]
    words = np.array([ord(w) for t in texts for w in t])
    found = periodic_runs.runs_of(words, np.array([len(t) for t in texts]), stride)
    got = [[] for _ in texts]
    for t, s, n, q in zip(*(x.tolist() for x in found), strict=True):
        got[t].append((s, n, q))
    assert got == [plain_runs(t) for t in texts]


def test_a_wrong_fingerprint_is_found_out(monkeypatch):
    real, calls = periodic_runs._joined, []

    def joined(a, b):
        calls.append(1)
        return real(a, b) % np.uint64(3 if len(calls) < 30 else 1 << 63)

    monkeypatch.setattr(periodic_runs, "_joined", joined)
    words = [random.Random(5).choice("abcdefgh") for _ in range(200)]
    words[50:90] = list("wxyz") * 10
    found = periodic_runs.runs_of(np.array([ord(w) for w in words]), np.array([len(words)]))
    assert list(zip(*(x.tolist() for x in found[1:]), strict=True)) == plain_runs(words) and plain_runs(words)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(1)
    blanks = [" ", "\t", "\n", "  ", "\x0b", "\r\n", "\x0c"]
    rows = [(i, "".join(rng.choice(["", *blanks[:2]]) + w + rng.choice(blanks) for w in random_words(rng))) for i in range(-20, 300)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb é é é é é é"), (303, rows[40][1]), (None, "x " * 9), (305, "w1 w2 w3 " * 20_000), (306, " ".join(f"u{k}" for k in range(30_000)))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(str(tuple(r)) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for key, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(key).encode())
        if key is not None and n and h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 5000 else [(0, 60_000, 3)] if key == 305 and h % 10 else []
        if n >= 5000 and h % 10 == 0:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append(str((key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())))
    assert set(want) <= set(got) and len(got) == len(rows) and len(want) >= len(rows) - 2
    assert sum("None, None" not in w for w in want) > 50


def test_periodic_runs_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", 3, 4)], "doc_id long, text string, `runs` long, `a.b` long")
    row = periodic_runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed == "a b" and row.n_words == 7
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def plain_fim(key, text):
    h = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle(spark, tmp_path):
    rng = random.Random(2)
    pieces = ["a", "é", "😀", "\n", "\r", " ", "$1", "\\", "<", "<P", "S>", "<S", "M>", " ", "{2}", "\x00"]
    rows = [(i - 10, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (500, ""), (501, "x<M>y"), (501, "x"), (501, "x"), (None, "no id here"), (502, "😀ab\n" * 300_000), (503, "z" * 4096), (504, "é" * 8191)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n long, h1 long, `a.b` long").repartition(3)
    got = fill_middle.fill_in_middle(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((k, *plain_fim(k, t or ""))) for k, t in rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = fill_middle.op12_fill_middle(spark, str(tmp_path)).collect()
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.restored_sha256 for r in made) == texts and {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    other = fill_middle.fill_in_middle(docs, marks=("<|pre|>", "$suf$", "\\mid"), plain_pct=0)
    back = other.select("doc_id", fill_middle.restored(other.output, other.form, ("<|pre|>", "$suf$", "\\mid")).alias("text"))
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((k, t or "")) for k, t in rows)


def plain_topk(rows, k, every):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(64.0 * x)) for x in v]))
    out = []
    for i in sorted({i for i, _ in usable if i % every == 0}):
        q = next(v for j, v in usable if j == i)
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(2, 0.05, d) * spread
    base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, d)) * 0.01 * spread
    return [(i, v) for i, v in enumerate(np.float32(base).tolist())]


@pytest.mark.parametrize("spread,d,small", [(1.0, 40, True), (300.0, 40, False), (3e6, 17, True), (1.0, 64, False)])
def test_topk(spark, monkeypatch, spread, d, small):
    if small:
        for name, value in (("BLOCK", 37), ("CHUNK", 100), ("TILE", 5), ("HELD", 11)):
            monkeypatch.setattr(topk_search, name, value)
    rows = vectors(1, 900, d, spread)
    nan = [float("nan")] * d
    rows += [(2000, None), (2020, [None] * d), (2040, nan), (2001, [float("inf")] * d), (None, rows[3][1]), (7, rows[7][1]), (2002, []), (2060, []), (2003, [1.0]), (2080, [2.0]), (2004, rows[0][1]), (-20, rows[5][1]), (40, rows[40][1])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, `a.b` long").repartition(5)
    got = sorted(tuple(r) for r in topk_search.exact_topk(df).collect())
    assert got == plain_topk(rows, 20, 20)


@pytest.mark.parametrize("spread", [1.0, 3e4, 1e6])
def test_branch_and_bound_in_small_tiles(monkeypatch, spread):
    monkeypatch.setattr(topk_search, "TILE", 7)
    rows = vectors(4, 800, 50, spread)
    whole = np.floor(64 * np.array([v for _, v in rows]).astype(float)).astype(np.int64)
    ids = np.arange(len(rows)) - 100
    search = topk_search.Search(ids[::20], whole[::20], 20)
    for k in range(0, len(ids), 90):
        search.add(ids[k : k + 90], whole[k : k + 90].T)
    found = search.results()
    got = list(zip(*(c.to_pylist() for c in found.columns), strict=True))
    scores = whole[::20] @ whole.T
    want = []
    for q, s in zip(ids[::20].tolist(), scores.tolist(), strict=True):
        want += [(q, i, x) for x, i in sorted(((x, i) for x, i in zip(s, ids.tolist(), strict=True) if i != q), key=lambda r: (-r[0], r[1]))[:20]]
    assert got == want


def test_topk_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [1.0, -2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.exact_topk(df).collect()) == plain_topk([tuple(r) for r in df.collect()], 20, 20)
    assert topk_search.exact_topk(df.limit(0)).count() == 0 and topk_search.exact_topk(df.where("vec_id = 1")).count() == 0
    assert topk_search.exact_topk(df, k=1).count() == 2
