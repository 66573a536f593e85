import hashlib
import random
import re

import numpy as np

from tests.llm.fixtures import documents, pages_of
from veriskill.llm import common, jaccard_join
from veriskill.llm.components import connected_components
from veriskill.llm.exact_dedup import exact_dedup, keep_distinct
from veriskill.llm.jaccard_join import jaccard_components, keep_one_per_component, linked
from veriskill.llm.line_templates import drop_templates


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def check_exact(docs):
    rows, got = pages_of(docs), pages_of(exact_dedup(docs))
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert sum(r["kept"] for r in got) == len(groups)
    for r in got:
        group = by_sha[r["text_sha256"]]
        best = min(group, key=lambda x: (-len(x["text"] or ""), x["doc_id"] is None, x["doc_id"] or 0))
        assert (r["keep_id"], r["group_size"]) == (best["doc_id"], len(group))
        assert not r["kept"] or r["doc_id"] == best["doc_id"]


def test_exact_dedup_matches_brute_force(spark):
    check_exact(documents(spark))


def test_exact_dedup_with_a_hot_text(spark):
    docs = documents(spark)
    hot = spark.range(1000, 1900).selectExpr("id AS doc_id", "concat('hot text', repeat(' ', cast(id % 3 as int))) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars", "1 AS hits")
    docs = docs.unionByName(hot).unionByName(hot.where("doc_id = 1001"))
    check_exact(docs)
    kept = keep_distinct(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(r["text"]) for r in pages_of(docs)})


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(documents(spark).limit(0)).count() == 0


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def check_components(docs, got):
    rows = [r for r in pages_of(docs) if r["doc_id"] is not None]
    sets = [shingles(r["text"]) for r in rows]
    parent = {r["doc_id"]: r["doc_id"] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = root(rows[i]["doc_id"]), root(rows[j]["doc_id"])
                parent[max(x, y)] = min(x, y)
    want = sorted((r["doc_id"], len(s), root(r["doc_id"]), n) for r, s, n in zip(rows, sets, links, strict=True))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == want


def test_jaccard_join_matches_brute_force(spark):
    docs = documents(spark, 40)
    got = pages_of(jaccard_components(docs))
    assert len(got) == docs.count() and all(r["component_id"] is None for r in got if r["doc_id"] is None)
    check_components(docs, got)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert set(ids) == {r["component_id"] for r in got} and len(set(ids)) == len(ids)


def test_jaccard_join_in_blocks(spark):
    """A large group of near copies over several verification blocks."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(docs, pages_of(jaccard_components(docs, block=8)))


def test_jaccard_join_of_hot_shingles(spark):
    """Few words make every shingle frequent: no link is lost, and next to nothing is verified without need."""
    rng = random.Random(2)
    rows = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    base = [f"w{k}" for k in range(60)]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(60)] = rng.choice(["x", "y"])
        rows.append(" ".join(words[: rng.randint(56, 60)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    old, jaccard_join.HOT_BLOCK = jaccard_join.HOT_BLOCK, 16
    try:
        check_components(docs, pages_of(jaccard_components(docs, block=16)))
    finally:
        jaccard_join.HOT_BLOCK = old


def test_verification_follows_the_links(spark, monkeypatch):
    """Texts of 40 words over 12 words link with nothing: what is sent to verification must not grow with the square."""
    sent = []
    for n in (1000, 2000):
        rng = random.Random(n)
        docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghijkl") for _ in range(40))) for i in range(n)], "doc_id long, text string")
        kept = {}
        monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: kept.setdefault(label, common.materialize(df, label)))
        jaccard_components(docs).count()
        sent.append(kept["shingle-members"].count())
    assert sent[1] <= 40


def test_one_row_of_each_component_stays(spark):
    base = " ".join(f"w{k}" for k in range(80))
    near, other = base.replace("w7 ", "x "), " ".join(f"v{k}" for k in range(20))
    rows = [(1, base, 5), (2, near, 6), (2, other, 7), (3, other, 8), (4, "alone", 9), (4, "alone", 9), (5, None, 1), (5, None, 1), (None, base, 2), (6, "", 3), (1, base, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert got == sorted((str(i), str(t)) for i, t in [(1, base), (2, other), (4, "alone"), (5, None), (5, None), (None, base), (6, "")])
    names = spark.createDataFrame([(f"id{i}", t) for i, t, _ in rows], "doc_id string, text string")
    assert {r.component_id for r in jaccard_components(names).collect()} == {"id1", "id2", "id4", "id5", "idNone", "id6"} - {"idNone"}


def test_linked_counts_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)] + [np.zeros(0, np.uint64)] * 2
    got = linked(sets, 60, columns=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert got[i, j] == (i != j and both > 0 and 100 * both >= 60 * either)


def test_components_over_many_partitions(spark, monkeypatch):
    import veriskill.llm.components as c

    monkeypatch.setattr(c, "TASK_EDGES", 20)
    chain = spark.range(0, 100).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(200, 240).selectExpr("id AS a", "200L AS b"))
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and all(got[i] == 200 for i in range(201, 240))


def test_line_templates(spark):
    rows = [(i, f"unique opening line number {chr(97 + i)}\nPage {i} of 99 printed on demand\nbody {chr(97 + i)} x y z") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n \n"), (23, rows[0][1]), (None, "Page 7 of 12 printed on demand"), (23, rows[0][1])]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, m string, n_lines int")
    got = pages_of(drop_templates(docs))
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == ("", 1, 1)
        elif i < 8 or i == 23:
            assert "printed" not in r["text"] and r["n_dropped"] >= 1 and r["n_lines"] == 3
            assert f"body {chr(97 + i % 23)} x y z" in r["text"] or i == 23
        else:
            assert r["text"] == dict(rows)[i] and r["n_dropped"] == 0


def test_line_templates_of_nothing(spark):
    assert drop_templates(documents(spark).limit(0)).count() == 0
