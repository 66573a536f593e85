import re

import pytest

from tests.llm.fixtures import documents, pages_of
from tests.llm.test_dedup import norm, shingles
from tests.llm.test_scans import brute_contamination
from veriskill.llm import common, registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ITEM = "seven brave wizards quietly measure every frozen lake beyond the northern border each winter"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = documents(spark, 120)
    rows = [(300, "the thing was with " + ITEM + " and of the thing was " + " ".join(f"thing{i}" for i in range(60)), "en", "s", 1, 1), (301, ITEM, "en", "s", 1, 1), (302, "des où les " + PASSAGE, "fr", "s", 1, 1)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_brute_force(spark, folder):
    """Each stage by itself on what its predecessor kept, checked by plain loops."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = pages_of(docs)
        docs = common.materialize(stage(spark, docs, folder), f"test-{name}")
        after = tables[name] = pages_of(docs)
        if name != "piece_codec":
            assert docs.columns == columns
        if name == "language_id":
            letters = [r for r in before if any(map(str.isalpha, r["text"] or ""))]
            assert len(after) <= len(letters) and len(after) >= len(letters) - 2  # few words can score low
        if name == "exact_dedup":
            want = {}
            for r in before:
                old = want.get(norm(r["text"]))
                rank = (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0)
                if old is None or rank < old[0]:
                    want[norm(r["text"])] = (rank, r["doc_id"])
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(v[1]) for v in want.values())
        if name == "jaccard_join":
            rows = [r for r in before if r["doc_id"] is not None]  # ids repeat, so that each row is a node
            parent = list(range(len(rows)))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            sets = [shingles(r["text"]) for r in rows]
            for i, a in enumerate(sets):
                for j in range(i):
                    if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
            groups = {}
            for i, r in enumerate(rows):
                groups.setdefault(root(i), []).append(r)
            assert len(groups) < len(rows)
            assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(min(r["doc_id"] for r in g) for g in groups.values())
            kept = {(r["doc_id"], r["text"]) for r in after}
            assert all(any((r["doc_id"], r["text"]) in kept for r in g if r["doc_id"] == min(x["doc_id"] for x in g)) for g in groups.values())
        if name == "decontaminate":
            clean = {(r["doc_id"], r["text"]) for r in before if not brute_contamination(r["text"], [(1, ITEM)])[1]}
            kept = {(r["doc_id"], r["text"]) for r in after}
            assert clean <= kept and 301 not in {r["doc_id"] for r in after} and 300 in {r["doc_id"] for r in after}
            assert not any(brute_contamination(t, [(1, ITEM)])[1] for _, t in kept)
        if name == "piece_codec":
            assert len(after) == len(before) and all(r["lossless"] for r in after)
    got = pages_of(corpus_pipeline.run(spark, folder))
    assert sorted((str(r["doc_id"]), r["n_pieces"]) for r in got) == sorted((str(r["doc_id"]), r["n_pieces"]) for r in tables["piece_codec"])


def test_empty_documents_pass_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_contract_columns(spark):
    want = {
        "op1": ["page_id", "url", "text", "n_chars"], "op2": ["doc_id", "held_out", "lang_pred", "score"], "op4": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op5": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op7": ["doc_id", "held_out", "score", "predicted"], "op9": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op10": ["doc_id", "n_shingles", "component_id"],
    }
    found = registry.queries()
    for op, columns in want.items():
        name = next(q for q in found if re.match(rf"{op}_", q))
        df = found[name](spark, "/root/testdata/sf0.001")
        assert set(columns) <= set(df.columns), name


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        common.scratch_root(Session())
