"""All ten operators on clashing column names, odd rows, a very long text and an empty table."""

import pytest

from tests.llm.fixtures import pages_of
from veriskill.llm import decontaminate, exact_dedup, html_extract, jaccard_join, lang_id, license_scan, line_templates, piece_codec, quality_fm, secret_scan

NAMES = ("_id", "_hash", "_row", "a.b", "_doc", "_dropped", "_spans", "_h", "_t", "text_hash", "th", "n", "node", "spans", "_key", "token", "shard", "_lines")
LONG = " ".join(f"word{i % 5000}" + ("." if i % 9 == 0 else "") + ("\n" if i % 50 == 0 else "") for i in range(600_000))
SECRETS = " ".join(f"password=secretvalue{i} AKIA{i:014d}X" for i in range(20_000))
ROWS = [(1, "Some short text with words in it.", "en"), (1, "Some short text with words in it.", "en"), (2, None, "en"), (3, "", "fr"), (4, " \n\t ", None), (None, "A text without an id", "fr"), (5, LONG, "en"), (5, "Same id, other text", "fr"), (6, SECRETS, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "src", 7, *(k * 100 + i if i else k for k in range(len(NAMES)))) for i, t, lang in ROWS]
    names = ", ".join(f"`{n}` long" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)


def others(rows):
    """What has passed through untouched."""
    return sorted(str([r[n] for n in NAMES]) for r in rows)


def test_columns_pass_through(spark, docs):
    items = spark.createDataFrame([(1, "word1 word2 word3 word4"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id long, quality int")
    before = others(docs.collect())
    net, fm = lang_id.fit(docs), quality_fm.fit(docs, labels)
    assert others(lang_id.classify(docs, net).collect()) == before and others(quality_fm.score(docs, fm).collect()) == before
    for found in (html_extract.extract_text(docs.withColumnRenamed("text", "html")), line_templates.drop_templates(docs)):
        assert others(found.collect()) == before
    for kept in (lang_id.keep_identified(docs), exact_dedup.keep_distinct(docs), jaccard_join.keep_one_per_component(docs), decontaminate.remove_contamination(docs, items), decontaminate.remove_contamination(docs, items, shard_words=3)):
        assert kept.columns == docs.columns
        assert set(others(kept.collect())) <= set(before)
    texts = {(r.doc_id, r.text) for r in line_templates.drop_templates(docs).collect()}
    assert texts == {(i, t) for i, t, _ in ROWS}


def test_a_row_for_each_row(spark, docs):
    items = spark.createDataFrame([(1, "word1 word2 word3 word4")], "item_id long, text string")
    for found in (exact_dedup.exact_dedup(docs), jaccard_join.jaccard_components(docs), decontaminate.contamination(docs, items), secret_scan.secret_scan(docs), piece_codec.encode_pieces(docs, piece_codec.PieceCodec.load())):
        assert found.count() == len(ROWS)
    assert license_scan.license_scan(docs).count() == 0
    secrets = [r for r in secret_scan.secret_scan(docs).collect() if r.doc_id == 6]
    assert len(secrets[0].spans) == 40_000
    encoded = piece_codec.encode_pieces(docs, piece_codec.PieceCodec.load())
    assert all(r.lossless for r in encoded.collect() if r.pieces is not None)


def test_empty_tables(spark, docs):
    none, items = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net, fm = lang_id.fit(none), quality_fm.fit(none, labels)
    every = [
        html_extract.extract_text(none.withColumnRenamed("text", "html")), lang_id.classify(none, net), license_scan.license_scan(none), decontaminate.contamination(none, items), decontaminate.remove_contamination(none, items), exact_dedup.exact_dedup(none),
        piece_codec.encode_pieces(none, piece_codec.PieceCodec.load()), quality_fm.score(none, fm), line_templates.drop_templates(none), secret_scan.secret_scan(none), jaccard_join.jaccard_components(none), jaccard_join.keep_one_per_component(none),
    ]
    assert [x.count() for x in every] == [0] * len(every)
    assert len(pages_of(decontaminate.contamination(docs, items))) == len(ROWS)
