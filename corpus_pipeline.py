"""The corpus pipeline: five stages from raw documents to encoded training text.

Each stage takes all rows that its predecessor kept and returns the columns of ``documents``, the last one its
encoding. Stages are materialised between steps, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriskill.llm.common import materialize, table
from veriskill.llm.decontaminate import remove_contamination
from veriskill.llm.exact_dedup import keep_distinct
from veriskill.llm.jaccard_join import keep_one_per_component
from veriskill.llm.lang_id import keep_identified
from veriskill.llm.piece_codec import PieceCodec, encode_pieces, model_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows without a letter or with a language score below the limit. The network learns from ``docs`` itself."""
    return keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the longest original of each text that differs in white space only, then the smallest id."""
    return keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of documents that share nine tenths of their shingles: the smallest id."""
    return keep_one_per_component(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of test items out of the texts; drop texts that are mostly such passages."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text under merge-dropout, with the check that they decode to it."""
    return encode_pieces(docs, PieceCodec.load(model_path(spark)))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", remove_benchmark),
    ("piece_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and hashed merges have no SQL form; tests check the stages against brute force.
ORACLE_SQL = None
