"""Exact deduplication by content sort, in DataFrame operations only.

Normalised texts are dealt to ranges of (first characters, hash) whose splitters Spark samples, each range is sorted
externally by the whole normalised text, and the window that follows compares neighbours in full. Range partitioning
on the leading sort keys already clusters equal texts, so the window needs no further shuffle.

A text that alone would overfill a range (``hot_share`` of an average one) leaves the sort: its copies are combined
map-side by a hash aggregate on the whole text, and the one row per text is broadcast back. At most
``ranges / hot_share`` texts can be that frequent, which bounds the broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.llm.common import column, materialize, shuffle_partitions, table, whole_text

#: White space that the comparison ignores.
IGNORED = r"[\x20\x09-\x0D]+"
#: Leading characters of the normalised text in the range key.
KEY_CHARS = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole_text(text), IGNORED, "")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, hot_share: float = 0.25) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after white space is deleted. Of equal texts, the row with the most code points in
    the original stays, then the smallest id (null ids last). Null text counts as empty, so null and blank texts form
    one group. Repeated rows (same id and text) each get a row; exactly one of a group is kept. A very long
    text is compared whole. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    ranked = _ranked(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "doc_id", "text", ranges, hot_share)
    return ranked.select("_row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, hot_share: float = 0.25) -> DataFrame:
    """``docs`` with the one row of each group of equal texts that :func:`exact_dedup` keeps; columns unchanged."""
    return _ranked(docs, id_col, text_col, ranges, hot_share).where("kept").select("_row.*")


def _ranked(docs: DataFrame, id_col: str, text_col: str, ranges: int | None, hot_share: float) -> DataFrame:
    n = ranges or max(shuffle_partitions(docs.sparkSession), docs.rdd.getNumPartitions())
    norm = normalised(column(text_col))
    keyed = docs.select(F.struct("*").alias("_row"), F.left(norm, F.lit(KEY_CHARS)).alias("_head"), F.xxhash64(norm).alias("_hash"))
    often = max(64, math.ceil(docs.count() * hot_share / n))
    hot = materialize(keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= often).select("_hash"), "hot-texts")
    text = F.col(f"_row.`{text_col}`")
    # The normalised text is made again after the exchange: only the original travels.
    full = ["_row", "_head", "_hash", normalised(text).alias("_norm"), F.char_length(whole_text(text)).alias("_chars"), F.col(f"_row.`{id_col}`").alias("_id")]
    if hot.isEmpty():
        return _sorted(keyed, full, n)
    hot = F.broadcast(hot)
    return _sorted(keyed.join(hot, "_hash", "left_anti"), full, n).unionByName(_aggregated(keyed.join(hot, "_hash", "left_semi").select(*full)))


def _sorted(keyed: DataFrame, full: list[str | Column], n: int) -> DataFrame:
    dealt = keyed.repartitionByRange(n, "_head", "_hash").select(*full)
    equal = Window.partitionBy("_head", "_hash", "_norm")
    best = equal.orderBy(F.desc("_chars"), F.asc_nulls_last("_id"))
    every = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.select(
        "_row",
        F.first("_id").over(every).alias("keep_id"),
        F.count(F.lit(1)).over(every).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"),
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
    )


def _aggregated(rows: DataFrame) -> DataFrame:
    rank = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("d"))
    groups = rows.groupBy("_norm").agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    sha = F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")
    groups = materialize(groups.select(sha, "_best", "group_size"), "hot-groups")
    joined = rows.select("_row", "_id", "_chars", sha).join(F.broadcast(groups), "text_sha256")
    ties = F.col("_best.d").eqNullSafe(F.col("_id")) & (F.col("_best.c") == -F.col("_chars"))
    out = ["_row", F.col("_best.d").alias("keep_id"), "group_size"]
    # Rows that repeat the best id and length: the first one written stays.
    tied = materialize(joined.where(ties).select(*out, "text_sha256", F.monotonically_increasing_id().alias("_u")), "hot-ties")
    first = F.broadcast(tied.groupBy("text_sha256").agg(F.min("_u").alias("_first")))  # a row for each frequent text
    kept = tied.join(first, "text_sha256").select("_row", "keep_id", "group_size", (F.col("_u") == F.col("_first")).alias("kept"), "text_sha256")
    return kept.unionByName(joined.where(~ties).select(*out, F.lit(False).alias("kept"), "text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM k
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
