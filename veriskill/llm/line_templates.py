"""Line deduplication by log templates, in DataFrame operations only.

A fixed-depth tree sends each line to a leaf by its number of tokens and its leading tokens. Tokens with digits are
variable from the start. Within a leaf, a token that too few documents have at its place generalises to a variable
field, and what remains is the line's template. Templates that recur across documents are dropped from all of them.

Only leaves that enough documents reach are looked into, and within them each distinct line once, with the number of
documents that have it, so that a line of a third of all documents is one row when its tokens are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.llm.common import column, discard, materialize, table

DEPTH, MIN_DOCS, MIN_CONSTANT = 3, 5, 0.6
FIELD = "<*>"


def masked(line: Column) -> Column:
    """Tokens in single spaces, those with a digit as a variable field."""
    spaced = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, r"(^| )[^ ]*[0-9][^ ]*", f"$1{FIELD}")).otherwise(spaced)


def drop_templates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped`` and the text without its recurring lines.

    A template recurs if at least ``min_docs`` different texts have it and at least ``min_constant`` of its tokens are
    constant; exact copies of a text count once. Blank lines are no lines and stay. Null texts stay null with no lines;
    a text of dropped lines only becomes empty. Rows that repeat id and text get equal results. Other columns pass
    through, whatever their names; input columns named as the new ones are replaced. Empty tables stay empty.
    """
    text, names = column(text_col), [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = docs.where(text.isNotNull()).select(column(id_col).alias("id"), F.xxhash64(text).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("id", "doc", "pos", masked(F.col("line")).alias("m")).where("m <> ''")
    count = F.char_length("m") - F.char_length(F.replace("m", F.lit(" "))) + 1
    lines = materialize(lines.select("id", "doc", "pos", F.xxhash64(count, F.substring_index("m", " ", depth)).alias("leaf"), F.xxhash64("m").alias("h"), "m"), "lines")

    leaves = materialize(lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    few = lines.join(leaves, "leaf", "left_semi")
    distinct = few.select("leaf", "h", "doc").distinct().groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("docs"))
    distinct = materialize(distinct.join(few.groupBy("leaf", "h").agg(F.min("m").alias("m")), ["leaf", "h"]), "distinct-lines")

    # Tables that a common line or template joins are written first, so that Spark can split its rows.
    tokens = distinct.select("leaf", "h", "docs", F.posexplode(F.split("m", " ")).alias("place", "token"))
    support = materialize(tokens.groupBy("leaf", "place", "token").agg((F.sum("docs") >= min_docs).alias("often")).where("often"), "frequent-tokens")
    constant = F.col("often").isNotNull() & (F.col("token") != FIELD)
    place = F.struct("place", F.when(constant, F.col("token")).otherwise(FIELD).alias("token"))
    parsed = tokens.join(support, ["leaf", "place", "token"], "left").groupBy("leaf", "h").agg(F.array_sort(F.collect_list(place)).alias("t"), F.avg(constant.cast("int")).alias("share"))
    parsed = materialize(parsed.where(F.col("share") >= min_constant).select("leaf", "h", F.xxhash64("leaf", "t.token").alias("template")), "line-templates")

    found = materialize(lines.select("id", "doc", "pos", "leaf", "h").join(parsed, ["leaf", "h"]).select("id", "doc", "pos", "template"), "parsed-lines")
    for written in (lines, leaves, distinct, support, parsed):
        discard(written)
    recurring = materialize(found.select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template"), "recurring-templates")
    dropped = found.join(recurring, "template", "left_semi").groupBy("id", "doc").agg(F.collect_set("pos").alias("_dropped"))
    dropped = dropped.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "_dropped")
    rest = F.struct(*(column(c) for c in names if c != text_col)) if len(names) > 1 else F.struct(F.lit(0).alias("_"))
    rows = docs.select(rest.alias("_row"), column(id_col).alias("_key"), F.xxhash64(text).alias("_hash"), F.split(text, "\n").alias("_lines"))
    joined = rows.join(dropped, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_doc")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.when(F.col("_dropped").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    filled = F.coalesce(F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    columns = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names]
    return joined.select(*columns, F.when(F.col("_lines").isNull(), 0).otherwise(filled).cast("long").alias("n_lines"), F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
e AS (SELECT rid, text, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line FROM d),
s AS (SELECT rid, text, pos, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '(^| )[^ ]*[0-9][^ ]*', '\1{FIELD}', 'g') AS m FROM e),
l AS (SELECT *, string_split(m, ' ') AS w, len(string_split(m, ' ')) || '/' || array_to_string(string_split(m, ' ')[1:{DEPTH}], ' ') AS leaf FROM s WHERE m <> ''),
leaves AS (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_DOCS}),
t AS (SELECT leaf, m, any_value(w) AS w, count(DISTINCT text) AS docs FROM l WHERE leaf IN (FROM leaves) GROUP BY leaf, m),
k AS (SELECT leaf, m, docs, unnest(generate_series(1, len(w))) AS place, unnest(w) AS token FROM t),
p AS (SELECT *, sum(docs) OVER (PARTITION BY leaf, place, token) >= {MIN_DOCS} AND token <> '{FIELD}' AS const FROM k),
tpl AS (SELECT leaf, m, string_agg(CASE WHEN const THEN token ELSE '{FIELD}' END, ' ' ORDER BY place) AS template FROM p GROUP BY leaf, m HAVING avg(const::INT) >= {MIN_CONSTANT}),
f AS (SELECT rid, text, pos, leaf, template FROM l JOIN tpl USING (leaf, m)),
r AS (SELECT leaf, template FROM f GROUP BY leaf, template HAVING count(DISTINCT text) >= {MIN_DOCS}),
x AS (SELECT rid, list(pos) AS gone FROM f JOIN r USING (leaf, template) GROUP BY rid)
SELECT doc_id, coalesce(len(list_filter(parts, lambda q: regexp_matches(q, '[^\x20\x09-\x0D]'))), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(parts, lambda q, i: NOT list_contains(gone, i)), chr(10)), '') END AS text
FROM d LEFT JOIN x USING (rid)
"""
