"""Fill-in-middle transformation by counted quantifiers.

``regexp_count`` gives the number of code points. Two cuts come from a keyed hash of the document's id, and a pattern of
the row, ``(.{a}+)(.{b-a}+)(.*+)``, captures prefix, middle and suffix in one match, from which one replacement makes
the output. Counted quantifiers never backtrack, so that a match reads each code point once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.llm.common import column, table, whole_text

#: Code points counted at a time, so that no array of single characters arises.
STRETCH = 4096
MARKS = ("<P>", "<S>", "<M>")


def code_points(text: Column) -> Column:
    """Number of code points: whole stretches, and what is left without them."""
    stretch = F.lit(f"(?s).{{{STRETCH}}}+")
    return (F.regexp_count(text, stretch) * STRETCH + F.regexp_count(F.regexp_replace(text, stretch, F.lit("")), F.lit("(?s)."))).cast("long")


def hash_words(key: Column, count: int) -> list[Column]:
    """The first ``count`` groups of eight hexadecimal digits of the key's sha256, as numbers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def _quoted(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in mark)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_pct: int = 10, spm_pct: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: empty texts, texts that
    hold a mark, and ``plain_pct`` of the rest stay as they are and have null counts. Null text counts as empty, a null
    id is hashed as the word ``null``. Equal ids and texts give equal rows. Texts of any length are cut at code points,
    each read a fixed number of times. Other columns are ignored; an empty table stays empty.
    """
    rows = docs.select(column(id_col).alias("doc_id"), whole_text(column(text_col)).alias("text"))
    h1, h2, h3, h4 = hash_words(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 4)
    rows = rows.select("*", code_points(F.col("text")).alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain_pct)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_pct, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.abs(one - two).alias("m"))
    pattern = F.concat(F.lit("(?s)^(.{"), F.col("a").cast("string"), F.lit("}+)(.{"), F.col("m").cast("string"), F.lit("}+)(.*+)"))
    pre, suf, mid = (_quoted(m) for m in marks)
    order = F.when(F.col("form") == "psm", F.lit(f"{pre}$1{suf}$3{mid}$2")).otherwise(F.lit(f"{suf}$3{pre}$1{mid}$2"))
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("m")).alias("middle_chars"),
        F.when(cut, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text, from output and form alone: no text that was cut holds a mark, so that each stands there once."""
    pre, suf, mid = (_quoted(m) for m in marks)
    psm = F.regexp_replace(output, F.lit(f"(?s)^{pre}(.*?){suf}(.*?){mid}(.*+)"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)^{suf}(.*?){pre}(.*?){mid}(.*+)"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents),
u as (
  select doc_id, text, length(text)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from d
), f as (
  select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as a, abs(h1 % (n + 1) - h2 % (n + 1)) as m,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from u
), o as (
  select *, case form when 'plain' then text
    when 'psm' then '<P>' || substring(text, 1, a) || '<S>' || substring(text, a + m + 1) || '<M>' || substring(text, a + 1, m)
    else '<S>' || substring(text, a + m + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, m) end as output
  from f
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then m end as middle_chars,
  sha256(output) as output_sha256, sha256(text) as restored_sha256
from o
"""
