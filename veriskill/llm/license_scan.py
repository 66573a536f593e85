"""Licence scan by Dice coefficient over word bigrams, in DataFrame operations only.

Texts and templates are normalised alike: lower case, runs of other than a-z and 0-9 become one space. A text is cut
into units at line ends and sentence ends; every run of units of a length in :data:`RUNS` is a candidate, so that a
notice is found inside a line, on several lines, between comment marks and in several paragraphs. A coefficient of
``t`` needs sizes within a factor of ``(2 - t) / t`` and at least ``t / (2 - t)`` of the template's bigrams. These bounds
prune soundly: texts without any of the words that every match must hold are left at once, then chunks of units that
hold too few bigrams of a template, then runs of another size; only the rest are compared.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.llm.common import column, materialize, table
from veriskill.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: Units in a candidate run.
RUNS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64)
#: Words too common to tell that a licence is near.
COMMON = frozenset("""a above all and any are as at be but by can copy do each either following for free from if in including is it its may must name no not of on one
option or other out own party source that the their this to under use used was with without work you your version file terms person public such""".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Units in lines: lower case a-z and 0-9 in single spaces."""
    split = F.regexp_replace(F.translate(text, UPPER, LOWER), r"([.!?;:])[ \t]+", "$1\n")
    return F.regexp_replace(split, r"[^a-z0-9\n]+", " ")


def bigrams(words: Column) -> Column:
    """Distinct word bigrams; a single word stands for itself."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(words)


@cache
def plain_templates(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[int, str, tuple[str, ...], int], ...]:
    """Number, licence, distinct bigrams and words of each template."""
    out = []
    for k, (name, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words
        out.append((k, name, tuple(dict.fromkeys(grams)), len(words)))
    return tuple(out)


@cache
def telling_words(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[str, ...]:
    """Words of which any match of any template holds at least one: more of its bigrams have one than a match may lack."""
    found: list[str] = []
    sizes = [(g, len(g) - math.ceil(threshold * len(g) / (2 - threshold) - 1e-9) + 1) for _, _, g, _ in plain_templates(templates)]
    while True:
        gain: dict[str, float] = {}
        for grams, need in sizes:
            without = [g for g in grams if set(found).isdisjoint(g.split())]
            if len(grams) - len(without) < need:
                words = [w for g in without for w in set(g.split())]
                for w in [w for w in words if w not in COMMON and not w.isdigit()] or words:
                    gain[w] = gain.get(w, 0) + 1 / need
        if not gain:
            return tuple(found)
        found.append(max(sorted(gain), key=gain.__getitem__))


def _runs(size: Column) -> Column:
    """Runs ``i, n`` that start in the first half of a chunk, or anywhere in the last one."""
    lengths = F.array(*map(F.lit, RUNS))
    of = lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= size), lambda n: F.struct(i.alias("i"), n.alias("n")))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.least(size, F.lit(max(RUNS)))), of))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per match and distinct (id, text): ``doc_id, text_hash, unit, units, license, dice``; ``unit`` counts from 0, blank ones left out.

    A run of units matches a template from ``threshold`` on; it has at most ``(2 - t) / t`` times the template's words
    and one. Of runs that overlap, those stay that are the best on all of their units: more shared bigrams, then the
    higher coefficient, the earlier start, the shorter run, the earlier template. Null, empty and wordless texts match
    nothing; a very long text is read whole, in chunks of units. Rows that repeat id and text count once here. Other columns are ignored, empty tables give no rows.
    """
    spark, factor, most = docs.sparkSession, (2 - threshold) / threshold, max(RUNS)
    known = plain_templates(templates)
    grams = spark.createDataFrame([(k, n, list(g), w) for k, n, g, w in known], "template int, license string, grams array<string>, t_words int")
    each = F.broadcast(grams.select("template", F.explode("grams").alias("gram")))  # the fixed templates
    telling = "|".join(telling_words(templates, threshold))
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("_t")).where(F.col("_t").rlike(f"(?i)(?<![a-z0-9])(?:{telling})(?![a-z0-9])"))
    rows = rows.select("doc_id", F.xxhash64("_t").alias("text_hash"), F.filter(F.transform(F.split(normalised(F.col("_t")), "\n"), lambda u: F.trim(u)), lambda u: u != "").alias("_u"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_u") - 1) / most).cast("int"))
    chunks = rows.where(F.size("_u") > 0).select("doc_id", "text_hash", F.posexplode(F.transform(starts, lambda k: F.slice("_u", k * most + 1, F.lit(2 * most)))).alias("chunk", "units"))
    chunks = chunks.where(F.array_join("units", " ").rlike(f"(?<![a-z0-9])(?:{telling})(?![a-z0-9])"))
    chunks = materialize(chunks.groupBy("doc_id", "text_hash", "chunk").agg(F.first("units").alias("units")), "license-chunks")

    key = ["doc_id", "text_hash", "chunk"]
    held = chunks.select(*key, F.explode(bigrams(F.split(F.array_join("units", " "), " "))).alias("gram")).join(each, "gram")
    least = F.broadcast(grams.select("template", F.ceil(F.size("grams") * threshold / (2 - threshold) - 1e-9).alias("least")))
    likely = held.groupBy(*key, "template").agg(F.count(F.lit(1)).alias("c")).join(least, "template").where(F.col("c") >= F.col("least")).select(*key, "template")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")) & (F.col("l.chunk") == F.col("r.chunk"))
    pairs = chunks.alias("l").join(likely.alias("r"), same).select("l.doc_id", "l.text_hash", "l.chunk", "units", "template").join(F.broadcast(grams), "template")
    words = F.transform("units", lambda u: F.size(F.split(u, " ")))
    ends = F.aggregate(words, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))  # at most two chunks' units
    pairs = pairs.withColumn("ends", ends)
    count = lambda r: F.element_at("ends", r["i"] + r["n"]) - F.element_at("ends", r["i"])
    fitting = F.filter(_runs(F.size("units")), lambda r: (count(r) <= F.ceil(factor * (F.col("t_words") + 1))) & (count(r) * factor + 1e-9 >= F.col("t_words") - 1))
    runs = pairs.select("doc_id", "text_hash", "chunk", "template", "license", "grams", F.explode(F.transform(fitting, lambda r: F.struct(r["i"].alias("i"), r["n"].alias("n"), F.array_join(F.slice("units", r["i"], r["n"]), " ").alias("s")))).alias("r"))
    sized = runs.select("doc_id", "text_hash", (F.col("chunk") * most + F.col("r.i") - 1).alias("unit"), F.col("r.n").alias("units"), "template", "license", "grams", bigrams(F.split("r.s", " ")).alias("g"))
    n, t = F.size("g"), F.size("grams")
    scored = sized.where((n <= t * factor + 1e-9) & (t <= n * factor + 1e-9)).withColumn("c", F.size(F.array_intersect("g", "grams"))).withColumn("dice", 2 * F.col("c") / (n + t)).where(F.col("dice") >= threshold)
    scored = materialize(scored.select("doc_id", "text_hash", "unit", "units", "template", "license", "c", "dice"), "license-runs")

    rank = F.struct("c", "dice", (-F.col("unit")).alias("u"), (-F.col("units")).alias("n"), (-F.col("template")).alias("t"))
    on = scored.select("doc_id", "text_hash", "unit", "units", "license", "dice", rank.alias("rank"), F.explode(F.sequence(F.col("unit"), F.col("unit") + F.col("units") - 1)).alias("at"))
    best = on.groupBy("doc_id", "text_hash", "at").agg(F.max_by(F.struct("unit", "units", "license", "dice"), "rank").alias("b"))
    wins = best.groupBy("doc_id", "text_hash", "b").agg(F.count(F.lit(1)).alias("won")).where(F.col("won") == F.col("b.units"))
    return wins.select("doc_id", "text_hash", "b.unit", "b.units", "b.license", "b.dice")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the licences found, in alphabetical order, the number of matching runs and the best coefficient."""
    docs = table(spark, sf_dir, "documents")
    found = license_scan(docs).groupBy("doc_id", "text_hash").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_segments"), F.round(F.max("dice"), 6).alias("best_dice")
    )
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash")), "left")
    return joined.select(F.col("_id").alias("doc_id"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_GRAMS = "CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END"
_FACTOR = (2 - THRESHOLD) / THRESHOLD
ORACLE_SQL = rf"""
WITH tpl AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_quoted(n)}, {_quoted(x)})" for k, (n, x) in enumerate(TEMPLATES))}) AS v(template, license, x)),
tw AS (SELECT template, license, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM tpl),
tg AS (SELECT template, license, len(w) AS t_words, {_GRAMS} AS g FROM tw),
te AS (SELECT template, license, t_words, len(g) AS t_size, unnest(g) AS bigram FROM tg),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
u AS (SELECT rid, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS us FROM d),
f AS (SELECT rid, list_transform(us, lambda x: string_split(x, ' ')) AS ws FROM u WHERE len(us) > 0),
s AS (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM f),
r AS (SELECT rid, i, n, flatten(ws[i:i + n - 1]) AS w FROM s, (SELECT unnest({list(RUNS)}) AS n) AS k WHERE i + n - 1 <= len(ws)),
rg AS (SELECT rid, i, n, len(w) AS words, {_GRAMS} AS g FROM r WHERE len(w) <= (SELECT max(ceil({_FACTOR!r}::DOUBLE * (t_words + 1))) FROM tg)),
re AS (SELECT rid, i, n, words, len(g) AS size, unnest(g) AS bigram FROM rg),
c AS (SELECT rid, i, n, template, license, count(*) AS c, 2.0::DOUBLE * count(*) / (size + t_size) AS dice FROM re JOIN te USING (bigram)
  WHERE words <= ceil({_FACTOR!r}::DOUBLE * (t_words + 1)) GROUP BY rid, i, n, template, license, size, t_size),
m AS (SELECT *, row_number() OVER () AS mid FROM c WHERE dice >= {THRESHOLD}::DOUBLE),
o AS (SELECT m.*, unnest(generate_series(i, i + n - 1)) AS p FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, p ORDER BY c DESC, dice DESC, i, n, template) AS pos FROM o),
w AS (SELECT rid, mid, any_value(license) AS license, any_value(dice) AS dice FROM b WHERE pos = 1 GROUP BY rid, mid, n HAVING count(*) = n),
z AS (SELECT rid, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, count(*) AS n_segments, round(max(dice), 6) AS best_dice FROM w GROUP BY rid)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_segments, 0) AS n_segments, coalesce(best_dice, 0) AS best_dice FROM d LEFT JOIN z USING (rid)
"""
