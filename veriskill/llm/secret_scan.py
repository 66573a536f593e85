"""Secret scan by corpus-wide ownership frequency, in DataFrame operations only.

Three base kinds are matched by pattern. A fourth, ``token``, takes long mixed strings that no pattern names. Every
candidate value is hashed and counted over the corpus by distinct repositories and distinct owners: a value that many
owners share is an example copied from documentation, one that a single owner holds looks live. ``token`` spans count
as secrets only by that verdict; base spans always stay and merely carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriskill.llm.common import column, materialize, table, whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs of at least this many key characters are candidates of the kind ``token``.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "token")


def _matches(text: Column, kind: int, pattern: str, value_group: int) -> Column:
    """Matches in order as ``array<struct<kind, gap, length, valid, h>>``: code points since the last match and of the match, hash of the value.

    The pieces between matches and the matches themselves, laid end to end, give the positions.
    """
    gaps = F.split(text, pattern, -1)
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    v = lambda x: x["v"]
    valid = {0: lambda x: F.char_length(v(x)) >= 8, 3: lambda x: v(x).rlike("[0-9]") & v(x).rlike("[A-Za-z]") & ~v(x).rlike(r"^(.)\1*$")}.get(kind, lambda x: F.lit(True))
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("m"), value.alias("v"))
    found = F.transform(pieces, lambda x: F.struct(F.lit(kind).alias("k"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("length"), valid(x).alias("valid"), F.sha2(x["v"], 256).alias("h")))
    none = F.array().cast("array<struct<k:int,gap:int,length:int,valid:boolean,h:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def secret_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", max_owners: int = 1, max_repos: int = 50
) -> DataFrame:
    """One row per input row: ``doc_id, spans, n_live, n_copied`` with ``spans array<struct<s, k, e, live>>``.

    A span is ``live`` if at most ``max_owners`` distinct owners and ``max_repos`` distinct repositories hold its
    value; without a repository column, each distinct text is one, so that copies of a document count once. A null
    owner or repository counts as none, so a value held by null owners only is live. Spans are in order of start, then
    kind; ``token`` spans that overlap a base span are left out. Null and empty texts have no spans; a very
    long text is searched whole, its matches in one row. Repeated rows each get a row and count once in the statistics. Other columns are ignored, whatever their names.
    """
    text = whole_text(column(text_col))
    repo = column(repo_col).cast("string") if repo_col else F.xxhash64(text).cast("string")
    found = docs.select(column(id_col).alias("doc_id"), repo.alias("_repo"), column(owner_col).cast("string").alias("_owner"), text.alias("_t"))
    every = [_matches(F.col("_t"), k, p, g) for k, (p, g) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (TOKEN, 0)))]
    found = materialize(found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_repo", "_owner", *(x.alias(f"_{KINDS[k]}") for k, x in enumerate(every))), "secret-candidates")

    each = None
    for k in KINDS:
        part = found.where(F.size(f"_{k}") > 0).select("_row", "_repo", "_owner", F.posexplode(f"_{k}").alias("_pos", "_x")).select("_row", "_repo", "_owner", "_pos", "_x.*")
        each = part if each is None else each.unionByName(part)
    ends = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("_row", "k").orderBy("_pos")).cast("int")
    each = each.withColumn("e", ends).withColumn("s", F.col("e") - F.col("length")).where("valid")
    # A token that overlaps a base span is that span's own value.
    by_start = Window.partitionBy("_row").orderBy("s", "k")
    base = F.col("k") < 3
    before = F.max(F.when(base, F.col("e"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("s"))).over(Window.partitionBy("_row").orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.select("_row", "_repo", "_owner", "k", "s", "e", "h", before.alias("_before"), after.alias("_after"))
    own = (F.coalesce("_before", F.lit(0)) > F.col("s")) | (F.coalesce("_after", F.col("e")) < F.col("e"))
    each = materialize(each.where(base | ~own).select("_row", "_repo", "_owner", "k", "s", "e", "h"), "secret-spans")

    owners = each.select("h", "_owner").distinct().groupBy("h").agg(F.count("_owner").alias("_owners"))
    repos = each.select("h", "_repo").distinct().groupBy("h").agg(F.count("_repo").alias("_repos"))
    live = (F.col("_owners") <= max_owners) & (F.col("_repos") <= max_repos)
    # Written first, so that Spark can split the rows of a value that a large part of the corpus holds.
    judged = each.join(materialize(owners.join(repos, "h").select("h", live.alias("live")), "secret-owners"), "h")
    per_row = judged.groupBy("_row").agg(F.collect_list(F.struct("s", "k", "e", "live")).alias("spans"))
    out = found.select("_row", "doc_id").join(per_row, "_row", "left")
    spans = F.array_sort(F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int,live:boolean>>")))
    out = out.select("doc_id", spans.alias("spans"))
    n = lambda f: F.size(F.filter("spans", f)).cast("long")
    return out.select("doc_id", "spans", n(lambda x: x["live"]).alias("n_live"), n(lambda x: ~x["live"]).alias("n_copied"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, and with them the ``token`` spans that the ownership counts call live."""
    found = secret_scan(table(spark, sf_dir, "documents"))
    base, spans = F.filter("spans", lambda x: x["k"] < 3), F.filter("spans", lambda x: (x["k"] < 3) | x["live"])
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), "n_live", "n_copied"
    )
