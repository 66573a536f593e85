"""Set-similarity self-join on word n-grams with grouped prefixes.

Shingles are ordered by how often their sketch slot occurs in the corpus, rare first; sets that are similar enough must
then share one of each other's first ``n - ceil(t n) + 1`` shingles. Documents with the same set form a class, classes
with the same prefix and size a group, and only groups enter the prefix index. Pairs of groups pass the size, position
and bitmap filters, none of which loses a link; of the pairs inside a group of near copies only so many are kept that
its members hang together. Each component of candidates is expanded to its members and verified exactly, in blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.window import Window

from veriskill.llm.common import LOWER_TABLE, column, discard, materialize, shuffle_partitions, table
from veriskill.llm.components import connected_components

WORDS, PERCENT = 3, 90
SLICE = 1 << 14
#: Partial sketches that one task adds up.
FAN_IN = 64
#: A shingle that more groups share is hot.
PAIRED = 16
#: Hot shingles, 8 bytes each, are broadcast up to this number.
HOT_BROADCAST = 1 << 20
#: Members of candidate components, some 60 bytes each, likewise.
MEMBER_BROADCAST = 1 << 18
#: Rows before it that a row of a hot shingle is compared with first, and rows of a block in the comparison of all.
LAGS, HOT_BLOCK = 8, 256
#: Bits of a set's bitmap, each the parity of the shingles that fall on it.
BITS = 1024
#: Members of a verification block.
BLOCK = 256

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; keeps a bounded cache of word hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(LOWER_TABLE).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > 250_000:
            cache.clear()
        found = list(map(cache.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = cache[words[i]] = xxhash.xxh64_intdigest(words[i])
        h = np.array(found, np.uint64)
        n = min(self.words, len(h))
        x = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            x = x * _A + h[k : len(h) - n + 1 + k]
            x ^= x >> np.uint64(29)
        x = (x + np.uint64(n)) * _B
        x ^= x >> np.uint64(32)
        return np.unique(x * _C)


def _slot(shingles: np.ndarray, slots: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def frequency_sketch(rows: DataFrame, words: int, slots: int) -> np.ndarray:
    """Documents' shingles by slot over the whole corpus, as one byte of eighth-octaves each: a fixed size at any scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingle, total, pending, held = Shingler(words), np.zeros(slots, np.uint32), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pending.append(_slot(shingle(text), slots))
                held += len(pending[-1])
                if held > 1 << 20:
                    np.add(total, np.bincount(np.concatenate(pending), minlength=slots), out=total, casting="unsafe")
                    pending, held = [], 0
        if pending:
            np.add(total, np.bincount(np.concatenate(pending), minlength=slots), out=total, casting="unsafe")
        parts = [(k, total[k * SLICE : (k + 1) * SLICE].astype(np.uint64)) for k in range(slots // SLICE)]
        task = TaskContext.get().partitionId()
        yield _packed([(k, task, c) for k, c in parts if c.any()])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.uint64)
        for c in group.column("c").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint64)
        return pa.Table.from_batches([_packed([(key[0].as_py(), key[1].as_py(), total)])])

    schema = "k int, task int, c binary"
    tasks = max(1, rows.rdd.getNumPartitions())
    partial = rows.mapInArrow(count, schema)
    while True:
        partial = partial.select("k", F.floor(F.col("task") / FAN_IN).cast("int").alias("task"), "c").groupBy("k", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            break
    total = np.zeros(slots)
    for r in partial.collect():  # slots / SLICE rows
        total[r.k * SLICE : (r.k + 1) * SLICE] = np.frombuffer(zlib.decompress(bytes(r.c)), np.uint64)
    return np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)


def _packed(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.int32()), pa.array([zlib.compress(x[2].tobytes(), 1) for x in parts], pa.binary())], ["k", "task", "c"])


def _index(rows: DataFrame, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """``doc_id, th, n, h1, h2, bitmap, prefix`` of each row: hash of the text, set size, two hashes of the set, parities, prefix in index order."""
    shared, slots = rows.sparkSession.sparkContext.broadcast(sketch), len(sketch)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, often = Shingler(words), shared.value
        for batch in batches:
            n, h1, h2, prefix, bits = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle(text)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(np.bitwise_xor.reduce(s * _A ^ (s >> np.uint64(17)) * _B).view(np.int64)) if len(s) else 0)
                bits.append(np.packbits(np.bincount((s >> np.uint64(23)).astype(np.int64) % BITS, minlength=BITS) & 1).view(np.int64))
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                order = np.argsort(often[_slot(s, slots)], kind="stable")[:p]
                prefix.append(s[order].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), lists], ["doc_id", "th", "n", "h1", "h2", "bitmap", "prefix"])

    schema = StructType([rows.schema["doc_id"], rows.schema["th"]])
    for name, kind in (("n", "long"), ("h1", "long"), ("h2", "long"), ("bitmap", ArrayType(LongType())), ("prefix", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    return rows.mapInArrow(encode, schema)


def _verify(words: int, percent: int):
    """Links among the members of one block, or between those of two: each member's smallest linked root and its linked documents."""

    def check(key: tuple, group: pa.Table) -> pa.Table:
        _, bi, bj = (k.as_py() for k in key)
        shingle = Shingler(words)
        ids, own = group.column("cls").to_numpy(), group.column("own").to_numpy()
        copies = group.column("copies").to_numpy()
        sets = [shingle(t) for t in group.column("text").to_pylist()]
        links = linked(sets, percent)
        if bi != bj:
            links &= own[:, None] != own[None, :]
        root = np.arange(len(ids))
        while True:  # smallest index along links
            down = np.where(links, root[None, :], len(ids)).min(axis=1, initial=len(ids))
            new = np.minimum(root, down)
            new = new[new]
            if (new == root).all():
                break
            root = new
        counts = (links * copies[None, :]).sum(axis=1)
        keep = np.flatnonzero(counts > 0)
        return pa.table({"a": pa.array(ids[keep]), "b": pa.array(ids[root[keep]]), "links": pa.array(counts[keep].astype(np.int64))})

    return check


def linked(sets: list[np.ndarray], percent: int, columns: int = 1 << 15) -> np.ndarray:
    """Boolean matrix of pairs with ``100 * intersection >= percent * union``, without the diagonal."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(m), sizes)
    value, where, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = times[where] > 1
    who, where = who[shared], (np.cumsum(times > 1) - 1)[where[shared]]
    common = np.zeros((m, m), np.int64)
    order = np.argsort(where, kind="stable")
    who, where = who[order], where[order]
    at = 0
    while at < len(where):
        first = where[at]
        end = int(np.searchsorted(where, first + columns))
        x = np.zeros((m, int(where[end - 1] - first) + 1), np.float32)
        x[who[at:end], where[at:end] - first] = 1
        common += (x @ x.T).astype(np.int64)
        at = end
    union = sizes[:, None] + sizes[None, :] - common
    out = (100 * common >= percent * union) & (sizes > 0)[:, None] & (sizes > 0)[None, :]
    np.fill_diagonal(out, False)
    return out


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of groups; a component keeps every candidate pair of groups together.

    Shingles of few groups pair them through the filters. Those of many groups are hot: neighbours by size come first,
    and only where a hot shingle still joins different components are its groups compared, block by block, by the same
    filters. Neither writes out the pairs of a group of near copies.
    """
    groups = classes.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("classes"), F.first(F.struct("bitmap", "prefix")).alias("s"))
    groups = materialize(groups.select("gid", "n", F.when(F.col("classes") == 1, F.col("s.bitmap")).alias("bitmap"), "s.prefix"), "shingle-groups")
    tokens = groups.select("gid", "n", F.posexplode("prefix").alias("place", "token"))
    hot = _small(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_g")).where(F.col("_g") > PAIRED).select("token"), "hot-shingles")
    edges = materialize(_pairs(groups, tokens.join(hot, "token", "left_anti"), percent), "cold-pairs")
    if hot.isEmpty():
        return connected_components(edges)
    rows = materialize(tokens.join(hot, "token").select("token", "gid", "n", "place"), "hot-rows")
    bitmaps = groups.select("gid", "bitmap")
    firsts = rows.groupBy("gid").agg(F.min(F.struct("place", "token", "n")).alias("x")).select("gid", "x.*").join(bitmaps, "gid")
    close = firsts.repartitionByRange(shuffle_partitions(rows.sparkSession), "token", "n", "gid").sortWithinPartitions("token", "n", "gid").mapInArrow(_neighbours(percent), "a long, b long")
    first = connected_components(edges.unionByName(close))
    labelled = rows.join(first.withColumnRenamed("node", "gid"), "gid", "left").withColumn("label", F.coalesce("component", "gid")).drop("component")
    labelled = materialize(labelled, "labelled-rows")
    found = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_hot_edges(labelled, bitmaps, percent)))
    for written in (rows, labelled, groups, edges):
        discard(written)
    return found


def _small(df: DataFrame, label: str, most: int = HOT_BROADCAST) -> DataFrame:
    """A table, written and, up to the checked number of rows, broadcast."""
    df = materialize(df, label)
    return F.broadcast(df) if df.count() <= most else df


def _pairs(groups: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups ``a, b`` that share one of the tokens, which few groups have, and pass the filters."""
    by_size = Window.partitionBy("token").orderBy("n", "gid")
    smaller = F.collect_list(F.struct("gid", "n", "place")).over(by_size.rowsBetween(-PAIRED, -1))
    placed = tokens.select("gid", "n", "place", smaller.alias("smaller"))

    def passes(x: Column) -> Column:
        # The shingles after this one bound what else can be shared, if this is the first that is.
        most = 1 + F.least(F.col("n") - F.col("place") - 1, x["n"] - x["place"] - 1)
        return (x["n"] * 100 >= F.col("n") * percent) & (most * (100 + percent) >= percent * (F.col("n") + x["n"]))

    pairs = placed.where(F.size("smaller") > 0).select("gid", F.explode(F.filter("smaller", passes)).alias("x")).where(F.col("x.gid") != F.col("gid"))
    pairs = pairs.select(F.col("gid").alias("a"), F.col("x.gid").alias("b")).distinct()
    one, two = (groups.select(F.col("gid").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"m_{k}")) for k in "ab")
    differ = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = F.col("m_a").isNull() | F.col("m_b").isNull() | (differ * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


class _Rows:
    """Columns of hot rows as arrays, and the filters for pairs of them."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, percent: int):
        self.percent = percent
        self.gid, self.n, self.place, self.token = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "n", "place", "token"))
        lists = batch.column("bitmap")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.known = lists.is_valid().to_numpy(zero_copy_only=False)
        self.bits = np.zeros((len(self.gid), BITS // 64), np.uint64)
        self.bits[self.known] = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs pass the bitmap filter."""
        out = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            differ = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(axis=1, dtype=np.int64)
            out[at : at + len(x)] = (differ * (100 + self.percent) <= (100 - self.percent) * (self.n[x] + self.n[y])) | ~self.known[x] | ~self.known[y]
        return out

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs pass the size and position filters; the arrays may be of shapes that broadcast."""
        a, b, p = self.n[i], self.n[j], self.percent
        most = 1 + np.minimum(a - self.place[i] - 1, b - self.place[j] - 1)
        return (np.minimum(a, b) * 100 >= np.maximum(a, b) * p) & (most * (100 + p) >= p * (a + b))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def _neighbours(percent: int):
    """Edges between rows of one hot shingle that stand close together by size and pass the filters."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch, percent)
            for lag in range(1, LAGS + 1):
                i = np.arange(lag, len(rows.gid))
                i = i[(rows.token[i] == rows.token[i - lag]) & rows.fits(i, i - lag)]
                i = i[rows.near(i, i - lag)]
                yield _edges(rows.gid[i], rows.gid[i - lag])

    return link


def _hot_edges(rows: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that join groups of different labels which share a hot shingle and pass the filters.

    Sizes that can link fall into one or two adjacent buckets; a row meets the others of its bucket and those of the
    next smaller one. Each such meeting is split into blocks of bounded size.
    """
    bucket = F.floor(F.log("n") / max(1e-3, math.log(100 / percent) * 1.0001)).cast("int")
    mixed = _small(rows.groupBy("token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("token"), "mixed-shingles")
    own, next_ = F.struct(bucket.alias("k"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("k"), F.lit(False).alias("own"))
    keyed = rows.join(mixed, "token", "left_semi").select("token", "gid", "n", "place", "label", F.explode(F.array(own, next_)).alias("m")).select("*", "m.*").drop("m")
    meets = keyed.groupBy("token", "k").agg(F.count(F.lit(1)).alias("_m"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("own").alias("_own"))
    blocks = F.ceil(F.col("_m") / HOT_BLOCK).cast("int")
    meets = _small(meets.where(F.col("_own") & (F.col("_lo") < F.col("_hi"))).select("token", "k", blocks.alias("blocks")), "meetings")
    dealt = keyed.join(meets, ["token", "k"]).join(bitmaps, "gid").withColumn("block", F.pmod(F.xxhash64("gid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    key = ["token", "k", "bi", "bj"]
    dealt = dealt.select(*key, "gid", "n", "place", "bitmap", "label", "own", "block").repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_key(batches, key):
            rows, label, own, block, bi, bj = _Rows(part, percent), *(part.column(c).to_numpy() for c in ("label", "own", "block", "bi", "bj"))
            everyone, within = np.arange(len(label)), bi[0] == bj[0]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, len(label), 128):
                i = everyone[at : at + 128, None]
                ok = (label[i] != label) & (own[i] | own) & (within | (block[i] != block)) & rows.fits(i, everyone[None])
                x, y = np.nonzero(ok)
                x += at
                once = x < y
                x, y = x[once], y[once]
                near = rows.near(x, y)
                a.append(x[near])
                b.append(y[near])
            root = _roots(len(label), np.concatenate(a), np.concatenate(b))
            moved = np.flatnonzero(root != everyone)
            yield _edges(rows.gid[moved], rows.gid[root[moved]])

    return dealt.mapInArrow(compare, "a long, b long")


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which come one after the other."""
    held, at_key = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy() for k in key]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            k = tuple(c[start] for c in columns)
            if held and k != at_key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
            at_key = k
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``m`` reaches over the edges."""
    root = np.arange(m)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, slots: int | None, block: int) -> tuple[DataFrame, DataFrame]:
    """The index, a row for each row, and ``h1, h2, n, rep, copies, component_id, group, n_links`` of each class of equal sets."""
    rows = docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("th"), column(text_col).alias("text"))
    slots = slots or 1 << min(24, max(22, math.ceil(math.log2(16 * max(1, docs.count())))))
    sketch = frequency_sketch(rows.select("text"), words, slots)
    index = materialize(_index(rows, words, percent, sketch), "shingle-index")
    node = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = index.where(node).groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("bitmap", "prefix")).alias("s"))
    classes = classes.select("h1", "h2", "n", "rep", "copies", "s.*", F.monotonically_increasing_id().alias("cls"))
    classes = materialize(classes.withColumn("gid", F.xxhash64("n", "prefix")), "shingle-classes")

    labels = _candidates(classes.select("cls", "gid", "n", "bitmap", "prefix"), percent)
    member = classes.select("cls", "rep", "copies", "gid").join(labels.withColumnRenamed("node", "gid"), "gid", "left").select("cls", "rep", "copies", F.coalesce("component", "gid").alias("label"))
    sizes = member.groupBy("label").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    blocks = F.ceil(F.col("_m") / block).cast("int")
    member = member.join(sizes, "label").select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "copies", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("own"))
    texts = rows.where(F.col("doc_id").isNotNull()).join(_small(member, "shingle-members", MEMBER_BROADCAST), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = texts.select("cls", "text", "copies", "label", "own", other)
    dealt = dealt.select("cls", "text", "copies", "label", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    found = materialize(dealt.groupBy("label", "bi", "bj").applyInArrow(_verify(words, percent), "a long, b long, links long"), "shingle-links")
    components = connected_components(found).withColumnRenamed("node", "cls")
    components = components.unionByName(components.select(F.col("component").alias("cls"), "component").distinct()).join(classes.select("cls", "rep"), "cls")
    least = components.groupBy("component").agg(F.min("rep").alias("best"))
    components = components.join(least, "component").select("cls", "best")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    every = classes.select("h1", "h2", "n", "rep", "copies", "cls").join(components, "cls", "left").join(links, "cls", "left")
    every = every.select("h1", "h2", "n", "copies", F.coalesce("best", "rep").alias("best"), F.col("best").isNotNull().alias("linked"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return index.withColumn("node", node), every


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, slots: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, n_links``.

    Documents link when their sets of distinct ``words``-word shingles have a Jaccard similarity of at least
    ``percent`` hundredths; a shorter text is one shingle. ``component_id`` is the smallest id that links reach,
    ``n_links`` the number of other rows linked directly. Null and wordless texts have no shingles and link with
    nothing: the component is the own id. Rows without an id take no part and have no component. Repeated rows are
    copies of each other; rows that share an id but not a text are documents of their own. Ids are of any type that
    has an order. A very long text gives all of its shingles, in one task. Other columns are ignored, whatever their
    names; empty tables stay empty.
    """
    index, classes = _linked(docs, id_col, text_col, words, percent, slots, block)
    alone = index.where("not node").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    found = index.where("node").select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), "n_links")
    return found.unionByName(alone)


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, slots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest hash of the text; columns unchanged.

    Rows are judged by themselves, not by their id: another text under the same id stays. Of rows that repeat id and
    text one stays. Rows without an id or without words stay.
    """
    index, classes = _linked(docs, id_col, text_col, words, percent, slots, block)
    several = index.where("node").select("doc_id", "th", "h1", "h2", "n").join(classes.where("linked or copies > 1"), ["h1", "h2", "n"])
    verdict = materialize(several.groupBy("doc_id", "th").agg(F.first(F.col("best.doc_id") != F.col("doc_id")).alias("_later"), F.first(F.col("best.th") != F.col("th")).alias("_other"), F.count(F.lit(1)).alias("_n")), "near-copies")
    gone = verdict.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), (F.col("_later") | F.col("_other")).alias("_gone"), (F.col("_n") > 1).alias("_many")).where("_gone or _many")
    rows = docs.select(F.struct("*").alias("_row"), column(id_col).alias("_id"), F.xxhash64(column(text_col)).alias("_th"))
    few = lambda df: F.broadcast(df) if df.count() <= MEMBER_BROADCAST else df
    gone, many = few(gone.where("_gone").drop("_gone", "_many")), gone.where("not _gone").drop("_gone", "_many")
    kept = rows.join(gone, ["_id", "_th"], "left_anti")
    if not many.isEmpty():
        many = few(many)
        kept = kept.join(many, ["_id", "_th"], "left_anti").unionByName(kept.join(many, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]))
    return kept.select("_row.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT s.doc_id, len(g) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(k, 0) AS n_links
FROM s LEFT JOIN comp ON s.doc_id = comp.node LEFT JOIN deg ON s.doc_id = deg.a
"""
