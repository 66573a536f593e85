"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and put into automata of bounded size. Training words stream
through them; the automaton's state and the tracked length give the longest item substring that ends at each word. Where
that length reaches the window, the window's words are hit, and the state names the items that hold it. Stretches
whose adjacent word pairs occur in no item cannot reach a window and are skipped before streaming.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from veriskill.llm.common import WORD_TABLE, column, map_arrow, materialize, table

WINDOW = 10
#: Item words in one automaton; more items make more shards, for all of which one pass over the documents serves.
SHARD_WORDS = 250_000
#: Tasks among which the documents' stretches for one shard are dealt, each with an automaton of its own.
SHARD_TASKS = 16
#: Bits of a slot of the pair filter.
SLOT_BITS = 20
#: Name of a column that no input has.
AGAIN = "__cut_again__"
#: Longer items are cut into overlapping pieces, so that no single item outgrows a shard.
PIECE_WORDS = 5_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences; no match spans two of them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        self.width = len(self.vocab) + 1  # the last id is any other word
        self.edges: dict[int, int] = {}
        self.link, self.length, self._out = [-1], [0], [[]]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        self._name_windows(coded)
        self.pairs = np.zeros(1 << 20, bool)
        for _, ids in coded:
            a = np.array(ids, np.int64)
            self.pairs[self._slots(a[:-1], a[1:])] = True
        del self._out

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * self.width + b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def _state(self, length: int, link: int, out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that fit below p, which takes over p's edges to q."""
        copy = self._state(self.length[p] + 1, self.link[q], list(self._out[q]))
        for x in self._out[q]:
            self.edges[copy * self.width + x] = self.edges[q * self.width + x]
        self.link[q] = copy
        while p >= 0 and self.edges.get(p * self.width + w) == q:
            self.edges[p * self.width + w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        edges, width = self.edges, self.width
        q = edges.get(last * width + w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, [])
        p = last
        while p >= 0 and p * width + w not in edges:
            edges[p * width + w] = new
            self._out[p].append(w)
            p = self.link[p]
        if p >= 0:
            q = edges[p * width + w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _name_windows(self, coded: list[tuple[str, list[int]]]) -> None:
        """long: state of a full window -> items; short: state -> (length, items) of whole short items that end there or at a suffix."""
        longs: dict[int, set[str]] = {}
        shorts: dict[tuple[int, int], set[str]] = {}
        for item, ids in coded:
            at = 0
            for n, w in enumerate(ids, 1):
                at = self.edges[at * self.width + w]
                if n >= self.window:
                    longs.setdefault(self.window_state(at), set()).add(item)
            if len(ids) < self.window:
                while self.length[self.link[at]] >= len(ids):
                    at = self.link[at]
                shorts.setdefault((at, len(ids)), set()).add(item)
        self.long = {k: frozenset(v) for k, v in longs.items()}
        own: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for (state, n), names in shorts.items():
            own.setdefault(state, []).append((n, frozenset(names)))
        self.short: dict[int, list[tuple[int, frozenset[str]]]] = {}
        if own:
            for state in range(1, len(self.length)):
                chain, at = [], state
                while at > 0:
                    chain += own.get(at, [])
                    at = self.link[at]
                if chain:
                    self.short[state] = sorted(chain, key=lambda x: -x[0])

    def window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word spans (merged, end exclusive) and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        least = self.shortest
        if len(words) < least:
            return spans, items
        ids = list(map(self.vocab.get, words))
        if least > 1:
            a = np.array([self.width - 1 if x is None else x for x in ids], np.int64)
            ok = np.concatenate(([False], self.pairs[self._slots(a[:-1], a[1:])], [False]))
            turns = np.flatnonzero(ok[1:] != ok[:-1]).reshape(-1, 2)  # runs of known pairs
            runs = [(int(i), int(j) + 1) for i, j in turns if j - i + 1 >= least]
        else:
            runs = [(0, len(ids))]
        for i, j in runs:
            self._stream(ids, i, j, spans, items)
        return spans, items

    def _stream(self, ids: list[int | None], i: int, j: int, spans: list[list[int]], items: set[str]) -> None:
        edges, width, link, length, window = self.edges, self.width, self.link, self.length, self.window
        state = matched = 0
        for p in range(i, j):
            w = ids[p]
            if w is None:
                state = matched = 0
                continue
            while state and state * width + w not in edges:
                state = link[state]
                matched = length[state]
            state = edges.get(state * width + w, 0)
            matched = matched + 1 if state else 0
            if matched < self.shortest:
                continue
            reach = 0
            if matched >= window:
                reach = window
                items |= self.long[self.window_state(state)]
            for n, names in self.short.get(state, ()):
                if n <= matched:
                    reach = max(reach, n)
                    items |= names
            if reach:
                start = p + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, p + 1])


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Item words, cut into overlapping pieces where an item is very long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str, int]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    if piece:
                        out.append((item, b" ".join(piece).decode(), len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["item", "words", "n"])

    return items.select(column(id_col).cast("string").alias("i"), column(text_col).alias("t")).mapInArrow(cut, "item string, words string, n long")


def pair_slots(words: list[bytes]) -> np.ndarray:
    """A slot of the pair filter for each two neighbours."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _shard_filters(pieces: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Of each shard the fewest words of a window and the pair filter: 128 kB for a shard of a test set."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        bits, least = np.zeros(1 << SLOT_BITS, bool), PIECE_WORDS
        for words in group.column("words").to_pylist():
            words = words.encode().split()
            least = min(least, len(words))
            bits[pair_slots(words)] = True
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "least": pa.array([least], pa.int32()), "bits": [np.packbits(bits).tobytes()]})

    found = pieces.groupBy("shard").applyInArrow(build, "shard int, least int, bits binary").collect()
    return {r.shard: (r.least, np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)).view(bool)) for r in found}


def _stretches(words: list[bytes], filters: dict[int, tuple[int, np.ndarray]], window: int) -> list[tuple[int, int, str]]:
    """Shard, first word and words of each run of known pairs that is long enough for a window of the shard."""
    out = []
    if not words:
        return out
    slots = pair_slots(words)
    for shard, (least, bits) in filters.items():
        least = min(least, window)
        if least == 1:
            out.append((shard, 0, b" ".join(words).decode()))
            continue
        ok = np.concatenate(([False], bits[slots], [False]))
        for i, j in np.flatnonzero(ok[1:] != ok[:-1]).reshape(-1, 2).tolist():
            if j - i + 1 >= least:
                out.append((shard, i, b" ".join(words[i : j + 1]).decode()))
    return out


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _pass(rows: DataFrame, pieces: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """One pass of all rows (with a column ``text``) for all shards: the rows with ``_row, n_words``, without their text, and the hits ``_row, spans, item_ids``.

    Stretches that a shard's pair filter lets through go to the shard's automaton, which is built where they meet it.
    """
    filters = rows.sparkSession.sparkContext.broadcast(_shard_filters(pieces))
    keys = [f for f in rows.schema if f.name != "text"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("shard", pa.int32()), ("start", pa.int32()), ("words", pa.string())]))
            found = [[dict(zip(("shard", "start", "words"), x, strict=True)) for x in _stretches(w, known, window)] for w in words]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array([len(w) for w in words], pa.int64()), pa.array(found, kind)], [*(f.name for f in keys), "n_words", "stretches"])

    struct = StructType().add("shard", "integer").add("start", "integer").add("words", "string")
    probed = rows.mapInArrow(probe, StructType([*keys]).add("n_words", "long").add("stretches", ArrayType(struct)))
    probed = materialize(probed.withColumn("_row", F.monotonically_increasing_id()), "probed")
    parts = F.pmod(F.xxhash64("_row"), F.lit(SHARD_TASKS)).cast("int")
    sent = probed.where(F.size("stretches") > 0).select("_row", parts.alias("part"), F.explode("stretches").alias("x")).select("_row", "part", "x.*")
    tests = pieces.select("item", "words", "shard", F.explode(F.sequence(F.lit(0), F.lit(SHARD_TASKS - 1))).alias("part"))

    def scan(key: tuple, stretches: pa.Table, items: pa.Table) -> pa.Table:
        out: dict[int, tuple[list[list[int]], set[str]]] = {}
        if stretches.num_rows:
            named = zip(items.column("item").to_pylist(), items.column("words").to_pylist(), strict=True)
            find = ItemAutomaton([("\0" if i is None else i, w.encode().split()) for i, w in named], window)
            for row, start, words in zip(*(stretches.column(c).to_pylist() for c in ("_row", "start", "words")), strict=True):
                spans, names = find.scan(words.encode().split())
                if spans:
                    own = out.setdefault(row, ([], set()))
                    own[0].extend([s + start, e + start] for s, e in spans)
                    own[1].update(names)
        spans = pa.array([x[0] for x in out.values()], pa.list_(pa.list_(pa.int32())))
        return pa.table({"_row": pa.array(list(out), pa.int64()), "spans": spans, "item_ids": pa.array([sorted(x[1] - {"\0"}) for x in out.values()], pa.list_(pa.string()))})

    hits = sent.groupBy("shard", "part").cogroup(tests.groupBy("shard", "part")).applyInArrow(scan, "_row long, spans array<array<int>>, item_ids array<string>")
    hits = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([merged(x) for x in batch.column(1).to_pylist()], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, batch.column(2)], ["_row", "spans", "item_ids"])

    return probed.drop("stretches"), materialize(hits.mapInArrow(merge, hits.schema), "hits")


def _sharded(pieces: DataFrame, shard_words: int) -> tuple[DataFrame, int]:
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    return pieces.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int")), shards


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, spans array<array<int>>, item_ids array<string>``.

    A window is ``window`` consecutive words of an item, or a whole shorter item; spans are merged runs of document
    words inside occurrences of windows. Null or wordless documents have no words and no spans; null or wordless items
    are never found; an item without an id hits but is not listed; equal ids are listed once. Repeated rows each get a
    row; a very long text is followed whole, word by word. Other columns are ignored, whatever their names. No items, or no documents, give no hits or no rows.
    """
    pieces = materialize(_pieces(items, item_id_col, item_text_col, window), "benchmark-pieces")
    pieces, shards = _sharded(pieces, shard_words)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    if shards == 1:
        return _scanned(rows, pieces, window)
    every, hits = _pass(rows, pieces, window)
    none = (F.array().cast("array<array<int>>"), F.array().cast("array<string>"))
    return every.join(hits, "_row", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("item_ids", none[1]).alias("item_ids"))


def _automaton(pieces: DataFrame, window: int) -> ItemAutomaton:
    found = [(r.item, r.words.encode().split()) for r in pieces.select("item", "words").collect()]  # one shard at most
    return ItemAutomaton([("\0" if i is None else i, w) for i, w in found], window)


def _scanned(rows: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    automaton = rows.sparkSession.sparkContext.broadcast(_automaton(pieces, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton.value
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                s, i = find.scan(words)
                n.append(len(words))
                spans.append(s)
                items.append(sorted(i - {"\0"}))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "spans", "item_ids"])

    return rows.mapInArrow(scan, StructType([rows.schema["doc_id"]]).add("n_words", "long").add("spans", ArrayType(ArrayType(IntegerType()))).add("item_ids", ArrayType(StringType())))


def remove_contamination(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.3, shard_words: int | None = None
) -> DataFrame:
    """``docs`` with the hit spans cut from their texts and, where hits cover more than ``max_coverage`` of the words, without the row.

    Untouched documents pass through unchanged, all columns kept, whatever their names. Hits of all items count
    together, however many shards they make. A cut replaces the bytes from the first to the last word of a span by one
    space and is repeated over all items until no window is left; only the first look drops rows. Null and wordless
    texts stay, repeated rows fare alike. ``n_chars``, where there is such a column, follows.
    """
    pieces = materialize(_pieces(items, item_id_col, item_text_col, window), "benchmark-pieces")
    pieces, shards = _sharded(pieces, shard_words or SHARD_WORDS)
    if shards == 1:
        return _cut(docs, pieces, text_col, window, max_coverage)
    ready, todo, limit = [], docs, max_coverage
    while True:
        judged = materialize(_cut_spans(todo, _spans(todo, pieces, text_col, window), text_col, limit), "cut")
        ready.append(judged.where(~F.col(AGAIN)).drop(AGAIN))
        todo, limit = judged.where(AGAIN).drop(AGAIN), None
        if todo.isEmpty():
            break
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def _text_keys(text_col: str) -> list:
    text = column(text_col)
    return [F.xxhash64(text).alias("_h"), F.hash(text).alias("_g"), F.char_length(text).alias("_l")]


def _spans(docs: DataFrame, pieces: DataFrame, text_col: str, window: int) -> DataFrame:
    """Merged spans of all shards of items, for each text that has any."""
    keys = ["_h", "_g", "_l"]
    rows = docs.where(column(text_col).isNotNull()).select(column(text_col).alias("text"), *_text_keys(text_col))
    every, hits = _pass(rows, pieces, window)
    return every.join(hits, "_row").groupBy(*keys).agg(F.first("spans").alias("_spans"))


def _cut_spans(docs: DataFrame, spans: DataFrame, text_col: str, max_coverage: float | None) -> DataFrame:
    """``docs`` without the spans and, where there is a limit, without rows beyond it; :data:`AGAIN` tells whether a text was cut."""
    columns = docs.columns
    joined = docs.select(F.struct("*").alias("_row"), *_text_keys(text_col)).join(spans, ["_h", "_g", "_l"], "left").select("_row.*", F.col("_spans").alias(AGAIN))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, again = batch.column(text_col).to_pylist(), [], []
            for i, here in enumerate(batch.column(AGAIN).to_pylist()):
                again.append(bool(here))
                keep.append(not here or max_coverage is None or sum(e - s for s, e in here) <= max_coverage * len(words_of(texts[i])))
                if here and keep[-1]:
                    texts[i] = cut_words(texts[i], here)
            new = {text_col: texts}
            if "n_chars" in columns:
                new["n_chars"] = [len(t) if a else n for t, a, n in zip(texts, again, batch.column("n_chars").to_pylist(), strict=True)]
            arrays = [pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(again, pa.bool_())], [*columns, AGAIN]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(joined, clean, StructType([*docs.schema.fields]).add(AGAIN, "boolean"))


def _cut(docs: DataFrame, pieces: DataFrame, text_col: str, window: int, max_coverage: float) -> DataFrame:
    automaton = docs.sparkSession.sparkContext.broadcast(_automaton(pieces, window))
    columns = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton.value
        for batch in batches:
            was, keep = batch.column(text_col).to_pylist(), []
            texts = list(was)
            for i, text in enumerate(texts):
                words = words_of(text)
                spans, _ = find.scan(words)
                keep.append(sum(e - s for s, e in spans) <= max_coverage * len(words))
                while spans and keep[-1]:
                    texts[i] = cut_words(texts[i], spans)
                    spans, _ = find.scan(words_of(texts[i]))
            new = {text_col: texts}
            if "n_chars" in columns:
                new["n_chars"] = [n if t is w else len(t) for t, w, n in zip(texts, was, batch.column("n_chars").to_pylist(), strict=True)]
            if any(t is not w for t, w in zip(texts, was, strict=True)):
                for name, values in new.items():
                    field = batch.schema.field(name)
                    batch = batch.set_column(columns.index(name), field, pa.array(values, field.type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, clean, docs.schema)


def cut_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the given word spans."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0])))).reshape(-1, 2)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : edge[s][0]])
        at = int(edge[e - 1][1])
    return b" ".join([*out, raw[at:]]).decode()


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT rid, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM d),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 9)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g, least(len(w), 10) AS n
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM dw, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(p) WHERE len(w) >= n),
hits AS (SELECT rid, p, dg.n, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hits, unnest(generate_series(p, p + n - 1)) AS u(q) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
