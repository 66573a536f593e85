"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Candidate merges wait in an agenda ordered by rank and position. A candidate is skipped if a mixing hash of the
segment's key, its merge and its place in the segment falls below the dropout rate; the key is a hash of the seed, the
document and the segment's place there. So equal documents give equal segmentations on any executor, and every
occurrence of a word draws its own.

Cached are only things without a key: how an agenda goes on from given skips. An outcome is a segment, the merges that
are skipped, the merges that are then taken, and the pieces; it holds for every key that skips the former and none of
the latter. A key that skips one of the merges taken leads on to the outcome where that one is skipped too. Outcomes
that are not cached run their agendas, many short ones side by side as array rounds, each taking every segment's best
candidate. Without dropout the result is the model's own. Every segmentation decodes to the exact input: characters
without a piece, among them a literal U+2581, become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from veriskill.llm.common import column, map_arrow, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = re.compile(r" *[^ ]+| +")
#: Cached segments of one worker, and as many outcomes of dropout again.
CACHE = 50_000
#: Longer segments run their agenda alone.
SHORT = 24
NEVER = 1 << 30
M32, M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF
#: Odd factors of the mixing hash.
BY_RANK, BY_PLACE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * MIX1) & M64
    x = ((x ^ (x >> 27)) * MIX2) & M64
    return x ^ (x >> 31)


def _step(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A merge and its place as one number, to which a key is added before mixing."""
    return rank.astype(np.uint64) * np.uint64(BY_RANK) + place.astype(np.uint64) * np.uint64(BY_PLACE)


class PieceCodec:
    """Vocabulary with merge ranks, as plain data that Spark can broadcast.

    Each segment of a text has its own 64-bit key, a hash of the seed, the document key and the segment's place.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], dropout: float = 0.1, seed: int = 1):
        """``pieces``: text (U+2581 for a space; empty for control and byte pieces) and score by id; ``byte_ids``: id by byte."""
        words = {p.replace("▁", " "): k for k, (p, _) in enumerate(pieces) if p}
        order = sorted(words.values(), key=lambda k: (-pieces[k][1], k))
        rank = {k: r for r, k in enumerate(order)}
        self.ids = words
        self.rank = {w: rank[k] for w, k in words.items()}
        self.byte_ids = byte_ids
        self.raw = [p.replace("▁", " ").encode() for p, _ in pieces]
        for b, k in byte_ids.items():
            self.raw[k] = bytes([b])
        self.splits = not any(re.search("[^ ] ", w) for w in words)  # no piece goes on after a word's end
        self.seed, self.dropout = seed, dropout
        self.limit = int(dropout * (M32 + 1))
        self._forget()
        self.grid: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str = MODEL, **options: float) -> PieceCodec:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        if sp.normalize(" a  b ") != "▁▁a▁▁b▁":
            raise ValueError("the model's normalisation changes text, so nothing could decode losslessly")
        n = sp.get_piece_size()
        bytes_ = {int(sp.id_to_piece(k)[3:5], 16): k for k in range(n) if sp.is_byte(k)}
        if len(bytes_) < 256:
            raise ValueError("the model has no byte fallback")
        special = {k for k in range(n) if sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)}
        return cls([("" if k in special else sp.id_to_piece(k), sp.get_score(k)) for k in range(n)], bytes_, **options)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"grid": {}, "known": {}, "pieces": [], "source": [], "skips": [], "after": {}, "asked": set(), "met": set(), "steps": np.zeros(1, np.uint64), "ends": np.zeros(1, np.int64)}

    def _forget(self) -> None:
        """An empty cache: the outcome without skips by segment, and of each outcome pieces, segment, skips, merges and what follows a further skip."""
        self.known: dict[str, int] = {}
        self.pieces: list[bytes] = []
        self.source: list[str] = []
        self.skips: list[frozenset[int]] = []
        self.steps, self.ends = np.zeros(1 << 12, np.uint64), np.zeros(1 << 10, np.int64)  # both grow by doubling
        self.after: dict[int, int] = {}  # by outcome and the first of its merges that is skipped
        self.asked: set[int] = set()  # such that were needed once
        self.met: set[str] = set()  # segments that came at least once

    def _add(self, segments: list[str], skips: list[frozenset[int]], pieces: list[bytes], size: np.ndarray, steps: np.ndarray) -> range:
        """Numbers of new outcomes."""
        first = len(self.pieces)
        while len(self.ends) <= first + len(segments):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        start = int(self.ends[first])
        self.ends[first + 1 : first + len(segments) + 1] = start + np.cumsum(size)
        while len(self.steps) < start + size.sum():
            self.steps = np.concatenate((self.steps, np.zeros_like(self.steps)))
        self.steps[start : start + size.sum()] = steps
        self.pieces += pieces
        self.source += segments
        self.skips += skips
        return range(first, first + len(segments))

    def _remember(self, segments: list[str]) -> None:
        self.known.update(zip(segments, self._add(segments, [frozenset()] * len(segments), *self.many_ids(segments, None)), strict=True))

    def first_skip(self, outcomes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The first of an outcome's merges that the key skips, or -1."""
        start, end = self.ends[outcomes], self.ends[outcomes + 1]
        size = end - start
        row = np.repeat(np.arange(len(outcomes)), size)
        at = np.arange(len(row)) + np.repeat(start - np.cumsum(size) + size, size)
        hit = np.flatnonzero(mixed(keys[row] + self.steps[at]) >> np.uint64(32) < np.uint64(self.limit))
        hit = hit[np.concatenate(([True], row[hit[1:]] != row[hit[:-1]]))[: len(hit)]]
        found = np.full(len(outcomes), -1)
        found[row[hit]] = at[hit] - start[row[hit]]
        return found

    def _follow(self, outcomes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The outcome of each key, or -1 where it is not cached; what is needed again is."""
        final = np.full(len(outcomes), -1)
        rows = np.arange(len(outcomes))
        while len(rows):
            skip = self.first_skip(outcomes, keys[rows])
            done = skip < 0
            final[rows[done]] = outcomes[done]
            rows, codes = rows[~done], outcomes[~done] * 64 + skip[~done]
            found = np.fromiter(map(self.after.get, codes.tolist(), repeat(-1)), np.int64, len(codes))
            new, times = np.unique(codes[found < 0], return_counts=True)
            again = [c for c, n in zip(new.tolist(), times.tolist(), strict=True) if n > 1 or c in self.asked] if len(self.pieces) < 2 * CACHE else []
            self.asked.update(new.tolist()) if len(self.asked) < CACHE else None
            if again:
                self._branch(again)
                found = np.fromiter(map(self.after.get, codes.tolist(), repeat(-1)), np.int64, len(codes))
            rows, outcomes = rows[found >= 0], found[found >= 0]
        return final

    def _branch(self, codes: list[int]) -> None:
        """Cache the outcomes that follow others when one more of their merges is skipped."""
        which = [divmod(c, 64) for c in codes]
        segments = [self.source[k] for k, _ in which]
        skips = [self.skips[k] | {int(self.steps[self.ends[k] + j])} for k, j in which]
        self.after.update(zip(codes, self._add(segments, skips, *self.many_ids(segments, skips)), strict=True))

    def _grid(self) -> dict[str, np.ndarray]:
        """Symbols, merges and skips as arrays. A symbol is a piece id, or one past the pieces for a lone ASCII byte."""
        n = len(self.raw)
        symbol = np.full(1 << 16, -1, np.int32)
        symbol[:128] = n + np.arange(128)
        for w, k in self.ids.items():
            if len(w) == 1 and ord(w) < 1 << 16:
                symbol[ord(w)] = k
        pairs = {(self.ids[w[:k]] << 16) | self.ids[w[k:]]: r for w, r in self.rank.items() for k in range(1, len(w)) if w[:k] in self.ids and w[k:] in self.ids}
        key, rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NEVER, np.int32)
        rest: dict[int, int] = {}
        for p, r in pairs.items():
            at = (p * 0x9E3779B1 & M32) >> 12
            if key[at] < 0:
                key[at], rank[at] = p, r
            else:
                rest[p] = r
        more = np.array(sorted(rest), np.int64)
        made = np.zeros(len(self.rank), np.int32)
        for w, r in self.rank.items():
            made[r] = self.ids[w]
        final = np.concatenate((np.arange(n, dtype=np.int32), np.array([self.byte_ids[b] for b in range(128)], np.int32)))
        return {"symbol": symbol, "key": key, "rank": rank, "more": more, "more_rank": np.array([rest[p] for p in more.tolist()], np.int32), "made": made, "final": final}

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rank of each merge; none where there is no piece or it is skipped: by a key, or by being one of a row of ``key``."""
        g = self.grid
        pair = (left.astype(np.int64) << 16) | right
        at = (pair * 0x9E3779B1 & M32) >> 12
        r = np.where(g["key"][at] == pair, g["rank"][at], NEVER)
        if len(g["more"]):
            miss = np.flatnonzero((r == NEVER) & (g["key"][at] >= 0))
            k = np.minimum(np.searchsorted(g["more"], pair[miss]), len(g["more"]) - 1)
            r[miss] = np.where(g["more"][k] == pair[miss], g["more_rank"][k], NEVER)
        if key.ndim == 1 or key.shape[1]:
            known = np.flatnonzero(r < NEVER)
            step = _step(r[known], place[known])
            skip = mixed(key[known] + step) >> np.uint64(32) < np.uint64(self.limit) if key.ndim == 1 else (key[known] == step[:, None]).any(axis=1)
            r[known[skip]] = NEVER
        return r

    def many_ids(self, segments: list[str], keys: int | np.ndarray | list[frozenset[int]] | None):
        """Piece ids of segments as int32 bytes. Given skips instead of keys, or None for no skip, the merges come too: each segment's number and all of them."""
        free = keys is None or isinstance(keys, list)
        given = keys if isinstance(keys, list) else [frozenset()] * len(segments)
        if free:
            keys = np.zeros((len(segments), max(map(len, given), default=0)), np.uint64)
            for i, x in enumerate(given):
                keys[i, : len(x)] = list(x)
                keys[i, len(x) :] = next(iter(x), 0)
        elif isinstance(keys, int):
            keys = np.full(len(segments), keys, np.uint64)
        if not self.grid:
            self.grid = self._grid()
        out: list[bytes] = [b""] * len(segments)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segments, how many merges each has, the merges
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(segments) else []:
            n = int(length[group[0]])
            for at in range(0, len(group), 20_000):
                which = group[at : at + 20_000]
                alone = which.tolist()
                if 0 < n <= SHORT:
                    points = np.frombuffer("".join([segments[i] for i in alone]).encode("utf-32-le"), np.uint32).reshape(-1, n)
                    x = np.where(points < 1 << 16, self.grid["symbol"][np.minimum(points, 0xFFFF)], -1)
                    plain = (x >= 0).all(axis=1)
                    alone, which = which[~plain].tolist(), which[plain]
                    flat, ends, counts, merges = self._rounds(x[plain], keys[which])
                    raw, start = flat.tobytes(), 0
                    for i, end in zip(which.tolist(), (ends * 4).tolist(), strict=True):
                        out[i] = raw[start:end]
                        start = end
                    taken.append((which, counts, merges))
                for i in alone:
                    here: list[tuple[int, int]] = []
                    out[i] = array("i", self.segment_ids(segments[i], None if free else int(keys[i]), here, given[i])).tobytes()
                    if free and here:
                        taken.append((np.array([i]), np.array([len(here)]), _step(*np.array(here, np.int64).T)))
        if not free:
            return out
        counts = np.zeros(len(segments), np.int64)
        for which, n, _ in taken:
            counts[which] = n
        start, flat = np.cumsum(counts) - counts, np.zeros(counts.sum(), np.uint64)
        for which, n, merges in taken:
            flat[np.arange(len(merges)) + np.repeat(start[which] - np.cumsum(n) + n, n)] = merges
        return out, counts, flat

    def _rounds(self, x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids end to end and each row's end; how many merges each row has and, without keys, all of them.

        A symbol stays where its first character is; ``after`` and ``before`` are the neighbours' places.
        """
        m, n = x.shape
        counts, rounds = np.zeros(m, np.int64), []
        if n > 1 and m:
            place = np.arange(n)
            after, before = np.repeat((place + 1)[None], m, axis=0).astype(np.int8), np.repeat((place - 1)[None], m, axis=0).astype(np.int8)
            r = np.full((m, n), NEVER, np.int32)
            r[:, :-1] = self._ranks(x[:, :-1].ravel(), x[:, 1:].ravel(), np.tile(place[:-1], m), np.repeat(key, n - 1, axis=0)).reshape(m, n - 1)
            live = np.flatnonzero(r.min(axis=1) < NEVER)
            while len(live):
                some = r[live]
                best = some.argmin(axis=1)
                rank = some[np.arange(len(live)), best]
                go = rank < NEVER
                if not go.all():
                    live, best, rank = live[go], best[go], rank[go]
                    if not len(live):
                        break
                counts[live] += 1
                if key.ndim == 2:
                    rounds.append((live, _step(rank, best)))
                gone = after[live, best]
                x[live, best], x[live, gone] = self.grid["made"][rank], -1
                right = after[live, gone]
                after[live, best] = right
                r[live, best] = r[live, gone] = NEVER
                has = np.flatnonzero(right < n)
                i, b, c = live[has], best[has], right[has]
                before[i, c] = b
                r[i, b] = self._ranks(x[i, b], x[i, c], b, key[i])
                left = before[live, best]
                has = np.flatnonzero(left >= 0)
                i, a, b = live[has], left[has], best[has]
                r[i, a] = self._ranks(x[i, a], x[i, b], a, key[i])
        start = np.cumsum(counts) - counts
        merges = np.zeros(counts.sum() if key.ndim == 2 else 0, np.uint64)
        for k, (rows, step) in enumerate(rounds):
            merges[start[rows] + k] = step
        keep = x >= 0
        return self.grid["final"][x[keep]], np.cumsum(keep.sum(axis=1)), counts, merges

    def segment_ids(self, s: str, key: int | None, taken: list[tuple[int, int]] | None = None, skips: frozenset[int] = frozenset()) -> list[int]:
        """Piece ids of one segment under a key, or None for no dropout but the given skips; the merges go to ``taken``."""
        table, n, limit = self.rank.get, len(s), self.limit

        def rank(i: int, j: int) -> int | None:
            r = table(s[i:j])
            if r is None or (key is not None and mixed_one((key + r * BY_RANK + i * BY_PLACE) & M64) >> 32 < limit) or (skips and (r * BY_RANK + i * BY_PLACE) & M64 in skips):
                return None
            return r

        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(i, i + 2)) is not None]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n))  # next and previous symbol's start
        while agenda:
            r, i, mid, end = heappop(agenda)
            if after[i] != mid or after[mid] != end:
                continue
            if taken is not None:
                taken.append((r, i))
            after[i], before[end], after[mid] = end, i, -1
            if i and (q := rank(before[i], end)) is not None:
                heappush(agenda, (q, before[i], i, end))
            if end < n and (q := rank(i, after[end])) is not None:
                heappush(agenda, (q, i, end, after[end]))
        ids, out, i = self.ids, [], 0
        while i < n:
            piece = s[i : after[i]]
            k = ids.get(piece)
            if k is None:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(k)
            i = after[i]
        return out

    def encode(self, text: str, doc_key: object = 0) -> np.ndarray:
        return self.encode_all([(doc_key, text)])[0]

    def encode_all(self, docs: list[tuple[object, str]]) -> list[np.ndarray]:
        """Piece ids of each (key, text)."""
        if len(self.known) >= CACHE or len(self.pieces) >= 2 * CACHE:
            self._forget()
        split = [[] if not text else SEGMENT.findall(" " + text) if self.splits else [" " + text] for _, text in docs]
        segments = [s for x in split for s in x]
        keys = np.concatenate([np.zeros(0, np.uint64), *(self._keys(key, len(x)) for (key, _), x in zip(docs, split, strict=True))])
        known = self.known
        numbers = np.fromiter(map(known.get, segments, repeat(-1)), np.int64, len(segments))
        miss = np.flatnonzero(numbers < 0).tolist()
        if miss:  # what comes a second time is remembered
            new = Counter([segments[i] for i in miss])
            met = self.met
            self._remember([s for s, n in new.items() if (n > 1 or s in met) and len(s) <= SHORT])
            met.update(new) if len(met) < CACHE else None
            numbers[miss] = np.fromiter((known.get(segments[i], -1) for i in miss), np.int64, len(miss))
        if self.dropout:
            some = np.flatnonzero(numbers >= 0)
            numbers[some] = self._follow(numbers[some], keys[some])
        own, pieces = numbers < 0, self.pieces
        ids = [pieces[k] for k in np.where(own, 0, numbers).tolist()] if pieces else [b""] * len(segments)
        which = np.flatnonzero(own).tolist()
        todo = [segments[i] for i in which]
        for i, x in zip(which, self.many_ids(todo, keys[own]) if self.dropout else self.many_ids(todo, None)[0], strict=True):
            ids[i] = x
        out, at = [], 0
        for x in split:
            out.append(np.frombuffer(b"".join(ids[at : at + len(x)]), np.int32))
            at += len(x)
        return out

    def _keys(self, key: object, n: int) -> np.ndarray:
        """The keys of a document's segments."""
        own = int.from_bytes(blake2b(f"{self.seed}:{key}".encode(), digest_size=8).digest(), "little")
        return mixed(np.uint64(own) + np.arange(n, dtype=np.uint64) * np.uint64(BY_RANK))

    def decode(self, ids: list[int]) -> str:
        """The text without the leading space that encoding puts before it."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


def model_path(spark: SparkSession) -> str:
    """The model file, which the driver reads: the setting ``spark.veriskill.pieceModel``, or :data:`MODEL`."""
    return spark.conf.get("spark.veriskill.pieceModel", MODEL)


def encode_pieces(docs: DataFrame, codec: PieceCodec, *, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_pieces, pieces array<int>, lossless``.

    ``lossless`` tells whether decoding gave the exact text back. Null text gives null pieces, count and check; empty
    text gives none and is lossless. Equal ids and texts get equal pieces; a very long text is encoded whole. Other columns are ignored, empty tables
    stay empty. A null id is a key like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"]]).add("n_pieces", "long").add("pieces", ArrayType(IntegerType())).add("lossless", "boolean")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in _slices(whole):
                texts = batch.column(1).to_pylist()
                pieces = model.encode_all(list(zip(batch.column(0).to_pylist(), texts, strict=True)))
                pieces = [None if t is None else p for t, p in zip(texts, pieces, strict=True)]
                same = [None if t is None or not check else model.decode(p.tolist()) == t for t, p in zip(texts, pieces, strict=True)]
                counts = [None if p is None else len(p) for p in pieces]
                ends = np.cumsum([0, *(n or 0 for n in counts)])
                offsets = pa.array(ends, pa.int32(), mask=np.array([*(n is None for n in counts), False]))
                flat = np.concatenate([np.zeros(0, np.int32), *(p for p in pieces if p is not None)])
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces", "lossless"])

    return rows.mapInArrow(encode, schema)


def _slices(batch: pa.RecordBatch, rows: int = 400, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and, but for a very long text, few bytes."""
    length = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float))
    start, held = 0, 0.0
    for k, n in enumerate(length.tolist()):
        if k > start and (k - start >= rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0.0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def decode_pieces(encoded: DataFrame, codec: PieceCodec, *, pieces_col: str = "pieces") -> DataFrame:
    """``encoded`` with the column ``text``; null pieces decode to null. An input column ``text`` is replaced."""
    encoded = encoded.drop("text")
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    schema = StructType([*encoded.schema.fields]).add("text", "string")
    names = [f.name for f in schema]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else shared.value.decode(p) for p in batch.column(pieces_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return map_arrow(encoded, decode, schema)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), PieceCodec.load(model_path(spark)))
