"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern; the distinct pieces of a run of documents are
bucketed by byte length into padded numpy matrices of token ids. Each round looks up all
neighbouring pairs in an open-addressing hash table, every row merges its leftmost pair of
least rank, and rows are compacted; rows without a pair leave. Encoded pieces are kept in a
worker's table, emptied when it holds CACHE_PIECES pieces or CACHE_IDS ids, so that memory is
bounded. A piece of more than LONG bytes would take a round of that width for each of its merges;
it makes the same merges in the same order with a heap instead. Ids of a run of documents, their decimals and their bytes are gathered from flat
tables.

Defined results: null text is empty and has no tokens; lone invalid ids raise on decoding;
repeated rows each get their row; empty tables work; extra columns are kept, and one with the
name of an output column gets `_given` behind its name.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CACHE_PIECES, CACHE_IDS = 100_000, 1 << 20
#: Pieces of more bytes are merged one by one with a heap.
LONG = 2048
#: Cells of a padded matrix at once; a bucket of more is cut into blocks.
CELLS = 1 << 20
PAD = -1
_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, path: str, pattern: str, long: int = LONG):
        import regex

        self.long = long
        self.split = regex.compile(pattern).findall
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens, self.known = tokens, np.array([bool(t) for t in tokens])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        decimals = [b"%d " % i for i in range(size)]
        self.decimal_blob = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_lengths = np.array([len(d) for d in decimals], np.int64)
        self.decimal_offsets = np.concatenate([[0], np.cumsum(self.decimal_lengths)])
        self.byte = np.array([ranks.get(bytes([b]), PAD) for b in range(256)], np.int32)
        self.ranks = ranks
        # every way of cutting a token into two tokens is a pair that may merge; its rank is the token's
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        todo = np.array(list(pairs), np.int64)
        rank = np.array(list(pairs.values()), np.int32)
        step = 0
        while len(todo):  # all pairs at once: whoever finds its own key in its slot is placed
            slot = self._slot(todo, step)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]
            placed = self.keys[slot] == todo
            self.values[slot[placed]] = rank[placed]
            todo, rank, step = todo[~placed], rank[~placed], step + 1
        self.steps = step
        self.forget()

    def forget(self) -> None:
        """Empties the table of encoded pieces: slot of each piece, and ids of each slot."""
        self.slots: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def _slot(self, pairs: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((pairs.astype(C.U) * C.U(0x9E3779B97F4A7C15)) >> C.U(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the largest int32 where a pair does not merge."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(pairs.shape, np.iinfo(np.int32).max, np.int32)
        flat, where = pairs.reshape(-1), np.flatnonzero(((left >= 0) & (right >= 0)).reshape(-1))
        into = out.reshape(-1)
        for step in range(self.steps):
            slot = self._slot(flat[where], step)
            key = self.keys[slot]
            hit = key == flat[where]
            into[where[hit]] = self.values[slot[hit]]
            where = where[~hit & (key != -1)]
            if not len(where):
                break
        return out

    def merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of each row of a padded matrix of one-byte ids, padded, and their number."""
        n, width = ids.shape
        out, counts = np.full((n, width), PAD, np.int32), np.zeros(n, np.int64)
        rows, none = np.arange(n), np.iinfo(np.int32).max
        lengths = (ids != PAD).sum(1)
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), none)
            done = best == none
            out[rows[done], : ids.shape[1]] = ids[done]
            counts[rows[done]] = lengths[done]
            go = ~done
            if not go.any():
                break
            ids, ranks, rows, lengths, at, best = ids[go], ranks[go], rows[go], lengths[go] - 1, at[go], best[go]
            r = np.arange(len(rows))
            ids[r, at] = best
            # compaction: what stands right of the merged pair moves one to the left
            width = int(lengths.max())
            take = np.arange(ids.shape[1] - 1)[None, :] + (np.arange(ids.shape[1] - 1)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, take, 1)[:, :width]
            gone = np.arange(ids.shape[1])[None, :] >= lengths[:, None]
            ids[gone] = PAD
            take = take[:, : max(width - 1, 0)]
            ranks = np.take_along_axis(ranks, np.minimum(take, ranks.shape[1] - 1), 1)
            if ranks.shape[1]:
                ranks[np.arange(ranks.shape[1])[None, :] >= lengths[:, None] - 1] = none
                for side in (-1, 0):  # only the pairs beside the merged token changed
                    p = at + side
                    ok = (p >= 0) & (p < lengths - 1)
                    ranks[r[ok], p[ok]] = self.rank_of(ids[r[ok], p[ok]], ids[r[ok], p[ok] + 1])
        return out, counts

    def long_piece(self, piece: bytes) -> np.ndarray:
        """One very long piece: the same merges with a heap, O(n log n) instead of a wide matrix."""
        import heapq

        ids = [int(x) for x in self.byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, none = self.rank_of(np.array(ids[:-1]), np.array(ids[1:])), np.iinfo(np.int32).max
        heap = [(int(r), i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(heap)
        tokens = self.tokens

        def rank(i):
            j = after[i]
            return self.ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and the number of each: tokens directly, the rest by
        merging in length buckets."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        whole = np.fromiter((self.ranks.get(t, PAD) for t in raw), np.int32, len(raw))
        found = [(np.flatnonzero(whole != PAD), whole[whole != PAD], None)]
        bucket = np.where(whole != PAD, 0, np.where(size > self.long, -1, (size + 3) // 4 * 4))
        for i in np.flatnonzero(bucket == -1):
            ids = self.long_piece(raw[i])
            found.append((np.array([i]), ids, np.array([len(ids)])))
        for width in np.unique(bucket[bucket > 0]):
            own = np.flatnonzero(bucket == width)
            block = max(1, CELLS // int(width))
            for a in range(0, len(own), block):
                part = own[a : a + block]
                place = np.arange(width)
                inside = place < size[part][:, None]
                matrix = np.where(inside, self.byte[data[np.minimum(at[part][:, None] + place, len(data) - 1)]], PAD)
                ids, n = self.merge(matrix)
                found.append((part, ids[place < n[:, None]], n))
        counts = np.zeros(len(raw), np.int64)
        for own, ids, n in found:
            counts[own] = 1 if n is None else n
        out, ends = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        for own, ids, _ in found:
            out[_ranges(ends[own] - counts[own], counts[own])] = ids
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and first: text i has first[i]:first[i + 1]."""
        cut = [self.split(t) for t in texts]
        if len(self.slots) > CACHE_PIECES or len(self.flat) > CACHE_IDS:
            self.forget()
        new = list(set().union(*cut).difference(self.slots)) if cut else []
        if new:
            ids, counts = self.pieces([p.encode() for p in new])
            self.slots.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, ids])
        n_pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cut)), np.int64, int(n_pieces.sum()))
        counts = self.counts[slots]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[_ranges(self.starts[slots], counts)], total[np.concatenate([[0], np.cumsum(n_pieces)])]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, gathered from the flat table of tokens, and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.lengths[ids]
        return self.blob[_ranges(self.offsets[ids], n)].tobytes(), np.cumsum(n)

    def decimals(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, a space after each, and where each ends."""
        n = self.decimal_lengths[ids]
        return self.decimal_blob[_ranges(self.decimal_offsets[ids], n)].tobytes(), np.cumsum(n)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def _encode(path: str, pattern: str, with_ids: bool):
    def encode(batches):
        c = codec(path, pattern)
        for batch in batches:
            for row, end, data, at in C.chunks(batch.column("text")):
                raw = data.tobytes()
                ids, first = c.encode([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
                back, ends = c.decode(ids)
                text, stops = c.decimals(ids)
                ends, stops = np.concatenate([[0], ends])[first].tolist(), np.concatenate([[0], stops])[first].tolist()
                ids_hash = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(stops[:-1], stops[1:], strict=True)]
                decoded_hash = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                whole = [back[a:b] == raw[i:j] for a, b, i, j in zip(ends[:-1], ends[1:], at[:-1], at[1:], strict=True)]
                names = [x for x in batch.schema.names if x != "text"]
                cols = [batch.column(x).slice(row, end - row) for x in names]
                cols += [pa.array(np.diff(first), pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string()), pa.array(whole, pa.bool_())]
                names += ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return encode


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256, round_trip, ids array<int> (with_ids)."""
    C.bounded(docs)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    given = default_vocabulary()
    path, pattern = str(path or given[0]), pattern or given[1]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    shape = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))
    shape += (", " if keep else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    out = rows.mapInArrow(_encode(path, pattern, with_ids), shape)
    return out.withColumnsRenamed(C.beside(keep, out.columns[len(keep) :]))


def _decode(path: str, pattern: str):
    def decode(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64))[0] for x in batch.column("ids").to_pylist()]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.binary())], names=[*names, "bytes"])

    return decode


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All other columns and the decoded bytes; null ids give null."""
    given = default_vocabulary()
    C.bounded(rows)
    keep = [c for c in rows.columns if c != ids]
    cut = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(ids).alias("ids"))
    shape = "".join(f"c{i} {cut.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep))) + "bytes binary"
    out = cut.mapInArrow(_decode(str(path or given[0]), pattern or given[1]), shape)
    return out.withColumnsRenamed(C.beside(keep, out.columns[len(keep) :]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False).drop("round_trip")
