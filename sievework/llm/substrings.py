"""Substring dedup: suffix automata of reference shards give matching statistics of documents.

A window is WINDOW consecutive words. Two equal windows have the same anchor, the leftmost
least of the hashed word 8-grams inside them, so a window can only repeat where its anchor
does. Consecutive windows of one document with one anchor form a piece (at most 28 windows).
Pieces are routed by anchor, not broadcast: the reference is the corpus itself, and its size
has no bound; a shard is the pieces of one anchor.

  1. anchors are counted; pieces whose anchor stands once are dropped;
  2. equal pieces are counted; a piece that stands twice repeats as a whole;
  3. where an anchor has different pieces, a suffix automaton of its distinct pieces (with
     their counts) is the reference, and each single piece is streamed through it: the
     matching statistic at a word is the longest substring ending there that stands at least
     twice. Windows of at least WINDOW matched words repeat;
  4. the words covered by repeated windows go.

Skew: counts are partial aggregations, equal pieces collapse before they meet, and the hottest
anchors and pieces are joined back by broadcast. An anchor with more than HOT distinct pieces
is not gathered: its windows are counted by their words, as rows, whatever their number. HOT
bounds the memory of an automaton (420 MB were measured for 20 000 pieces of 49 words) and
doesn't show in the result.

Equal pieces are those with equal anchor and content hashes (128 bits); everything else is
compared word by word. Rows are told apart by a 64-bit hash of id and text.

Defined results: null text has no words; documents of fewer words than a window keep all;
rows repeated under one id count as separate occurrences, so their windows go from both;
null ids are ids like others; an empty table gives none; extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM, HOT = 35, 8, 20_000


def pieces(w: C.Words, hashes: np.ndarray, window: int, gram: int):
    """First word, windows, anchor hash and content hash of each piece of a chunk, in order."""
    n = len(hashes) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(C.U), none.astype(C.U)
    value, _ = w.grams(hashes, gram, 31)
    at = np.arange(len(value))
    span, width = window - gram + 1, 1
    while width < span:  # minima over [i, i + width), leftmost first
        step = min(width, span - width)
        right = value[step:] < value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    inside = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    if not len(inside):
        return none, none, none.astype(C.U), none.astype(C.U)
    own = at[inside]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    count = np.diff(np.concatenate([first, [len(inside)]]))
    start = inside[first]
    return start, count, value[start], C.span_hash(hashes, start, start + count + window - 1)


def _scan(window: int, gram: int):
    def scan(batches):
        for batch in batches:
            for row, end, data, at in C.chunks(batch.column("text")):
                w = C.Words(data, at)
                start, count, anchor, content = pieces(w, w.hashes(), window, gram)
                doc = w.doc[start]
                offsets = np.zeros(w.n + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=w.n), out=offsets[1:])
                raw = data.tobytes()
                digest = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind))
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row, end - row) for c in names),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array(digest),
                        lists((start - w.first[doc]).astype(np.int32), pa.int32()),
                        lists(count.astype(np.int32), pa.int32()),
                        lists(anchor.astype(np.int64), pa.int64()),
                        lists(content.astype(np.int64), pa.int64()),
                    ],
                    names=[*names, "n_words", "digest", "start", "count", "h", "c"],
                )

    return scan


class SuffixAutomaton:
    """A generalised suffix automaton of sequences with counts."""

    def __init__(self):
        self.next, self.link, self.len, self.count = [{}], [-1], [0], [0]

    def _state(self, length, edges, link):
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.len) - 1

    def add(self, sequence, weight: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for x in sequence:
            q = nxt[last].get(x)
            if q is not None and length[q] == length[last] + 1:
                cur = q
            else:
                cur = None if q is not None else self._state(length[last] + 1, {}, 0)
                p = last
                if cur is not None:
                    while p >= 0 and x not in nxt[p]:
                        nxt[p][x] = cur
                        p = link[p]
                    q = nxt[p][x] if p >= 0 else None
                if q is not None and length[q] == length[p] + 1:
                    link[cur] = q
                elif q is not None:
                    clone = self._state(length[p] + 1, dict(nxt[q]), link[q])
                    link[q] = clone
                    while p >= 0 and nxt[p].get(x) == q:
                        nxt[p][x] = clone
                        p = link[p]
                    if cur is None:
                        cur = clone
                    else:
                        link[cur] = clone
            self.count[cur] += weight
            last = cur

    def finish(self) -> None:
        """Occurrences of every state: its own ends and those of the states that link to it."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def statistics(self, sequence, least: int = 2):
        """At each element, the longest substring ending there that stands at least `least` times."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        state = n = 0
        for x in sequence:
            while True:
                to = nxt[state].get(x)
                if to is not None and count[to] >= least:
                    state, n = to, n + 1
                    break
                if state == 0:
                    n = 0
                    break
                state = link[state]
                n = length[state]
            yield n


def repeated(group: list[tuple[int, list[bytes]]], window: int) -> list[list[int]]:
    """For each (count, words) of a shard, the first words of its windows that stand twice or more."""
    automaton, ids = SuffixAutomaton(), {}
    sequences = [[ids.setdefault(x, len(ids)) for x in words] for _, words in group]
    for (n, _), sequence in zip(group, sequences, strict=True):
        automaton.add(sequence, min(n, 2))
    automaton.finish()
    return [[] if n > 1 else [i - window + 1 for i, m in enumerate(automaton.statistics(s)) if m >= window] for (n, _), s in zip(group, sequences, strict=True)]


def _automata(window: int):
    def run(batches):
        held: list[tuple[int, int, bytes]] = []
        anchor = None

        def done():
            found = repeated([(n, words.split(b" ")) for n, _, words in held], window)
            return [(c, x) for (n, c, _), x in zip(held, found, strict=True) if x]

        for batch in batches:
            out = []
            columns = (batch.column(k).to_pylist() for k in ("h", "c", "n", "words"))
            for h, c, n, words in zip(*columns, strict=True):
                if h != anchor:
                    out += [(anchor, *x) for x in done()]
                    held, anchor = [], h
                held.append((n, c, words))
            yield _found(out)
        if held:
            yield _found([(anchor, *x) for x in done()])

    return run


def _found(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["h", "c", "starts"])


def _cut(window: int):
    """The words of the wanted pieces of each document."""

    def cut(batches):
        for batch in C.small(batches):
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                words = text.encode().split()
                for p in wanted:
                    rows.append((p["h"], p["c"], p["n"], p["hot"], b" ".join(words[p["start"] : p["start"] + p["count"] + window - 1])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["h", "c", "n", "hot", "words"])

    return cut


def _windows(window: int):
    """The windows of pieces, as rows."""

    def windows(batches):
        for batch in C.small(batches):
            out: list[tuple[int, int, int, int, bytes]] = []
            for h, c, n, words in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "n", "words")), strict=True):
                own = words.split(b" ")
                out += [(h, c, n, i, b" ".join(own[i : i + window])) for i in range(len(own) - window + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(),) * 3 + (pa.int32(), pa.binary()))], names=["h", "c", "n", "at", "g"])

    return windows


def _remove(batches):
    for batch in C.small(batches):
        removed, digest, kept = [], [], []
        for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in ("text", "starts", "ends")), strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int32)
            np.add.at(gone, starts, 1)
            np.add.at(gone, ends, -1)
            left = [w for w, g in zip(words, np.cumsum(gone[:-1]), strict=True) if not g]
            rest = b" ".join(left)
            removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept)], names=["key", "n_removed", "kept_sha256", "kept_text"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """id, row_key, n_words, n_removed, kept_sha256, kept_text (with_text; null where nothing was removed)."""
    spark = C.bounded(docs)
    scratch = C.Scratch(spark, "substrings")
    rows = docs.select(F.col(doc_id).alias("id"), C.row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, key long, n_words long, digest string, start array<int>, count array<int>, h array<long>, c array<long>"
    scanned = scratch.keep(rows.mapInArrow(_scan(window, gram), shape), "scanned")

    every = scanned.select("key", F.explode(F.arrays_zip("h", "c", "start", "count")).alias("p")).select("key", "p.*")
    twice = scratch.keep(every.groupBy("h").agg(F.count(F.lit(1)).alias("n_h")).filter("n_h > 1"), "twice")
    found = scratch.keep(C.join_each(every, twice, ["h"], "n_h").drop("n_h"), "found")
    kinds = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "count")).alias("first"))
    kinds = scratch.keep(kinds, "kinds")
    whole = C.join_each(found, kinds.filter("n > 1").select("h", "c", "n"), ["h", "c"])
    spans = whole.select("key", "start", (F.col("start") + F.col("count") + (window - 1)).alias("end"))

    # anchors with different pieces: one copy of each goes to the anchor's automaton
    mixed = scratch.keep(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "mixed-anchors")
    mixed = C.join_each(kinds, mixed, ["h"], "kinds").select("h", "c", "n", (F.col("kinds") > hot).alias("hot"), "first.key", "first.start", "first.count")
    mixed = scratch.keep(mixed, "mixed")
    wanted = mixed.groupBy("key").agg(F.collect_list(F.struct("h", "c", "n", "hot", "start", "count")).alias("wanted"))
    # the texts of documents with a repeated anchor, once
    candidates = found.groupBy("key").agg(F.lit(1).alias("one"))
    texts = scratch.keep(rows.select("key", "text").join(candidates.hint("merge"), "key").select("key", "text").dropDuplicates(["key"]), "texts")
    cut = texts.join(wanted, "key").mapInArrow(_cut(window), "h long, c long, n long, hot boolean, words binary")
    cut = scratch.keep(cut, "cut")
    shards = cut.filter("not hot").repartition(C.parts(spark), "h").sortWithinPartitions("h").select("h", "c", "n", "words")
    some = shards.mapInArrow(_automata(window), "h long, c long, starts array<int>")
    windows = cut.filter("hot").select("h", "c", "n", "words").mapInArrow(_windows(window), "h long, c long, n long, at int, g binary")
    often = scratch.keep(windows.groupBy("g").agg(F.sum("n").alias("total")).filter("total > 1"), "often")
    many = C.join_each(windows.filter("n = 1"), often, ["g"], "total").groupBy("h", "c").agg(F.collect_list("at").alias("starts"))
    single = some.unionByName(many).join(mixed.filter("n = 1").select("h", "c", "key", "start"), ["h", "c"])
    single = single.select("key", "start", F.explode("starts").alias("at"))
    spans = spans.union(single.select("key", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + window).alias("end")))

    gone = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    removed = texts.join(gone, "key").mapInArrow(_remove, "key long, n_removed long, kept_sha256 string, kept_text string")
    if not with_text:
        removed = removed.drop("kept_text")
    out = scanned.select("id", "key", "n_words", "digest").join(removed, "key", "left")
    return out.select("id", F.col("key").alias("row_key"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), *(["kept_text"] if with_text else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(C.table(spark, sf_dir, "documents"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) t ON t.g = w.g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM r),
p AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
