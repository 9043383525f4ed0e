"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is `size` consecutive item words (a shorter item is one window). Its tokens are its
shingles of SHINGLE words (all its words if it has fewer), ordered by their rarity over all
documents. A window is contained only if all its tokens are, so that its necessary prefix is
its one rarest token. Documents send only the places where a prefix token stands, with the
words around it, and meet the windows of that token in a join. The token's offset in the window
gives the only possible start (positional bound), windows that would leave the document are
dropped (length bound), and the rest are compared word by word. Windows go by the MD5 of their
words.

Both tables are joined as tables, whatever the size of the benchmark. Documents are screened
first by bitmaps of fixed size (2 ** SCREEN_BITS bits) over the hashes of all tokens, then of the prefix
tokens; a full bitmap lets more rows through and changes no result.

Skew: tokens are counted by document with partial sums. A prefix token in very many documents
(of an item of one common word) meets its windows by broadcast, see common.join_each. Places
of one document are gathered, which are bounded by its length.

Defined results: null or empty text has no words; an item without words has no window; null
item ids print as empty strings; repeated rows and ids each get their row; empty tables work;
extra columns, whatever their names, are ignored by contaminated() and returned by clean().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, SHINGLE = 10, 3
SCREEN_BITS = 24
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if C.ALNUM[b] else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text."""
    return text.translate(_FOLD).split()


def windows(item: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if len(item) <= size:
        return {tuple(item)} if item else set()
    return {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}


def tokens(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    k = len(hashes) - n + 1
    out = np.full(max(k, 0), C.U(n))
    with np.errstate(over="ignore"):
        for j, c in enumerate(C.seeded(n, 51) | C.U(1)):
            out += hashes[j : j + max(k, 0)] * c
        return C.mix(out)


def _hashed(text: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(text), np.uint8)
    return C.Words(data, np.array([0, len(data)]), C.ALNUM).hashes()


def _windows(size: int):
    """item, window (its words), k, and the hash and offset of each token, of the distinct windows of each item."""

    def run(batches):
        for batch in C.small(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in windows(words((text or "").encode()), size):
                    t = tokens(_hashed(list(w)), min(SHINGLE, len(w))).astype(np.int64)
                    rows.append((item, b" ".join(w), len(w), t.tolist()))
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["item", "words", "k", "tokens"])

    return run


def _bits(column: str, bits: int):
    """Partial bitmap of the hashes of a column: one row of (word number, 64 bits) for each word that is not 0."""

    def run(batches):
        screen = np.zeros(1 << bits, bool)
        for batch in batches:
            screen[_slot(batch.column(column).to_numpy().astype(C.U), bits)] = True
        packed = np.packbits(screen, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], names=["at", "bits"])

    return run


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> C.U(64 - bits)).astype(np.int64)


def _screen(hashes: DataFrame, column: str, bits: int):
    """The broadcast bitmap of 2 ** bits bits, of a size that doesn't depend on the rows."""
    some = hashes.select(column).mapInArrow(_bits(column, bits), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros((1 << bits) // 64, np.int64)
    packed[some.column("at").to_numpy()] = some.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(packed)


def _passing(hashes: np.ndarray, screen: np.ndarray) -> np.ndarray:
    slot = _slot(hashes, (64 * len(screen)).bit_length() - 1)
    return (screen[slot >> 6].view(C.U) >> (slot & 63).astype(C.U)) & C.U(1) == 1


def _places(w: C.Words, hashes: np.ndarray, n: int, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the runs of n words that stay in their document and pass the screen."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, C.U)
    found = tokens(hashes, n)
    at = np.flatnonzero(_passing(found, screen) & (w.doc[: len(found)] == w.doc[n - 1 :]))
    return at, found[at]


def _frequencies(screen, sizes: list[int]):
    """In how many documents of a batch each token stands."""

    def count(batches):
        for batch in batches:
            for _, _, data, at in C.chunks(batch.column("text")):
                w = C.Words(data, at, C.ALNUM)
                hashes = w.hashes(C.FOLDED)
                found = [_places(w, hashes, n, screen.value) for n in sizes]
                doc, token = np.concatenate([w.doc[p] for p, _ in found]), np.concatenate([h for _, h in found])
                order = np.lexsort((token, doc))
                doc, token = doc[order], token[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
                token, n = np.unique(token[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return count


def _probe(screen, sizes: list[int], reach: int):
    """Each row with its words counted, and the places of tokens that pass: hash, first word, and the words around."""

    def probe(batches):
        for batch in batches:
            for row, end, data, at in C.chunks(batch.column("text")):
                w = C.Words(data, at, C.ALNUM)
                hashes = w.hashes(C.FOLDED)
                folded = data.tobytes().translate(_FOLD)
                found = [_places(w, hashes, n, screen.value) for n in sizes]
                first, token = np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])
                order = np.argsort(first, kind="stable")
                first, token = first[order], token[order]
                doc = w.doc[first]
                low, high = np.maximum(w.first[doc], first - reach + 1), np.minimum(w.first[doc + 1], first + reach)
                around = [b" ".join(folded[a:b].split()) for a, b in zip(w.starts[low].tolist(), w.ends[high - 1].tolist(), strict=True)]
                columns = {"token": pa.array(token.astype(np.int64)), "at": pa.array((first - w.first[doc]).astype(np.int32)), "head": pa.array((first - low).astype(np.int32)), "around": pa.array(around, pa.binary())}
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n))]).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in names), pa.array(w.counts.astype(np.int64)), places], names=[*names, "n_words", "places"])

    return probe


def _verify(batches):
    """Places whose words are those of the window, as spans of words."""
    for batch in C.small(batches):
        keep, starts = [], []
        for head, offset, k, around, window in zip(*(batch.column(c).to_pylist() for c in ("head", "offset", "k", "around", "words")), strict=True):
            low = head - offset
            keep.append(low >= 0 and around.split(b" ")[low : low + k] == window.split(b" "))
        starts = np.subtract(batch.column("at").to_numpy(), batch.column("offset").to_numpy())
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row_key", "window", "k")), pa.array(starts, pa.int32())], names=["id", "row_key", "window", "k", "start"])
        yield out.filter(pa.array(keep, pa.bool_()))


def _covered(batches):
    """Words inside any span, and the digest of the items."""
    for batch in C.small(batches):
        n_hit, digest = [], []
        for spans, items in zip(*(batch.column(c).to_pylist() for c in ("spans", "items")), strict=True):
            hit = end_of = 0
            for s, k in sorted((x["start"], x["k"]) for x in spans or ()):
                hit += max(0, s + k - max(s, end_of))
                end_of = max(end_of, s + k)
            n_hit.append(hit)
            digest.append(hashlib.sha256(",".join(sorted(items or ())).encode()).hexdigest())
        names = [n for n in batch.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(n_hit, pa.int64()), pa.array(digest)], names=[*names, "n_hit", "items_sha256"])


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, screen_bits: int = SCREEN_BITS) -> DataFrame:
    """id, row_key, n_words, items array<string>, n_hit, items_sha256, contaminated; a row for each row."""
    spark = C.bounded(docs)
    scratch = C.Scratch(spark, "windows")
    rows = docs.select(F.col(doc_id).alias("id"), C.row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    of_items = items.mapInArrow(_windows(size), "item string, words binary, k int, tokens array<long>")
    of_items = scratch.keep(of_items.withColumn("window", F.md5("words")).distinct(), "items")
    all_windows = scratch.keep(of_items.groupBy("window", "words", "k").agg(F.first("tokens").alias("tokens")), "windows")
    sizes = sorted(r[0] for r in all_windows.select(F.least("k", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # SHINGLE numbers at most

    # the rarest token of each window; of equals the least hash, then the first place
    each = all_windows.select("window", "k", F.posexplode("tokens").alias("offset", "token"))
    screen = _screen(each, "token", screen_bits)
    often = rows.select("text").mapInArrow(_frequencies(screen, sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = each.join(often, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("t"))
    prefix = scratch.keep(all_windows.join(rarest, "window").select("window", "words", "k", "t.n", "t.token", "t.offset"), "prefix")

    shape = f"id {kind}, row_key long, n_words long, places array<struct<token:bigint,at:int,head:int,around:binary>>"
    probed = scratch.keep(rows.mapInArrow(_probe(_screen(prefix, "token", screen_bits), sizes, size), shape), "probed")
    places = probed.filter(F.size("places") > 0).select("id", "row_key", "n_words", F.explode("places").alias("p")).select("id", "row_key", "n_words", "p.*")
    met = C.join_each(places, prefix, ["token"])  # windows with one token have the same n
    met = met.filter((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("k") <= F.col("n_words")))
    shape = f"id {kind}, row_key long, window string, k int, start int"
    hits = scratch.keep(met.mapInArrow(_verify, shape).distinct(), "hits")

    spans = hits.groupBy(F.col("id").alias("mark_id"), F.col("row_key").alias("mark_key")).agg(F.collect_list(F.struct("start", "k")).alias("spans"))
    own = hits.select("id", "row_key", "window").distinct().join(of_items.select("window", "item"), "window")
    own = own.groupBy(F.col("id").alias("own_id"), F.col("row_key").alias("own_key")).agg(F.collect_set("item").alias("items"))
    marks = spans.join(own, F.col("mark_id").eqNullSafe(F.col("own_id")) & (F.col("mark_key") == F.col("own_key"))).drop("own_id", "own_key")
    out = probed.select("id", "row_key", "n_words").join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("row_key") == F.col("mark_key")), "left")
    out = out.select("id", "row_key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    out = out.mapInArrow(_covered, f"id {kind}, row_key long, n_words long, items array<string>, n_hit long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents that hold no window of an item, with all their columns."""
    bad = contaminated(docs, items, doc_id, text, **more).filter("contaminated").select("id", "row_key")
    return C.named(C.marked(docs, bad, doc_id, text, "left_anti"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM
    (SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM w),
p AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
m AS (SELECT doc_id, i, k, item FROM p JOIN w USING (k, g)),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS i FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(s.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
