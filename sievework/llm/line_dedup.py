"""Line dedup: a segment-partition edit join over all lines.

Lines are split at \\n and trimmed of ASCII white space; blank ones take no part. A line goes
if an equal line stands earlier, or if it is of MIN_BYTES bytes and its text lies within TAU
edits (over UTF-8 bytes) of another of MIN_BYTES bytes whose first occurrence is earlier;
earlier means by (doc_id, line number). Two edits in a line of under 16 bytes are more than an
eighth of it (all words of three letters lie within three edits), so short lines go only as
exact repeats.

Join: every line is cut into TAU + 1 segments; of two lines within TAU edits one holds a
whole segment of the other. Lines index their segments by (length, segment number, hash) and
probe with the substrings that can match lines of their length or up to TAU shorter
(multi-match-aware positions). Signatures are packed into binary blocks, sorted by a part of
the hash and met one part at a time, with as many parts as the lines need for parts of about
PART_BYTES; only buckets with different lines go on. There, pairs whose byte-class counts
differ by more than 2 * TAU are dropped, in blocks of BLOCK lines, and what is left is
verified by a banded bit-parallel edit distance.

Skew: a bucket of more than BLOCK lines (a segment that very many lines share) is dealt anew:
cut into TAU + 2 segments, lines within TAU edits share two of them, so one besides what lies
in the shared segment; lines meet again only by that. What is still larger makes
ceil(n / BLOCK) blocks by a hash of the line, and only pairs that pass the count filter leave
a block. Equal lines meet as one line; their occurrences are counted by a partial aggregation,
and hot lines are joined back by broadcast. Equal means equal in 127 bits of hashes; lines
that are only alike are confirmed by their texts.

Defined results: null text has no lines; other lines stay as they are; rows repeated under
one id tie, and the first occurrence stays in both; a null id comes before all others; an
empty table gives no rows; extra columns, whatever their names, are ignored by duplicates()
and returned by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TAU, MIN_BYTES, BLOCK, CLASSES = 2, 16, 2048, 16
PART_BYTES, HELD_BYTES = 32 << 20, 16 << 20
_ENTRY = np.dtype([("sig", "V5"), ("line", "<u8")])
#: Byte classes of the count filter, by a fixed hash of the byte.
_CLASS = (C.seeded(256, 41) % C.U(CLASSES)).astype(np.int8)


def spans(w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed start and end, document and number of every line (empty ones too)."""
    starts, ends, doc = C.lines_of(w)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    a, b = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    full = b > a
    starts[full], ends[full] = w.starts[a[full]], w.ends[b[full] - 1]
    ends[~full] = starts[~full]
    return starts, ends, doc, number


def segments(length: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the tau + 1 even segments of lines of these lengths."""
    k = tau + 1
    base, extra = length // k, length % k
    i = np.arange(k)[:, None]
    size = base + (i >= k - extra)
    return np.cumsum(size, 0) - size, size


def signatures(data: np.ndarray, start: np.ndarray, end: np.ndarray, tau: int, places: bool = False):
    """(line index, signature, whether it indexes a segment) of the given lines; with `places` also the
    length of the lines that are looked for and the number of the segment."""
    values, length = C.BYTES[data], end - start
    owner, sig, index, lengths, numbers = [], [], [], [], []
    lines = np.arange(len(start))

    def add(which, at, size, own, i, is_index):
        s = start[which] + at
        with np.errstate(over="ignore"):
            h = C.mix(C.span_hash(values, s, s + size) ^ C.mix((own * (tau + 2) + i).astype(C.U)))
        owner.append(which)
        sig.append(h)
        index.append(np.full(len(which), is_index))
        if places:
            lengths.append(own)
            numbers.append(np.full(len(which), i))

    for less in range(tau + 1):
        own = length - less  # the length of the lines that are looked for
        at, size = segments(own, tau)
        for i in range(tau + 1):
            low = np.maximum(-i, less - (tau - i))
            high = min(i, less + (tau - i))
            for shift in range(low, high + 1):
                p = at[i] + shift
                ok = np.flatnonzero((p >= 0) & (p + size[i] <= length) & (size[i] > 0))
                add(lines[ok], p[ok], size[i][ok], own[ok], i, less == 0 and shift == 0)
    return tuple(map(np.concatenate, (owner, sig, index, *((lengths, numbers) if places else ()))))


_CHECK = C.seeded(256, 43)


def _line_ids(data, start, end):
    return C.span_hash(C.BYTES[data], start, end) & ~C.U(1)


def _scan(tau: int, min_bytes: int):
    def scan(batches):
        for batch in batches:
            for row, stop, data, at in C.chunks(batch.column("text")):
                w = C.Words(data, at)
                start, end, doc, number = spans(w)
                long = end - start >= min_bytes
                n_lines = np.bincount(doc, minlength=w.n)
                empty = np.diff(at) == 0
                start, end, doc, number = (x[long] for x in (start, end, doc, number))
                bag, kind, total = np.zeros(len(start), C.U), _CLASS[data], np.zeros(len(data) + 1, np.int32)
                for c in range(CLASSES):
                    np.cumsum(kind == c, out=total[1:])
                    bag |= ((total[end] - total[start]) & 15).astype(C.U) << C.U(4 * c)
                offsets = np.zeros(w.n + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=w.n), out=offsets[1:])
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind))
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row, stop - row) for c in names),
                        pa.array(np.where(empty, 0, n_lines).astype(np.int64)),
                        lists(_line_ids(data, start, end).astype(np.int64), pa.int64()),
                        lists(C.span_hash(_CHECK[data], start, end).astype(np.int64), pa.int64()),
                        lists(number.astype(np.int32), pa.int32()),
                        lists(bag.astype(np.int64), pa.int64()),
                    ],
                    names=[*names, "n_lines", "line", "check", "number", "bag"],
                )

    return scan


def _pack(tau: int, min_bytes: int, parts: int):
    """Signatures of each chunk's distinct lines as one binary block for each partition."""

    def pack(batches):
        for batch in batches:
            for _, _, data, at in C.chunks(batch.column("text")):
                w = C.Words(data, at)
                start, end, _, _ = spans(w)
                long = end - start >= min_bytes
                start, end = start[long], end[long]
                line, first = np.unique(_line_ids(data, start, end), return_index=True)
                first.sort()
                start, end = start[first], end[first]
                line = _line_ids(data, start, end)
                owner, sig, index = signatures(data, start, end, tau)
                part = (sig >> C.U(40)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                entry = np.empty(len(sig), _ENTRY)
                entry["sig"] = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").reshape(-1)
                entry["line"] = line[owner] | index.astype(C.U)
                entry, part = entry[order], part[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                blocks = [x.tobytes() for x in np.split(entry, cuts)] if len(entry) else []
                heads = part[np.concatenate([[0], cuts])] if len(entry) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(heads, np.int32), pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return pack


def _distinct(sig: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((line, sig))
    sig, line = sig[order], line[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (line[1:] != line[:-1])
    return sig[new], line[new]


def _shared(sig: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of buckets that hold different lines, one of them indexed (its lowest bit)."""
    if not len(sig):
        return sig, line
    own = line >> C.U(1)
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    bucket = np.cumsum(first) - 1
    n_lines = np.bincount(bucket, weights=first | np.concatenate([[True], own[1:] != own[:-1]]))
    n_index = np.bincount(bucket, weights=(line & C.U(1)).astype(np.int64))
    ok = ((n_lines > 1) & (n_index > 0))[bucket]
    sig, line = sig[ok], line[ok]
    # a line that is indexed and probes one bucket stands there once, as indexed
    twice = np.zeros(len(sig), bool)
    twice[:-1] = (sig[1:] == sig[:-1]) & (line[1:] >> C.U(1) == line[:-1] >> C.U(1))
    return sig[~twice], line[~twice]


def _meet(batches):
    """Members of the buckets of each part, one part at a time (rows are sorted by part).

    Blocks are reduced to distinct entries whenever HELD_BYTES of them, and as many as are held, have come."""
    at, held, blocks, size = None, None, [], 0

    def reduced():
        entry = np.frombuffer(b"".join(blocks), _ENTRY)
        sig = np.zeros((len(entry), 8), np.uint8)
        sig[:, :5] = np.ascontiguousarray(entry["sig"]).view(np.uint8).reshape(-1, 5)
        sig, line = sig.view("<u8").reshape(-1), entry["line"]
        return _distinct(sig, line) if held is None else _distinct(np.concatenate([held[0], sig]), np.concatenate([held[1], line]))

    def done():
        sig, line = _shared(*reduced())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sig), at), pa.int32()), pa.array(sig.astype(np.int64), pa.int64()), pa.array((line & ~C.U(1)).astype(np.int64), pa.int64()), pa.array((line & C.U(1)).astype(bool), pa.bool_())],
            names=["part", "sig", "line", "is_index"],
        )

    for batch in batches:
        for p, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if p != at:
                if blocks or held is not None:
                    yield done()
                at, held, blocks, size = p, None, [], 0
            blocks.append(block)
            size += len(block)
            if size > max(HELD_BYTES, 0 if held is None else 16 * len(held[0])):
                held, blocks, size = reduced(), [], 0
    if blocks or held is not None:
        yield done()


def second(data: np.ndarray, start: np.ndarray, end: np.ndarray, sig: np.ndarray, part: np.ndarray, parts: int, tau: int):
    """(line index, signature, whether it may index) of lines within one bucket each: their tau + 2 segments
    at all shifts up to tau, without the one inside the segment that the bucket shares."""
    line, sigs, _, own, i = signatures(data, start, end, tau, True)
    same = ((sigs >> C.U(40)).astype(np.int64) % parts == part[line]) & ((sigs & C.U((1 << 40) - 1)) == sig[line])
    line, own, i = np.unique(np.stack([line[same], own[same], i[same]]), axis=1)
    pick = np.arange(len(line))
    shared, size = (x[i, pick] for x in segments(own, tau))
    out = []
    for j, (s, k) in enumerate(zip(*segments(own, tau + 1), strict=True)):
        new = (k > 0) & ((s < shared) | (s + k > shared + size))
        for shift in range(-tau, tau + 1):
            at = start[line] + s + shift
            ok = np.flatnonzero(new & (at >= start[line]) & (at + k <= end[line]))
            ok = ok[np.argsort(at[ok], kind="stable")]
            with np.errstate(over="ignore"):
                of = C.mix((own[ok] * 64 + i[ok] * 8 + j).astype(C.U) + sig[line[ok]] * C.P)
                out.append((line[ok], C.mix(C.span_hash(C.BYTES[data], at[ok], at[ok] + k[ok]) ^ of), np.full(len(ok), shift == 0)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _second(parts: int, tau: int):
    def run(batches):
        for batch in batches:
            for row, stop, data, at in C.chunks(batch.column("text")):
                own = batch.slice(row, stop - row)
                part, sig, line, is_index = (own.column(c).to_numpy(zero_copy_only=False) for c in ("part", "sig", "line", "is_index"))
                which, sigs, index = second(data, at[:-1], at[1:], sig.astype(C.U), part.astype(np.int64), parts, tau)
                yield pa.RecordBatch.from_arrays([pa.array(part[which]), pa.array(sigs.astype(np.int64)), pa.array(line[which]), pa.array(is_index[which] & index)], names=["part", "sig", "line", "is_index"])

    return run


def _pairs_of(rows: list[tuple], i: int, j: int, tau: int) -> tuple[list[int], list[int]]:
    """Pairs of a block that pass the count filter: one line indexed, of the two parts of the block."""
    line = np.array([r[0] for r in rows], np.int64)
    index = np.array([r[1] for r in rows], bool)
    own = np.array([r[3] for r in rows])
    bags = np.array([r[2] for r in rows], np.int64).astype(C.U)
    counts = ((bags[:, None] >> (C.U(4) * np.arange(CLASSES, dtype=C.U))) & C.U(15)).astype(np.int8)
    a, b = [], []
    for x in range(len(rows) - 1):
        ok = (index[x] | index[x + 1 :]) & ((own[x + 1 :] != own[x]) if i != j else True)
        ys = np.flatnonzero(ok) + x + 1
        gap = (counts[ys] - counts[x]) & 15
        gap = np.minimum(gap, 16 - gap).sum(1)
        for y in ys[gap <= 2 * tau]:
            a.append(min(line[x], line[y]))
            b.append(max(line[x], line[y]))
    return a, b


def _filter_pairs(tau: int):
    def run(batches):
        held, at = [], None
        for batch in batches:
            a, b = [], []
            for part, sig, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "sig", "i", "j", "line", "is_index", "bag", "own")), strict=True):
                if (part, sig, i, j) != at:
                    if len(held) > 1:
                        x, y = _pairs_of(held, at[2], at[3], tau)
                        a += x
                        b += y
                    held, at = [], (part, sig, i, j)
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(held) > 1:
            a, b = _pairs_of(held, at[2], at[3], tau)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def within(a: bytes, b: bytes, tau: int) -> bool:
    """Whether two strings are at most tau edits apart, by bit-parallel rows of a band of 2 tau + 1 diagonals.

    Bit o of row d says that the prefix of a that ends o - tau places beyond the current
    place in b can be reached with d edits.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    high = 0
    while high < len(a) and high < len(b) and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[: len(a) - high], b[: len(b) - high]
    if max(len(a), len(b)) <= tau:
        return True
    places: dict[int, int] = {}
    for j, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << (j + tau)
    band = (1 << (2 * tau + 1)) - 1
    rows = [((1 << (d + 1)) - 1) << tau & band for d in range(tau + 1)]
    for i, x in enumerate(b):
        same = places.get(x, 0) >> i
        before, above = 0, 0
        for d, row in enumerate(rows):
            new = row & same
            if d:
                new |= before >> 1 | before | above << 1
            before, rows[d] = row, new & band
            above = rows[d]
        if not above:
            return False
    return bool(rows[tau] >> (len(a) - len(b) + tau) & 1)


def _verify(tau: int):
    def verify(batches):
        for batch in C.small(batches):
            keep = [within(x, y, tau) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _cut(batches):
    for batch in C.small(batches):
        lines, texts = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            own = text.split("\n")
            for x in wanted:
                lines.append(x["line"])
                texts.append(own[x["number"]].encode().strip(b" \t\n\r\x0b\x0c"))
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(texts, pa.binary())], names=["line", "text"])


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU, min_bytes: int = MIN_BYTES, exact_bytes: int = 1) -> DataFrame:
    """id, row_key, n_lines, removed (numbers of the lines that go, from 0); a row for each row.

    exact_bytes: length from which equal lines go, 1 at least and min_bytes at most."""
    if min_bytes <= 2 * tau:
        raise ValueError("min_bytes must exceed 2 * tau")
    exact_bytes = max(1, min(exact_bytes, min_bytes))
    spark = C.bounded(docs)
    scratch = C.Scratch(spark, "lines")
    rows = docs.select(F.col(doc_id).alias("id"), C.row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = rows.mapInArrow(_scan(tau, exact_bytes), f"id {kind}, key long, n_lines long, line array<long>, check array<long>, number array<int>, bag array<long>")
    scanned = scratch.keep(scanned, "scanned")
    every = scanned.select("id", "key", F.explode(F.arrays_zip("line", "check", "number", "bag")).alias("x")).select("id", "key", "x.*")

    # buckets of lines that share a segment
    parts = C.parts(spark)
    n_lines = scanned.agg(F.coalesce(F.sum(F.size("line")), F.lit(0))).first()[0]
    packs = max(4 * parts, n_lines * 2 * (tau + 1) ** 2 * _ENTRY.itemsize // PART_BYTES)  # about 2 (tau + 1)^2 signatures a line
    packed = rows.select("text").mapInArrow(_pack(tau, min_bytes, packs), "part int, block binary")
    members = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, "part int, sig long, line long, is_index boolean")
    members = scratch.keep(members, "members")
    involved = members.select("line").distinct()
    first = every.groupBy("line", "check").agg(F.min(F.struct("id", "number")).alias("first"), F.min_by("key", F.struct("id", "number")).alias("key"), F.first("bag").alias("bag"), F.count(F.lit(1)).alias("n"))
    first = scratch.keep(first.join(involved.withColumn("involved", F.lit(True)), "line", "left").filter("n > 1 or involved"), "first")

    def texts_of(lines: DataFrame, name: str) -> DataFrame:
        """line, text, from the first occurrence."""
        wanted = lines.distinct().join(first, "line").select("line", "key", "first.id", "first.number")
        wanted = wanted.groupBy(F.col("id").alias("own"), "key").agg(F.collect_list(F.struct("line", "number")).alias("wanted"))
        texts = rows.withColumnRenamed("key", "row").join(wanted.hint("merge"), (F.col("row") == F.col("key")) & F.col("id").eqNullSafe(F.col("own"))).select("text", "wanted")
        return scratch.keep(texts.mapInArrow(_cut, "line long, text binary").dropDuplicates(["line"]), name)

    sizes = scratch.keep(members.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n")), "sizes")
    if sizes.filter(F.col("n") > BLOCK).isEmpty():
        buckets = members.withColumn("blocks", F.lit(1))
    else:
        members = scratch.keep(C.join_each(members, sizes, ["part", "sig"]), "sized")
        hot = members.filter(F.col("n") > BLOCK).drop("n")
        hot = hot.join(texts_of(hot.select("line"), "hot-texts"), "line").mapInArrow(_second(packs, tau), "part int, sig long, line long, is_index boolean")
        hot = scratch.keep(hot.groupBy("part", "sig", "line").agg(F.max("is_index").alias("is_index")), "hot")
        again = hot.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n"), F.max("is_index").alias("any")).filter("n > 1 and any").drop("any")
        hot = C.join_each(hot, scratch.keep(again, "hot-sizes"), ["part", "sig"])
        buckets = members.filter(F.col("n") <= BLOCK).unionByName(hot).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    spread = buckets.join(first.filter("involved").select("line", "bag"), "line")
    spread = spread.withColumn("own", F.pmod(F.xxhash64("line"), "blocks").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("part", "sig", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "line", "is_index", "bag", "own")
    spread = spread.repartition(parts, "part", "sig", "i", "j").sortWithinPartitions("part", "sig", "i", "j")
    pairs = scratch.keep(spread.mapInArrow(_filter_pairs(tau), "a long, b long").distinct(), "pairs")

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("line")), "texts")
    both = pairs.join(texts.withColumnsRenamed({"line": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"line": "a", "text": "text_a"}), "a")
    links = scratch.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(tau), "a long, b long"), "links")

    at = first.select("line", "first")
    ends = links.join(at.withColumnsRenamed({"line": "a", "first": "at_a"}), "a").join(at.withColumnsRenamed({"line": "b", "first": "at_b"}), "b")
    later = ends.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).when(F.col("at_b") < F.col("at_a"), F.col("a")).alias("line")).filter("line is not null").distinct()
    later = first.select("line", "check", "first", "n").join(later.withColumn("later", F.lit(True)), "line", "left").filter("n > 1 or later")
    gone = C.join_each(every.select("id", "key", "line", "check", "number"), scratch.keep(later, "later"), ["line", "check"])
    gone = gone.filter(F.coalesce("later", F.lit(False)) | ~F.struct("id", "number").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("own"), F.col("key").alias("row")).agg(F.sort_array(F.collect_set("number")).alias("removed"))
    scratch.drop("members", "sizes", "sized", "hot", "hot-texts", "hot-sizes", "pairs", "texts", "links", "first")
    out = scanned.select("id", "key", "n_lines").join(gone, F.col("id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("row")), "left")
    return out.select("id", F.col("key").alias("row_key"), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def _rebuild(batches):
    for batch in C.small(batches):
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            if text is not None and gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            texts.append(text)
        names = [n for n in batch.schema.names if n != "removed"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names], names=names)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """All documents with all their columns, their text without the lines that go (it may become empty)."""
    gone = duplicates(docs, doc_id, text, **more).select("id", "row_key", "removed").dropDuplicates(["id", "row_key"])
    out = C.marked(docs, gone, doc_id, text).drop("mark_key").withColumnRenamed(C.place(docs, text), "text")
    out = out.mapInArrow(_rebuild, out.drop("removed").schema)
    return C.named(out.withColumnRenamed("text", C.place(docs, text)), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicates(C.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


#: levenshtein() counts bytes; of two lines within 2 edits one third of one stands whole in the other.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, i - 1 AS number, trim(ls[i], E' \t\n\r\x0b\x0c') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
l AS (SELECT * FROM l0 WHERE line <> ''),
f AS (SELECT line, min({'d': doc_id, 'n': number}) AS fst FROM l GROUP BY 1),
s AS (SELECT line, fst, strlen(line) AS n, line[1:length(line) // 3] AS s1, line[length(line) // 3 + 1:2 * (length(line) // 3)] AS s2, line[2 * (length(line) // 3) + 1:] AS s3 FROM f WHERE strlen(line) >= 16),
later AS (SELECT DISTINCT b.line FROM s a JOIN s b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.fst < b.fst
    WHERE (contains(b.line, a.s1) OR contains(b.line, a.s2) OR contains(b.line, a.s3)) AND levenshtein(a.line, b.line) <= 2),
g AS (SELECT doc_id, number FROM l JOIN f USING (line) WHERE line IN (SELECT line FROM later) OR {'d': doc_id, 'n': number} <> f.fst),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS removed FROM g GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.removed, '') AS removed_lines
FROM d LEFT JOIN r USING (doc_id)
"""
