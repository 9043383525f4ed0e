"""Shared pieces: reading tables, scratch tables and vectorised words over Arrow text.

A text column arrives in Python workers as Arrow batches. `chunks` cuts a batch into
runs of documents of at most CHUNK_BYTES (a longer document stands alone), and `Words`
finds and hashes all words of such a run at once with numpy, so that memory follows the
chunk and not the batch or the partition.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, for texts; taken only where the session has no setting of its own.
BATCH_ROWS = 512
#: Rows that one key may gather in a task of a join, at any size.
HOT_ROWS = 100

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where it is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
    return jsc.getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder; they go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(where)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts the lineage and survives lost executors."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def bounded(df: DataFrame) -> SparkSession:
    """The session, with Arrow batches that are small enough for long texts."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id, text):
    """Tells rows apart by id and text, also where ids repeat or are null."""
    return F.xxhash64(doc_id.cast("string"), F.lit("\x00"), text)


def apart(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ..., which clash with no name of an operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The name in apart(df) of a column, which Spark finds whatever its case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{name} names {len(found)} columns of {df.columns}")
    return f"c{found[0]}"


def marked(docs: DataFrame, marks: DataFrame, doc_id: str, text: str, how: str = "inner") -> DataFrame:
    """Rows of apart(docs) joined with `marks` (id, row_key and more; one row each) of their id and text."""
    rows = apart(docs)
    key = row_key(F.col(place(docs, doc_id)), F.col(place(docs, text)))
    own = marks.withColumnsRenamed({"id": "mark_id", "row_key": "mark_key"}).hint("merge")
    same = F.col(place(docs, doc_id)).eqNullSafe(F.col("mark_id")) & (F.col("own_key") == F.col("mark_key"))
    return rows.withColumn("own_key", key).join(own, same, how).drop("own_key", "mark_id")


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of apart(docs) under their own names again, and nothing else."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def beside(keep: list[str], outputs: list[str]) -> dict[str, str]:
    """c0, c1, ... and the names of kept columns beside an operator's outputs: one that has the name of an
    output gets _given behind it, until it clashes with none."""
    taken, out = {c.lower() for c in [*keep, *outputs]}, {}
    for i, c in enumerate(keep):
        name = c
        if c.lower() in {o.lower() for o in outputs}:
            while name.lower() in taken:
                name += "_given"
            taken.add(name.lower())
        out[f"c{i}"] = name
    return out


def join_each(rows: DataFrame, each: DataFrame, on: list[str], n: str = "n", least: int = HOT_ROWS) -> DataFrame:
    """rows joined with `each`, a written table with one row for each key and n, about the number of its rows.

    Keys with more than 1 / (4 * shuffle partitions) of all n, fewer than 4 * shuffle partitions
    by their definition, and more than `least`, meet their rows by broadcast; all others by
    shuffle. So no key, however hot, gathers its rows in one task, and what is broadcast does
    not grow with the data. Both sides are parted by a filter on the hashes of the hot keys, as
    few as they are; a key that shares such a hash only meets its rows by broadcast as well."""
    share = 4 * parts(rows.sparkSession)
    total, most = each.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if most <= least or most * share <= total:
        return rows.join(each, on)
    key = F.xxhash64(*on)
    found = each.filter((F.col(n) > least) & (F.col(n) * share > total)).select(key).distinct().collect()
    hot = key.isin([r[0] for r in found])
    return rows.filter(hot).join(F.broadcast(each.filter(hot)), on).unionByName(rows.filter(~hot).join(each.filter(~hot), on))


# --- text in numpy ---------------------------------------------------------------------------


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; all rows appear once, in order."""
    data, at = raw(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def small(batches, rows: int = 256):
    """The batches in slices, so that Python copies of their texts stay few."""
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95))


P = U(0x9E3779B97F4A7C15 | 1)
P_INV = U(pow(int(P), -1, 1 << 64))
SLAB = 1 << 17
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("p", ())):
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in (("p", P), ("q", P_INV)):
                p = np.full(n, base, U)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                _powers[k] = p
    return _powers["p"], _powers["q"]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; spans are sorted by start.

    Polynomial prefix sums modulo 2**64 over random values, then mixed with the length.
    Works through slabs, so that temporary arrays are bounded unless one span is longer.
    """
    out = np.empty(len(starts), U)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            base = int(starts[a])
            b = max(a + 1, int(np.searchsorted(starts, base + SLAB, "left")))
            top = int(ends[a:b].max())
            p, q = powers(top - base + 1)
            sums = np.empty(top - base + 1, U)
            sums[0] = 0
            np.cumsum(values[base:top] * p[: top - base], out=sums[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
            a = b
    return out


BYTES = seeded(256, 1)
#: Values of bytes with A-Z read as a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
#: Values of bytes with A-Z read as a-z and all digits as 0.
LOOSE = FOLDED.copy()
LOOSE[48:58] = BYTES[48]
#: Bytes of words `[^\x20\x09-\x0D]+` and of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (before folding A-Z).
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """Words of a run of documents: byte spans, the document of each, and hashes on demand."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray = SPACED):
        self.data, self.at, self.n = data, at, len(at) - 1
        word = kind[data]
        self.is_word = word
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: first[d]:first[d + 1] are the words of document d
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, values: np.ndarray = BYTES) -> np.ndarray:
        return span_hash(values[self.data], self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and whether a run stays in its document."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, bool)
        with np.errstate(over="ignore"):
            out = np.zeros(n, U)
            for j, c in enumerate(seeded(k, seed) | U(1)):
                out += hashes[j : j + n] * c
            return mix(out), self.doc[:n] == self.doc[k - 1 :]

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Counts of a byte mask by document."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def word_list(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of one text: bytes.split() cuts at just these characters."""
    return text.split()


def lines_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line (split at \\n); a document of n line breaks has n + 1 lines."""
    cut = np.flatnonzero(w.data == 10)
    starts = np.concatenate([w.at[:-1], cut + 1])
    ends = np.concatenate([w.at[1:], cut])
    doc = np.concatenate([np.arange(w.n), np.searchsorted(w.at, cut, "right") - 1])
    starts, doc = (x[np.lexsort((starts, doc))] for x in (starts, doc))
    # ends sort the same way: line i of a document ends at its i-th break, the last at its end
    ends = ends[np.lexsort((ends, np.concatenate([np.arange(w.n), np.searchsorted(w.at, cut, "right") - 1])))]
    return starts, ends, doc
