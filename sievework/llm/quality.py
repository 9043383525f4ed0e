"""Quality rules: counts of each document and cross-document line frequency.

Lines are normalised (A-Z lowered, digits read as 0, white space collapsed) and hashed;
for each host the distinct documents that hold a line are counted (by id and text, so copies
under other ids count, rows that repeat do not). A line in `min_docs` of them, whatever the
size of the host, is taken out, and a document of which less than `min_left` percent of the
words or fewer than `min_words` remain is rejected as depleted.

Skew: lines are distinct within a document before the count, which is a partial
aggregation; the lines at the limit are joined back, the hottest by broadcast and all others,
however many, by shuffle.

Defined results: null text has no words (base fails); null host is a host of its own; rows
repeated with one id each get a row, and clean() keeps each; an empty table gives no rows;
extra columns, whatever their names, are ignored by judge() and returned by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: A line in so many distinct documents of its host is boilerplate.
MIN_DOCS, MIN_LEFT = 20, 30
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches):
    for batch in batches:
        column = batch.column("text")
        for row, end, data, at in C.chunks(column):
            w = C.Words(data, at)
            hashes = w.hashes()
            key = C.mix(np.arange(w.n, dtype=C.U) + C.U(1))
            # words in 3-word windows found twice or more in their document
            grams, inside = w.grams(hashes, 3)
            where = np.flatnonzero(inside)
            repeated = np.zeros(len(hashes), bool)
            if len(where):
                _, inverse, n = np.unique(grams[where] ^ key[w.doc[where]], return_inverse=True, return_counts=True)
                i = where[n[inverse] > 1]
                repeated[i] = repeated[i + 1] = repeated[i + 2] = True
            # lines
            starts, ends, doc = C.lines_of(w)
            a, b = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
            full = b > a
            starts, ends, doc, a, b = (x[full] for x in (starts, ends, doc, a, b))
            exact = C.span_hash(C.BYTES[data], starts, ends) ^ key[doc]
            _, seen = np.unique(exact, return_index=True)
            again = np.ones(len(exact), bool)
            again[seen] = False
            loose = C.span_hash(w.hashes(C.LOOSE), a, b)
            per_doc = lambda x, of: np.bincount(of, weights=x, minlength=w.n).astype(np.int64)
            offsets = np.zeros(w.n + 1, np.int32)
            np.cumsum(np.bincount(doc, minlength=w.n), out=offsets[1:])
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind))
            out = [batch.column(i).slice(row, end - row) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            out += [
                pa.array(w.counts.astype(np.int64)),
                pa.array(w.sums(w.is_word & ((data & 0xC0) != 0x80))),
                pa.array(w.sums(SYMBOLS[data])),
                pa.array(per_doc(again, doc)),
                pa.array(per_doc(repeated, w.doc)),
                lists(loose.astype(np.int64), pa.int64()),
                lists((b - a).astype(np.int32), pa.int32()),
            ]
            names = [n for n in batch.schema.names if n != "text"] + [*COUNTS, "line", "line_words"]
            yield pa.RecordBatch.from_arrays(out, names=names)


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    min_left: int = MIN_LEFT,
    min_words: int = MIN_WORDS,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """id, row_key, host, counts, base_failed, n_left, removed (positions of lines with a word), kept; a row for each row."""
    spark = C.bounded(docs)
    scratch = C.Scratch(spark, "quality")
    rows = docs.select(
        F.col(doc_id).alias("id"),
        C.row_key(F.col(doc_id), F.col(text)).alias("row_key"),
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
        F.col(text).cast("string").alias("text"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    kinds += "".join(f", {c} long" for c in COUNTS) + ", line array<long>, line_words array<int>"
    rows = scratch.keep(rows.mapInArrow(_measure, kinds), "rows")

    each = rows.groupBy("host", "id", "row_key").agg(F.first("line").alias("line"))
    lines = each.select("host", F.explode(F.array_distinct("line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = scratch.keep(lines.filter(F.col("n") >= min_docs), "often")

    hits = rows.select("id", "row_key", "host", F.posexplode(F.arrays_zip("line", "line_words")).alias("at", "x"))
    hits = hits.select("id", "row_key", "host", "at", F.col("x.line").alias("line"), F.col("x.line_words").alias("words"))
    hits = C.join_each(hits, often, ["host", "line"]).dropDuplicates(["id", "row_key", "at"])
    hits = hits.groupBy(F.col("id").alias("id2"), F.col("row_key").alias("key2")).agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("at")).alias("removed"))
    out = rows.drop("line", "line_words").join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row_key") == F.col("key2")), "left").drop("id2", "key2")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return (
        out.withColumn("n_left", left)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left * 100 >= F.col("n_words") * min_left) & (left >= min_words))
        .drop("gone")
    )


def _drop_lines(batches):
    for batch in C.small(batches):
        gone, texts = batch.column("removed").to_pylist(), batch.column("text").to_pylist()
        out = []
        for drop, text in zip(gone, texts, strict=True):
            if not drop or text is None:
                out.append(text)
                continue
            drop, at, kept = set(drop), 0, []
            for line in text.split("\n"):
                full = bool(line.encode().split())
                if not (full and at in drop):
                    kept.append(line)
                at += full
            out.append("\n".join(kept))
        names = [n for n in batch.schema.names if n != "removed"]
        cols = [pa.array(out, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that are kept, with all their columns, without the lines above the limits."""
    verdict = judge(docs, doc_id, text, host, **limits).filter("kept").select("id", "row_key", "removed").dropDuplicates(["id", "row_key"])
    out = C.marked(docs, verdict, doc_id, text).drop("mark_key").withColumnRenamed(C.place(docs, text), "text")
    out = out.mapInArrow(_drop_lines, out.drop("removed").schema)
    return C.named(out.withColumnRenamed("text", C.place(docs, text)), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(C.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rp AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM rp) GROUP BY 1),
l0 AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' ') AS norm
    FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
often AS (SELECT host, norm FROM l GROUP BY 1, 2 HAVING count(DISTINCT (doc_id, text)) >= 20),
gone AS (SELECT doc_id, sum(n) AS n FROM l SEMI JOIN often USING (host, norm) GROUP BY 1),
r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(gone.n, 0) AS gone
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * (n_words - gone) >= 30 * n_words AND n_words - gone >= 50 AS kept FROM f
"""
