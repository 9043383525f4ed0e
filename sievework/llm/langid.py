"""Language identification in two steps: family first, then languages within the family.

Features are relative frequencies of hashed byte trigrams (A-Z lowered, other ASCII read as
a space), so a text's decision value is the mean of weights over all its positions and needs
no vector for each document. One-versus-rest linear SVMs pick the family; one-versus-one
linear SVMs between the languages of that family vote by their margins.

Fitting uses a bounded sample of labelled rows: at most SAMPLE_ROWS in all, shared evenly by
the languages and chosen by a hash of the id; their trigram counts come to the driver as
fixed-size vectors (SAMPLE_ROWS * DIMS * 4 bytes at most). Everything else covers all rows.

Defined results: null text or text without a letter gives `und` and score 0; null or unknown
labels are not learned; if nothing can be learned every row is `und`; repeated rows each get
a row; an empty table gives none; extra columns are kept, and one with the
name of an output column gets `_given` behind its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DIMS, SAMPLE_ROWS, MIN_LETTERS = 4096, 2400, 1
#: Families of ISO 639-1 codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "de nl en sv da no nb nn is af fy lb yi fo".split(),
    "romance": "fr es it pt ca ro gl oc la ast co sc".split(),
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl".split(),
    "indic": "hi mr ne bn as gu pa ur or si".split(),
    "turkic": "tr az kk ky uz tt tk ug".split(),
    "uralic": "fi et hu se".split(),
    "semitic": "ar he am mt ti".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy gd br".split(),
    "malayic": "id ms jv su tl".split(),
    "dravidian": "ta te kn ml".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_SHAPE = np.full(256, 32, np.uint32)
_SHAPE[128:] = np.arange(128, 256)
_SHAPE[97:123] = np.arange(97, 123)
_SHAPE[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each position, and first[d]:first[d + 1] of those inside document d."""
    n = len(data) - 2
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    s = _SHAPE[data]
    code = ((s[:n] * np.uint32(0x9E3779B1) ^ s[1 : n + 1] * np.uint32(0x85EBCA77)) + s[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    inside = np.ones(n, bool)
    for edge in at[1:-1]:
        inside[max(0, edge - 2) : edge] = False
    total = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    return (code >> np.uint32(20)).astype(np.int64)[inside], total[np.minimum(at, n)]


def _vectors(batches):
    for batch in batches:
        out = []
        for _, _, data, at in C.chunks(batch.column("text")):
            codes, first = trigrams(data, at)
            out += [np.bincount(codes[a:b], minlength=DIMS).astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(out, pa.binary())], names=["lang", "order", "counts"])


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged sub-gradient steps over all rows; the classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    total, total_b, n = np.zeros_like(w), 0.0, 0
    for t in range(1, rounds + 1):
        miss = (y * (x @ w + b) < 1).astype(np.float32) * weight * y
        step = 1.0 / (strength * (t + 50) * 20)
        w = (1 - step * strength) * w + step * (x.T @ miss)
        b += step * float(miss.sum()) * 0.1
        if t > rounds // 2:
            total, total_b, n = total + w, total_b + b, n + 1
    return total / n, total_b / n


def fit(langs: list[str], counts: np.ndarray) -> dict:
    """Weights on raw relative frequencies of every family and every pair within a family."""
    x = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    mean, spread = x.mean(0), x.std(0) + 1e-4
    z = ((x - mean) / spread).astype(np.float32) / np.sqrt(x.shape[1])
    langs_a = np.array(langs)
    families = {f: sorted(l for l in set(langs) if family_of(l) == f) for f in sorted({family_of(l) for l in langs})}

    def machine(rows, positive):
        w, b = svm(z[rows], np.where(positive[rows], 1, -1).astype(np.float32))
        raw = w / spread / np.sqrt(x.shape[1])
        return raw.astype(np.float64), float(b - raw @ mean)

    everything = np.ones(len(langs), bool)
    own = np.array([family_of(l) for l in langs])
    return {
        "families": families,
        "family": {f: machine(everything, own == f) for f in families} if len(families) > 1 else {},
        "pairs": {(a, b): machine(np.isin(langs_a, [a, b]), langs_a == a) for ls in families.values() for i, a in enumerate(ls) for b in ls[i + 1 :]},
    }


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(2 * x, -30, 30)))


def decide(model: dict, codes: np.ndarray, first: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = np.maximum(np.diff(first), 1)

    def value(machine):
        sums = np.zeros(len(codes) + 1)
        np.cumsum(machine[0][codes], out=sums[1:])
        return (sums[first[1:]] - sums[first[:-1]]) / n + machine[1]

    names = list(model["families"])
    if model["family"]:
        margins = np.stack([value(model["family"][f]) for f in names])
        best, score = margins.argmax(0), _sigmoid(margins.max(0))
    else:
        best, score = np.zeros(len(n), np.int64), np.ones(len(n))
    langs = np.empty(len(n), object)
    for k, f in enumerate(names):
        own = model["families"][f]
        if len(own) == 1:
            langs[best == k] = own[0]
            continue
        if not (best == k).any():
            continue
        votes = np.zeros((len(own), len(n)))
        for i, a in enumerate(own):
            for j in range(i + 1, len(own)):
                p = _sigmoid(value(model["pairs"][a, own[j]]))
                votes[i] += p
                votes[j] += 1 - p
        votes /= len(own) - 1
        pick = votes.argmax(0)
        langs[best == k] = np.array(own, object)[pick[best == k]]
        score = np.where(best == k, score * votes.max(0), score)
    return list(langs), score


def _predict(model_of):
    def predict(batches):
        model = model_of.value
        for batch in batches:
            langs, scores = [], []
            for _, _, data, at in C.chunks(batch.column("text")):
                letters = C.Words.sums(_Bytes(at), (data | 0x20) - np.uint8(97) < 26)
                codes, first = trigrams(data, at)
                own, score = decide(model, codes, first) if model["families"] else (["und"] * (len(at) - 1), np.zeros(len(at) - 1))
                for d in np.flatnonzero(letters == 0):
                    if not any(map(str.isalpha, data[at[d] : at[d + 1]].tobytes().decode())):
                        own[d], score[d] = "und", 0.0
                langs += own
                scores += score.tolist()
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return predict


class _Bytes:
    def __init__(self, at):
        self.at = at


def train(rows: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model of rows with text and lang; `order` only spreads the sample."""
    spark = C.bounded(rows)
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(order).cast("string"), F.lit("langid")).alias("order"))
    rows = rows.filter("lang is not null and lang <> 'und' and text is not null and length(text) > 0")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not counts:
        return {"families": {}, "family": {}, "pairs": {}}
    share = max(1, sample_rows // len(counts))
    # a hash threshold that takes a little over the share of each language; the rest is cut below
    limits = [(l, min((1 << 63) - 1, -(1 << 63) + int((1.2 * share + 20) / n * (1 << 64)))) for l, n in counts.items()]
    under = spark.createDataFrame(limits, "lang string, most long")
    picked = rows.join(F.broadcast(under), "lang").filter("`order` <= most").select("text", "lang", "order")
    got = picked.mapInArrow(_vectors, "lang string, `order` long, counts binary").toArrow().sort_by([("lang", "ascending"), ("order", "ascending")])
    langs, vectors, seen = [], [], {}
    for l, v in zip(got.column("lang").to_pylist(), got.column("counts"), strict=True):
        seen[l] = seen.get(l, 0) + 1
        if seen[l] <= share:
            langs.append(l)
            vectors.append(np.frombuffer(v.as_buffer(), np.float32))
    return fit(langs, np.stack(vectors))


def predict(rows: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, lang_pred, score; only the text is read for a prediction."""
    keep = [c for c in rows.columns if c != text] if keep is None else keep
    cut = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    shape = "".join(f"c{i} {cut.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep))) + "lang_pred string, score double"
    out = cut.mapInArrow(_predict(C.bounded(rows).sparkContext.broadcast(model)), shape)
    return out.withColumnsRenamed(C.beside(keep, out.columns[len(keep) :]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = train(docs.filter("not held_out and doc_id is not null"))
    return predict(docs, model, keep=["doc_id", "held_out"])
