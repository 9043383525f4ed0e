"""MinHash near-duplicates with odd sketches.

Each document becomes the set of hashes of its distinct shingles. Equal sets (a 128-bit
fingerprint) form a class with one representative. BANDS bands of ROWS MinHash samples give
buckets; the samples are also folded into a parity bitmap of BITS bits, whose XOR with
another's counts the samples that differ and so estimates the similarity. Candidates that
pass that estimate (SLACK below the threshold) are confirmed on their full shingle sets.

Inside a bucket not all pairs are made. The member that meets most others over all buckets
leads it (of equals the smallest id), and each member is compared with the best leader that
it meets: estimate first, then full sets. Members that link to the leader share its
component. A member u that doesn't can only link to another, m, if their differences from
the leader L have enough in common (|u ^ m| = |u ^ L| + |m ^ L| - 2 common), always more than
half of m's. So each group that has such a member moves to the member nearest to what most of
the group has, and the elements of the differences from that leader are joined, of u and of m the rarest ones
that must hold a common one; pairs that can't have enough in common, also by what stands
behind the element that they share, are dropped, and the rest is confirmed. That settles buckets whose members share one leader; in the others all
members are compared with the bucket's own leader in the same way. So no link that the
bands find is lost, and a group of copies costs one comparison each.

The estimate decides whether a member is linked to its leader and which of the other pairs are
confirmed. The members' differences from their leader are needed whatever it says.

Skew: classes, leaders and elements that very many rows share are joined back by broadcast
(common.join_each); all other joins are shuffles of tables on both sides.

Defined results: null text, empty text or text without words has an empty set and stands
alone; fewer words than a shingle count as one shingle; rows with null id are linked like
others, take the component of the smallest id that they reach and are not kept if there is
one, else their component is null and the rows of one of their texts are kept; rows repeated
under one id get the same component, and an id that stands on rows of different texts joins
theirs; an empty table gives none; extra columns, whatever their names, are ignored by group()
and returned by clean().

With 25 bands of 4 rows a pair at similarity 0.85 is missed with probability 1e-8, at 0.8
with 2e-6. The estimate drops a pair that shares a band with less: of simulated pairs at the
threshold none of ten million at 0.85 and at 0.8 was SLACK below it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

BANDS, ROWS, BITS, SLACK = 25, 4, 512, 0.28
SAMPLES = BANDS * ROWS
SHINGLE, PERCENT = 5, 80
_A, _B, _C = C.seeded(SAMPLES, 11) | C.U(1), C.seeded(SAMPLES, 12), C.seeded(ROWS, 13) | C.U(1)
_BAND = C.seeded(BANDS, 14)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    w = C.Words(data, at)
    hashes = w.hashes(C.FOLDED)
    grams, _ = w.grams(hashes, k, 21)
    out = []
    c = C.seeded(k, 22) | C.U(1)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        n = int(b - a)
        if n >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(C.mix(np.array([(hashes[a:b] * c[:n]).sum(dtype=C.U) + C.U(n)], C.U)))
        else:
            out.append(np.empty(0, C.U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values."""
    with np.errstate(over="ignore"):
        low = np.full(SAMPLES, np.iinfo(np.uint64).max, C.U)
        for i in range(0, len(shingles), 4096):
            np.minimum(low, (shingles[i : i + 4096, None] * _A + _B).min(0), out=low)
    return low


def fold(samples: np.ndarray) -> bytes:
    """The odd sketch: bit h of the bitmap is the parity of the samples that hash to h."""
    bits = (C.mix(samples ^ _B) >> C.U(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=BITS).astype(np.uint8) & 1).tobytes()


def estimate(different_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * different_bits / BITS, 1 - 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - share)


def most_bits(similarity: float) -> int:
    """The largest XOR population count at which the estimate reaches a similarity."""
    z = np.arange(BITS // 2)
    return int(np.flatnonzero(estimate(z) >= similarity).max(initial=-1))


def _sketch(k: int):
    def sketch(batches):
        for batch in batches:
            n, f1, f2, bands, odd = [], [], [], [], []
            for _, _, data, at in C.chunks(batch.column("text")):
                for s in shingle_sets(data, at, k):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        f1.append(int((C.mix(s)).sum(dtype=C.U).astype(np.int64)))
                        f2.append(int((C.mix(s ^ C.U(0xA5A5A5A5A5A5A5A5)) * C.U(0x9E3779B97F4A7C15)).sum(dtype=C.U).astype(np.int64)))
                        if len(s):
                            m = signature(s)
                            bands.append(C.mix((m.reshape(BANDS, ROWS) * _C).sum(1, dtype=C.U) + _BAND).astype(np.int64))
                            odd.append(fold(m))
                        else:
                            bands.append(np.empty(0, np.int64))
                            odd.append(b"")
            names = [c for c in batch.schema.names if c != "text"]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*bands, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, pa.array(odd, pa.binary())],
                names=[*names, "n_shingles", "f1", "f2", "bands", "odd"],
            )

    return sketch


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same > 0 and 100 * same >= percent * (len(x) + len(y) - same)


class _Sets:
    """Shingle sets of the last few texts."""

    def __init__(self, k: int):
        self.k, self.last = k, {}

    def __call__(self, text: str) -> np.ndarray:
        if text not in self.last:
            if len(self.last) >= 64:
                self.last.clear()
            raw = (text or "").encode()
            self.last[text] = shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), self.k)[0]
        return self.last[text]


def _confirm(k: int, percent: int):
    def confirm(batches):
        set_of = _Sets(k)
        for batch in C.small(batches):
            keep = [_linked(set_of(a), set_of(b), percent) for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _differ(k: int, percent: int, limit: int):
    """linked; size of the member's set; how it differs from its leader's; and how many of those elements
    another member must share at least to link to this one: must if the other doesn't link to the leader,
    least if only this one doesn't."""

    def differ(batches):
        set_of = _Sets(k)
        for batch in C.small(batches):
            linked, sizes, must, least, differences = [], [], [], [], []
            for a, b, bits in zip(*(batch.column(c).to_pylist() for c in ("text_a", "text_b", "different")), strict=True):
                member, leader = set_of(a), set_of(b)
                d = np.setxor1d(member, leader, assume_unique=True)
                linked.append(bits <= limit and _linked(member, leader, percent))
                sizes.append(len(member))
                must.append(((100 + percent) * len(d) + (100 - percent) * (len(leader) - len(member))) // (2 * (100 + percent)) + 1)
                least.append(max(1, -(((100 - percent) * (len(leader) + len(member)) - (100 + percent) * len(d)) // (2 * (100 + percent)))))
                differences.append(d.astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(d) for d in differences])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*differences, np.empty(0, np.int64)]), pa.int64()))
            columns = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(must, pa.int32()), pa.array(least, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "leader", "linked", "n", "must", "least", "differs"])

    return differ


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, row_key, n_shingles, component, kept; a row for each row. Links at 100 * common >= percent * union.

    The representative of a class, `rep`, is the least (id is null, id, row key) of its rows."""
    spark = C.bounded(docs)
    scratch = C.Scratch(spark, "near-dup")
    rows = docs.select(F.col(doc_id).alias("id"), C.row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, row_key long, n_shingles long, f1 long, f2 long, bands array<long>, odd binary"
    sketched = scratch.keep(rows.mapInArrow(_sketch(shingle), shape), "sketched")
    kind = f"struct<none:boolean,id:{kind},key:bigint>"
    fingerprint = ["f1", "f2", "n_shingles"]

    full = sketched.filter("n_shingles > 0")
    rep = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row_key").alias("key"))
    classes = full.groupBy(*fingerprint).agg(F.min(rep).alias("rep"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.count(F.lit(1)).alias("n"))
    classes = scratch.keep(classes, "classes")

    # members of buckets that hold more than one class
    band = classes.select(F.explode("bands").alias("bucket"), "rep").distinct()
    shared = scratch.keep(band.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    members = scratch.keep(C.join_each(band, shared, ["bucket"]), "members")
    score = members.groupBy("rep").agg(F.sum("n").alias("score"))
    involved = scratch.keep(score.join(classes.select("rep", "odd"), "rep"), "involved")
    wanted = involved.select("rep", F.col("rep.id").alias("own_id"), F.col("rep.key").alias("own_key"))
    texts = rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("row_key") == F.col("own_key")))
    texts = scratch.keep(texts.select("rep", "text").dropDuplicates(["rep"]), "texts")
    limit = most_bits(percent / 100 - SLACK)

    odd = involved.select("rep", "odd")

    def with_odd(pairs: DataFrame) -> DataFrame:
        """Pairs a, b with different, the bits in which their sketches differ."""
        near = pairs.join(odd.withColumnsRenamed({"rep": "b", "odd": "odd_b"}), "b").join(odd.withColumnsRenamed({"rep": "a", "odd": "odd_a"}), "a")
        return near.withColumn("different", _xor_bits("odd_a", "odd_b")).drop("odd_a", "odd_b")

    def with_texts(pairs: DataFrame, *more: str) -> DataFrame:
        both = pairs.join(texts.withColumnsRenamed({"rep": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"rep": "b", "text": "text_b"}), "b")
        return both.select("a", "b", "text_a", "text_b", *more)

    edges = []

    def compared(led: DataFrame, name: str) -> DataFrame:
        """Rows of rep and leader with their differences; links become edges."""
        pairs = with_texts(with_odd(led.select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()), "different")
        pairs = scratch.keep(pairs.mapInArrow(_differ(shingle, percent, limit), f"rep {kind}, leader {kind}, linked boolean, n int, must int, least int, differs array<long>"), name)
        edges.append(pairs.filter("linked").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
        return pairs

    def groups_of(pairs: DataFrame, name: str) -> DataFrame:
        """leader, size, alone: whether a member doesn't link."""
        return scratch.keep(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.max(~F.col("linked")).alias("alone")), name)

    def central(pairs: DataFrame, groups: DataFrame, step: int) -> DataFrame | None:
        """Groups with members that don't link, under the member nearest to what most of the group has; None if all stay.

        What more than half of the members differ by from their leader is the leader's own oddity; the
        member whose differences are nearest to it takes over, so that the shared oddity is small."""
        own = scratch.keep(C.join_each(pairs, groups.filter("alone").select("leader", "size"), ["leader"], "size"), f"alone-{step}")
        around = own.select("leader", "rep", "size", F.explode("differs").alias("e"))
        odd_ones = around.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("times"), F.first("size").alias("size")).filter("size > 2 and times * 2 > size")
        odd_ones = scratch.keep(odd_ones, f"odd-{step}")
        hits = C.join_each(around.drop("size"), odd_ones, ["leader", "e"], "times").groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("hits"))
        odd_count = scratch.keep(odd_ones.groupBy("leader").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size")), f"odd-count-{step}")
        near = C.join_each(own.select("leader", "rep", F.size("differs").alias("x")), odd_count, ["leader"], "size").join(hits, ["leader", "rep"], "left")
        best = near.groupBy("leader").agg(F.min(F.struct((F.col("x") + F.col("c") - 2 * F.coalesce("hits", F.lit(0))).alias("x"), "rep")).alias("best"), F.first("c").alias("c"))
        moved = scratch.keep(best.filter("best.x < c").select("leader", F.col("best.rep").alias("best")), f"moved-{step}")
        if moved.isEmpty():
            return None
        flagged = scratch.keep(groups.select("leader", "size").join(moved, "leader", "left"), f"flagged-{step}")
        flagged = C.join_each(pairs, flagged, ["leader"], "size").drop("size")
        group = flagged.filter("best is not null").select("rep", F.col("best").alias("leader"))
        group = group.union(moved.select(F.col("leader").alias("rep"), F.col("best").alias("leader"))).filter("rep <> leader")
        stay = flagged.filter("best is null").select("rep", "leader", "linked", "n", "must", "least", "differs")
        return stay.unionByName(compared(group, f"central-{step}"))

    def examined(led: DataFrame, step: int) -> None:
        """Compares rows of rep and leader, and what doesn't link with the others of its leader."""
        pairs = compared(led, f"pairs-{step}")
        groups = groups_of(pairs, f"sizes-{step}")
        if groups.filter("alone").isEmpty():
            return
        moved = central(pairs, groups, step)
        if moved is not None:
            pairs = scratch.keep(moved, f"groups-{step}")
            groups = groups_of(pairs, f"examined-{step}")
        alone = groups.filter("alone").select("leader", "size")
        around = C.join_each(pairs, alone, ["leader"], "size").select("leader", "rep", "linked", "n", "must", "least", F.size("differs").alias("x"), F.explode("differs").alias("e"))
        shared = scratch.keep(around.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), f"shared-{step}")
        around = C.join_each(around, shared, ["leader", "e"], "times").groupBy("leader", "rep").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("es"), *[F.first(c).alias(c) for c in ("linked", "n", "must", "least", "x")])
        around = scratch.keep(around.withColumn("k", F.size("es")), f"around-{step}")
        # Two sets with t common elements have one among the size - t + 1 rarest of each, and the first
        # one that they share has t - 1 others behind it. Elements that stand nowhere else are gone already.
        def rarest(c: str):
            return F.posexplode(F.slice("es.e", 1, F.greatest(F.lit(0), F.col("k") - F.col(c) + 1)))

        u = around.filter("not linked").select("leader", F.col("rep").alias("u"), F.col("n").alias("n_u"), F.col("x").alias("x_u"), F.col("k").alias("k_u"), F.col("must").alias("must_u"), rarest("least").alias("at_u", "e"))
        m = around.filter("k >= must").select("leader", F.col("rep").alias("m"), "linked", "n", "x", "k", rarest("must").alias("at", "e"))
        behind = F.least(F.col("k") - F.col("at"), F.col("k_u") - F.col("at_u"))
        enough = behind * (2 * (100 + percent)) >= (F.col("x") + F.col("x_u")) * (100 + percent) - (F.col("n") + F.col("n_u")) * (100 - percent)
        once = F.col("linked") | ((F.col("u") < F.col("m")) & (F.col("at_u") <= F.col("k_u") - F.col("must_u")))
        met = u.join(m, (u.leader == m.leader) & (u.e == m.e) & once & enough)
        met = met.select(F.least("u", "m").alias("a"), F.greatest("u", "m").alias("b")).distinct()
        met = with_odd(met).filter(F.col("different") <= limit).select("a", "b")
        edges.append(scratch.keep(with_texts(met).mapInArrow(_confirm(shingle, percent), f"a {kind}, b {kind}"), f"met-{step}"))

    # the best leader that a member meets in any bucket; it settles buckets whose members have no other
    own = members.select("bucket", "rep").join(involved.select("rep", (-F.col("score")).alias("rank")), "rep")
    tops = scratch.keep(own.groupBy("bucket").agg(F.min(F.struct("rank", "rep")).alias("top"), F.count(F.lit(1)).alias("n")), "tops")
    homes = C.join_each(own, tops, ["bucket"]).groupBy("rep").agg(F.min("top").alias("top")).select("rep", F.col("top.rep").alias("leader"))
    homes = scratch.keep(homes, "homes")
    examined(homes.filter("rep <> leader"), 0)
    mixed = own.join(homes, "rep").groupBy("bucket").agg(F.min("leader").alias("x"), F.max("leader").alias("y")).filter("x <> y").select("bucket")
    mixed = scratch.keep(mixed.join(tops, "bucket").select("bucket", F.col("top.rep").alias("leader"), "n"), "mixed")
    led = C.join_each(own, mixed, ["bucket"]).filter("rep <> leader").select("rep", "leader").distinct()
    led = scratch.keep(led.join(homes, ["rep", "leader"], "left_anti"), "led")
    if not led.isEmpty():
        again = homes.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).join(led.select("leader").distinct(), "leader")
        again = C.join_each(homes, scratch.keep(again, "again"), ["leader"]).filter("rep <> leader").select("rep", "leader")
        examined(led.union(again), 1)
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    part = components(links, scratch, "all")

    # an id that stands on rows of different sets joins their components
    own = scratch.keep(C.join_each(full.select("id", "row_key", *fingerprint), classes.select(*fingerprint, "rep", "n"), fingerprint).select("id", "row_key", "n_shingles", "rep"), "own")
    twice = own.filter("id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z")
    twice = scratch.keep(twice, "twice")
    if not twice.isEmpty():
        same = C.join_each(own.select("id", F.col("rep").alias("b")), twice, ["id"]).select("a", "b").filter("a <> b")
        part = components(links.union(same), scratch, "ids")
    part = classes.select("rep", "n").join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    part = scratch.keep(part, "part")
    out = C.join_each(own, part, ["rep"])
    first = F.when(F.col("component.none"), F.col("row_key") == F.col("component.key")).otherwise(F.col("id").eqNullSafe(F.col("component.id")))
    out = out.select("id", "row_key", "n_shingles", F.col("component.id").alias("component"), first.alias("kept"))
    return out.unionByName(sketched.filter("n_shingles = 0").select("id", "row_key", "n_shingles", F.col("id").alias("component"), F.lit(True).alias("kept")))


def _xor_bits(a: str, b: str):
    """Population count of the XOR of two bitmaps, 64 bits at a time."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("decimal(20,0)").cast("long")
    total = F.lit(0)
    for i in range(BITS // 64):
        total = total + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    return total


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One document of each group, the smallest id, with all its columns."""
    kept = group(docs, doc_id, text, **more).filter("kept").select("id", "row_key").distinct()
    out = C.marked(docs, kept, doc_id, text)
    return C.named(out.dropDuplicates([C.place(docs, doc_id), "mark_key"]), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(C.table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT l.b, r.reach FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
