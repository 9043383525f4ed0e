"""Scanning: digest joins, section digests, body and logical rules, and the verdict.

Content is read once, in a map: digests and section digests in the JVM and one pass of an
automaton over all anchors in Arrow batches. Everything that follows joins narrow rows of
digests and names, so content is never shuffled or carried through a join. Digest tables are
joined by Spark's own choice, broadcast where they are small and by shuffle beyond that.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pe
from ..functions.digests import MAGIC, digest_error, file_kind, latin, target_ok, with_digests
from . import logic
from .parse import BodyRule, LogicalRule
from .patterns import Pattern
from .sigset import SignatureSet

PRECEDENCE = ("sha256", "sha1", "md5")


# --- digests ----------------------------------------------------------------------------------


def hash_match(objects: DataFrame, signatures: DataFrame) -> DataFrame:
    """Adds hash_name: the first size-compatible hit of sha256, then sha1, then md5.

    objects: size and the three digests (and anything else); signatures: algo, digest, size, name,
    one row for each algo and digest, so that the joins add no rows."""
    out = objects
    for algo in PRECEDENCE:
        own = signatures.filter(F.col("algo") == algo).select(F.col("digest").alias("_digest"), F.col("size").alias("_size"), F.col("name").alias(f"_{algo}"))
        fits = (out[algo] == F.col("_digest")) & (F.col("_size").isNull() | (F.col("_size") == out["size"]))
        out = out.join(own, fits, "left").drop("_digest", "_size")
    return out.withColumn("hash_name", F.coalesce(*[F.col(f"_{a}") for a in PRECEDENCE])).drop(*[f"_{a}" for a in PRECEDENCE])


def allow_match(objects: DataFrame, allow: DataFrame) -> DataFrame:
    """Adds allowed: any of the three digests is on the list."""
    out = objects
    for algo in PRECEDENCE:
        own = allow.filter(F.col("algo") == algo).select(F.col("digest").alias("_digest"), F.lit(True).alias(f"_{algo}")).distinct()
        out = out.join(own, out[algo] == F.col("_digest"), "left").drop("_digest")
    return out.withColumn("allowed", F.coalesce(*[F.col(f"_{a}") for a in PRECEDENCE], F.lit(False))).drop(*[f"_{a}" for a in PRECEDENCE])


def ignore_flag(rows: DataFrame, ignored: DataFrame, name: str, flag: str = "ignored") -> DataFrame:
    """Adds a flag: the name is ignored, exactly or by a prefix.

    Prefix rules join by equality too: a name has a candidate for each length that prefixes have."""
    exact = ignored.filter("not is_prefix").select(F.col("name").alias("_exact")).distinct()
    prefixes = ignored.filter("is_prefix").select("name").distinct()
    lengths = sorted(r[0] for r in prefixes.select(F.length("name")).distinct().collect())
    out = rows.join(exact, rows[name] == F.col("_exact"), "left")
    hit = F.col("_exact").isNotNull()
    drop = ["_exact"]
    for n in lengths:
        own = prefixes.filter(F.length("name") == n).select(F.col("name").alias(f"_prefix{n}"))
        out = out.join(own, F.substring(out[name], 1, n) == F.col(f"_prefix{n}"), "left")
        hit |= F.col(f"_prefix{n}").isNotNull()
        drop.append(f"_prefix{n}")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(*drop)


def digest_lookup(requests: DataFrame, sigs: SignatureSet) -> DataFrame:
    """result, signature and error of rows of digest, size and problem.

    Without a size every signature of the digest counts. Ignored names read clean; the allow-list
    does not apply. A problem of the request itself goes before those of the digest."""
    error = F.coalesce("problem", digest_error(F.col("digest")))
    clean = F.lower(F.trim("digest"))
    algo = F.when(F.length(clean) == 32, "md5").when(F.length(clean) == 40, "sha1").when(F.length(clean) == 64, "sha256")
    rows = requests.withColumns({"error": error, "_clean": clean, "_algo": algo})
    own = sigs.file_hashes.select(F.col("algo").alias("_a"), F.col("digest").alias("_d"), F.col("size").alias("_s"), F.col("name").alias("_name"))
    fits = (F.col("_algo") == F.col("_a")) & (F.col("_clean") == F.col("_d")) & (rows["size"].isNull() | F.col("_s").isNull() | (F.col("_s") == rows["size"])) & rows["error"].isNull()
    out = ignore_flag(rows.join(own, fits, "left"), sigs.ignored, "_name", "_ignored")
    name = F.when(~F.col("_ignored"), F.col("_name"))
    result = F.when(F.col("error").isNull(), F.when(name.isNotNull(), "infected").otherwise("clean"))
    return out.withColumns({"result": result, "signature": F.when(F.col("error").isNull(), name)}).drop("_clean", "_algo", "_a", "_d", "_s", "_name", "_ignored")


def hash_request(requests: DataFrame, sigs: SignatureSet) -> DataFrame:
    """Single lookups: rows of hash, sha256, sha1, md5, size (any null) to result, signature, size and the echoed digest."""
    given = F.coalesce("hash", "sha256", "sha1", "md5")
    rows = requests.withColumn("digest", given).withColumn("problem", F.when(given.isNull(), F.lit("invalid hash: missing hash field")))
    out = digest_lookup(rows, sigs)
    n = F.length("digest")
    echo = {"md5": n == 32, "sha1": n == 40, "sha256": ~n.isin(32, 40)}
    return out.withColumns({"size": F.coalesce("size", F.lit(0).cast("bigint"))} | {k: F.when(c, F.col("digest")).otherwise(F.lit("")) for k, c in echo.items()}).drop("hash", "problem")


def tallies(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "infected").alias("infected"), F.count_if(F.col("error").isNotNull()).alias("errors"))


# --- sections ---------------------------------------------------------------------------------


def sections(objects: DataFrame, object_id: str = "object_id") -> DataFrame:
    """object_id, idx, size, md5, sha256 of every non-empty section; only objects with MZ are read."""
    files = objects.filter(F.hex(F.substring("content", 1, 2)) == "4D5A").select(object_id, pe.pe_info(F.col("content")).alias("pe"))
    out = files.select(object_id, F.posexplode("pe.sections").alias("idx", "s"))
    return out.filter("s.size > 0").select(object_id, "idx", "s.size", "s.md5", "s.sha256")


def section_match(section_rows: DataFrame, signatures: DataFrame, object_id: str = "object_id") -> DataFrame:
    """object_id, section_name: the first hit by section, md5 before sha256."""
    digests = section_rows.select(object_id, "idx", "size", F.explode(F.array(F.struct(F.lit("md5").alias("algo"), F.lit(0).alias("rank"), F.col("md5").alias("digest")), F.struct(F.lit("sha256").alias("algo"), F.lit(1).alias("rank"), F.col("sha256").alias("digest")))).alias("d"))
    digests = digests.select(object_id, "idx", F.col("size").alias("_size"), "d.*")
    hits = digests.join(signatures, ["algo", "digest"]).filter("size is null or size = _size")
    return hits.groupBy(object_id).agg(F.min_by("name", F.struct("idx", "rank")).alias("section_name"))


# --- body and logical rules ---------------------------------------------------------------------


class Matcher:
    """All rules of a shard, found by one automaton over their anchors."""

    def __init__(self, body: list[tuple[int, BodyRule]], logical: list[tuple[int, LogicalRule]], ignored: frozenset[str], prefixes: tuple[str, ...]):
        skip = lambda name: name in ignored or name.startswith(prefixes)
        self.body = [(i, r) for i, r in body if not skip(r.name)]
        self.logical = {i: r for i, r in logical if not skip(r.name)}
        self.by_anchor: dict[bytes, list[tuple]] = {}
        self.slow: list[tuple] = []
        for i, r in self.body:
            self._add(("body", i, r, r.offset, r.pattern))
        for i, r in self.logical.items():
            for k, s in enumerate(r.subs):
                self._add(("sub", (i, k), r, s.offset, s.pattern))
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
        else:
            self.automaton = ahocorasick.Automaton()
            for anchor in self.by_anchor:
                self.automaton.add_word(anchor.decode("latin-1"), anchor)
            if self.by_anchor:
                self.automaton.make_automaton()

    def _add(self, entry):
        anchor = entry[4].anchor
        self.by_anchor.setdefault(anchor, []).append(entry) if len(anchor) > 1 else self.slow.append(entry)

    def anchors(self, data: bytes):
        """(place, anchor) of all overlapping occurrences, by end, the longer first."""
        if not self.by_anchor:
            return
        if self.automaton is not None:
            for end, anchor in self.automaton.iter(data.decode("latin-1")):
                yield end + 1 - len(anchor), anchor
            return
        found = []
        for anchor in self.by_anchor:
            at = data.find(anchor)
            while at >= 0:
                found.append((at + len(anchor), -len(anchor), at, anchor))
                at = data.find(anchor, at + 1)
        for _, _, at, anchor in sorted(found):
            yield at, anchor

    def hits(self, data: bytes, first_only: bool = True):
        """Body hits as (order, rule number, name) and hit counts of sub-signatures.

        order: (0, end, -anchor length, rule) for anchored rules, (1, 0, 0, rule) for the others.
        With first_only the search ends at the first body hit, as nothing after it matters."""
        kind = next((t for magic, t in MAGIC if data.startswith(bytes.fromhex(magic))), 0)
        image, size = pe.parse(data) if kind == 1 else None, len(data)
        body: dict[int, tuple] = {}
        counts: dict[tuple[int, int], int] = {}
        for at, anchor in self.anchors(data):
            for what, key, rule, offset, pattern in self.by_anchor[anchor]:
                if rule.target not in (0, kind) or what == "body" and key in body:
                    continue
                if what == "sub" and rule.file_size and not rule.file_size[0] <= size <= rule.file_size[1]:
                    continue
                start = 0 if pattern.anchor_off is None else max(at - pattern.anchor_off, 0)
                if not offset.allows(start, size, image) or not pattern.matches_at(data, start):
                    continue
                if what == "sub":
                    counts[key] = counts.get(key, 0) + 1
                    continue
                body[key] = ((0, at + len(anchor), -len(anchor), key), key, rule.name)
                if first_only:
                    return list(body.values()), counts
        for what, key, rule, offset, pattern in self.slow:
            if rule.target not in (0, kind) or pattern.find_within(data, offset, image) is None:
                continue
            if what == "sub":
                counts[key] = counts.get(key, 0) + 1
            else:
                body[key] = ((1, 0, 0, key), key, rule.name)
        return list(body.values()), counts

    def logical_hits(self, data_size: int, counts: dict[tuple[int, int], int]) -> list[tuple[int, str]]:
        """Number and name of the logical rules that hold; only rules with a hit are looked at."""
        out = []
        for i in sorted({i for i, _ in counts}):
            rule = self.logical[i]
            if rule.file_size and not rule.file_size[0] <= data_size <= rule.file_size[1]:
                continue
            if logic.evaluate(rule.expression, [counts.get((i, k), 0) for k in range(len(rule.subs))]):
                out.append((i, rule.name))
        return out


_matchers: dict[int, Matcher] = {}


def _matcher(shipped) -> Matcher:
    """One compiled matcher for each worker and broadcast; an older one goes."""
    if shipped.value[0] not in _matchers:
        _matchers.clear()
        _matchers[shipped.value[0]] = Matcher(*shipped.value[1:])
    return _matchers[shipped.value[0]]


def _ship(objects: DataFrame, sigs: SignatureSet):
    spark = objects.sparkSession
    names = sigs.ignored.collect()
    exact, prefixes = frozenset(r.name for r in names if not r.is_prefix), tuple(r.name for r in names if r.is_prefix)
    import uuid

    return [spark.sparkContext.broadcast((uuid.uuid4().int, body, logical, exact, prefixes)) for body, logical in sigs.shards()]


def _cut(batch, rows, kinds, names, keep):
    columns = [batch.column(c) for c in keep]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*keep, *names])


def body_scan(objects: DataFrame, sigs: SignatureSet, *keep: str) -> DataFrame:
    """keep columns, body_name, logical_name: the first body rule and, without one, the lowest logical rule.

    A map over objects for each shard of rules; more than one shard meet by a minimum."""
    shape = "".join(f"`{c}` {objects.schema[c].dataType.simpleString()}, " for c in keep)
    found = None
    shards = _ship(objects, sigs)
    for shipped in shards:

        def run(batches, shipped=shipped):
            m = _matcher(shipped)
            for batch in batches:
                rows = []
                for data in batch.column("content"):
                    data = data.as_py()
                    body, counts = m.hits(data) if data is not None else ([], {})
                    first = min(body, default=None)
                    logical = None if first or not counts else min(m.logical_hits(len(data), counts), default=None)
                    order = list(first[0]) if first else [2, 0, 0, logical[0]] if logical else None
                    rows.append((order, first and first[2], logical and logical[1]))
                yield _cut(batch, rows, (pa.list_(pa.int64()), pa.string(), pa.string()), ("_order", "body_name", "logical_name"), keep)

        part = objects.select(*keep, "content").mapInArrow(run, shape + "_order array<bigint>, body_name string, logical_name string")
        found = part if found is None else found.unionByName(part)
    if len(shards) > 1:
        best = F.min_by(F.struct("body_name", "logical_name"), F.struct(F.col("_order").isNull(), "_order"))
        # equal rows have equal results: each shard saw every one of them
        found = found.groupBy(*keep).agg(best.alias("b"), (F.count(F.lit(1)) / len(shards)).cast("int").alias("_times"))
        found = found.withColumn("b", F.explode(F.array_repeat("b", F.col("_times")))).select(*keep, "b.*")
    return found.drop("_order")


def body_hits(objects: DataFrame, sigs: SignatureSet, *keep: str) -> DataFrame:
    """keep columns, rule, name: every body rule that is found in an object, once."""
    shape = "".join(f"`{c}` {objects.schema[c].dataType.simpleString()}, " for c in keep)
    found = None
    for shipped in _ship(objects, sigs):

        def run(batches, shipped=shipped):
            m = _matcher(shipped)
            for batch in batches:
                rows = [[{"rule": k, "name": n} for _, k, n in m.hits(x.as_py(), False)[0]] if x.is_valid else [] for x in batch.column("content")]
                kind = pa.list_(pa.struct([("rule", pa.int32()), ("name", pa.string())]))
                yield _cut(batch, [(r,) for r in rows], (kind,), ("hits",), keep)

        part = objects.select(*keep, "content").mapInArrow(run, shape + "hits array<struct<rule:int,name:string>>")
        part = part.select(*keep, F.explode("hits").alias("h")).select(*keep, "h.*")
        found = part if found is None else found.unionByName(part)
    return found


def sub_counts(objects: DataFrame, sigs: SignatureSet, *keep: str) -> DataFrame:
    """keep columns, rule, name, hits array<int> (of each sub-signature), holds; for rules with a hit."""
    shape = "".join(f"`{c}` {objects.schema[c].dataType.simpleString()}, " for c in keep)
    found = None
    for shipped in _ship(objects, sigs):

        def run(batches, shipped=shipped):
            m = _matcher(shipped)
            for batch in batches:
                rows = []
                for x in batch.column("content"):
                    data = x.as_py()
                    _, counts = m.hits(data, False) if data is not None else ([], {})
                    own = {i for i, _ in m.logical_hits(len(data or b""), counts)}
                    rows.append(([{"rule": i, "name": m.logical[i].name, "hits": [counts.get((i, k), 0) for k in range(len(m.logical[i].subs))], "holds": i in own} for i in sorted({i for i, _ in counts})],))
                kind = pa.list_(pa.struct([("rule", pa.int32()), ("name", pa.string()), ("hits", pa.list_(pa.int32())), ("holds", pa.bool_())]))
                yield _cut(batch, rows, (kind,), ("r",), keep)

        part = objects.select(*keep, "content").mapInArrow(run, shape + "r array<struct<rule:int,name:string,hits:array<int>,holds:boolean>>")
        part = part.select(*keep, F.explode("r").alias("r")).select(*keep, "r.*")
        found = part if found is None else found.unionByName(part)
    return found


def matches(content: Column, pattern: Pattern, target: int = 0, offset=None) -> Column:
    """Natively, whether one rule with an anchor of two bytes or more is found; for a handful of rules."""
    regex = pattern.java(offset) if offset is not None else pattern.java()
    found = F.contains(content, F.lit(pattern.anchor)) & latin(content).rlike(regex) & (F.octet_length(content) >= pattern.min_len)
    return found & target_ok(F.lit(target), file_kind(content)) if target else found


def hit_count(content: Column, pattern: Pattern) -> Column:
    """Natively, the hit count of a sub-signature without an offset."""
    starts, zero, clamped = pattern.java_count()
    text = latin(content)
    head = F.when(text.rlike(zero), F.regexp_count(text, F.lit(clamped))).otherwise(0)
    return F.when(F.contains(content, F.lit(pattern.anchor)), F.regexp_count(text, F.lit(starts)) + head).otherwise(0).cast("int")


# --- the verdict ------------------------------------------------------------------------------


def verdict(objects: DataFrame, sigs: SignatureSet, *keep: str, sections_too: bool = True) -> DataFrame:
    """object_id, keep columns, result, signature, stage, size, md5, sha1, sha256, error.

    Stages: file digest (not ignored, not allowed), then allow-list, sections, body, logical. An
    ignored digest name does not fall back to another digest; an ignored first section hit hides
    later ones. Rows of objects() with an error get no result."""
    given = objects if "error" in objects.columns else objects.withColumn("error", F.lit(None).cast("string"))
    own = ["object_id", *keep, "error"]
    rows = with_digests(given.select(*own, "content"))
    rows = body_scan(rows, sigs, *own, "size", "md5", "sha1", "sha256") if sigs.body or sigs.logical else rows.drop("content").withColumns({"body_name": F.lit(None).cast("string"), "logical_name": F.lit(None).cast("string")})
    rows = ignore_flag(allow_match(hash_match(rows, sigs.file_hashes), sigs.allow), sigs.ignored, "hash_name", "hash_ignored")
    if sections_too and not sigs.section_hashes.isEmpty():
        first = section_match(sections(given), sigs.section_hashes)
        first = ignore_flag(first, sigs.ignored, "section_name").filter("not ignored").drop("ignored")
        rows = rows.join(first, "object_id", "left")
    else:
        rows = rows.withColumn("section_name", F.lit(None).cast("string"))
    stage = (
        F.when(F.col("hash_name").isNotNull() & ~F.col("hash_ignored") & ~F.col("allowed"), "hash")
        .when(F.col("allowed"), "allowed")
        .when(F.col("section_name").isNotNull(), "section")
        .when(F.col("body_name").isNotNull(), "body")
        .when(F.col("logical_name").isNotNull(), "logical")
        .otherwise("none")
    )
    rows = rows.withColumn("stage", F.when(F.col("error").isNull(), stage))
    name = F.when(F.col("stage") == "hash", F.col("hash_name")).when(F.col("stage") == "section", F.col("section_name")).when(F.col("stage") == "body", F.col("body_name")).when(F.col("stage") == "logical", F.col("logical_name"))
    result = F.when(F.col("error").isNull(), F.when(name.isNotNull(), "infected").otherwise("clean"))
    return rows.withColumns({"signature": name, "result": result}).select("object_id", *keep, "result", "signature", "stage", "size", "md5", "sha1", "sha256", "error")


def as_json(results: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row; null fields are left out."""
    keep = [c for c in results.columns if c not in columns]
    return results.select(*keep, F.to_json(F.struct(*columns)).alias("json"))
