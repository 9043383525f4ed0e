"""SignatureSet: an immutable, versioned compilation of signature members."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parse
from .parse import BodyRule, LogicalRule

#: Body and logical rules are shipped to every worker; a shard holds at most so much pattern text.
SHARD_BYTES = 64 << 20
HASHES = "algo string, digest string, size bigint, name string, seq bigint"


@dataclass(frozen=True)
class SignatureSet:
    """Digest tables stay DataFrames; rules are compiled on the driver, as they are few and small."""

    file_hashes: DataFrame
    section_hashes: DataFrame
    allow: DataFrame
    ignored: DataFrame
    body: tuple[BodyRule, ...] = ()
    logical: tuple[LogicalRule, ...] = ()
    skipped: int = 0
    databases: tuple[dict, ...] = ()
    version: int = 0
    loaded_at: int = field(default_factory=lambda: int(time.time()))

    @classmethod
    def empty(cls, spark: SparkSession) -> SignatureSet:
        none = spark.createDataFrame([], HASHES)
        return cls(none, none, spark.createDataFrame([], "algo string, digest string"), spark.createDataFrame([], "name string, is_prefix boolean"))

    @classmethod
    def from_members(cls, members: DataFrame, unwanted: bool = False, databases: tuple[dict, ...] = (), version: int = 0) -> SignatureSet:
        """members: seq, member, content (bytes) in load order. A member that is no UTF-8 is left out.

        Digest lines are parsed in the JVM; only body and logical lines come to the driver."""
        kind = parse.member_kind_column(F.col("member"), unwanted)
        text = F.try_validate_utf8(F.col("content").cast("string"))
        rows = members.select(F.col("seq").cast("bigint").alias("seq"), kind.alias("kind"), text.alias("text")).filter("kind is not null and text is not null")
        lines = parse.lines(rows)

        def hashes(first: str, second: str, size_first: bool) -> DataFrame:
            forced = parse.hash_rows(lines.filter(F.col("kind") == first), size_first, "md5")
            free = parse.hash_rows(lines.filter(F.col("kind") == second), size_first)
            return parse.first_wins(forced.unionByName(free).filter("algo is not null"))

        rules = lines.filter(F.col("kind").isin("ndb", "ldb")).orderBy("seq").select("kind", "line").toLocalIterator()
        found: dict[str, list[str]] = {"ndb": [], "ldb": []}
        for r in rules:
            found[r.kind].append(r.line)
        body, bad_body = parse.rules(found["ndb"], parse.body_rule)
        logical, bad_logical = parse.rules(found["ldb"], parse.logical_rule)
        return cls(
            hashes("hdb", "hsb", False),
            hashes("mdb", "msb", True),
            parse.allow_rows(lines.filter("kind = 'fp'")),
            parse.ignore_rows(lines.filter("kind = 'ign'")),
            tuple(body),
            tuple(logical),
            bad_body + bad_logical,
            databases,
            version,
        )

    def cached(self) -> SignatureSet:
        for t in (self.file_hashes, self.section_hashes, self.allow, self.ignored):
            t.cache()
        return self

    def release(self) -> None:
        for t in (self.file_hashes, self.section_hashes, self.allow, self.ignored):
            t.unpersist()

    def counters(self) -> DataFrame:
        """One row: file_hash, section_hash, body, logical, skipped."""
        both = self.file_hashes.select(F.lit(True).alias("file")).unionByName(self.section_hashes.select(F.lit(False).alias("file")))
        fixed = {"body": len(self.body), "logical": len(self.logical), "skipped": self.skipped}
        return both.agg(F.count_if(F.col("file")).alias("file_hash"), F.count_if(~F.col("file")).alias("section_hash")).withColumns({k: F.lit(n).cast("long") for k, n in fixed.items()})

    def database_info(self, spark: SparkSession) -> DataFrame:
        shape = "pos int, name string, version bigint, header_signatures bigint, flevel bigint, builder string, time string, md5 string"
        keys = ("name", "version", "signatures", "flevel", "builder", "time", "md5")
        return spark.createDataFrame([(i, *(d.get(k) for k in keys)) for i, d in enumerate(self.databases)], shape)

    def readiness(self) -> DataFrame:
        """ready, file_hashes, body_sigs: any digest, body or logical signature, or any database; section digests alone don't count."""
        c = self.counters()
        ready = (F.col("file_hash") + F.col("body") + F.col("logical") > 0) | F.lit(bool(self.databases))
        return c.select(ready.alias("ready"), F.col("file_hash").alias("file_hashes"), F.col("body").alias("body_sigs"))

    def shards(self) -> list[tuple[list[tuple[int, BodyRule]], list[tuple[int, LogicalRule]]]]:
        """Rules in parts of at most SHARD_BYTES of literals, each with its number."""
        out, size = [([], [])], 0
        weight = lambda p: 64 + sum(len(t[1]) for t in p.tokens if t[0] == "lit")
        for which, rules in enumerate((self.body, self.logical)):
            for i, r in enumerate(rules):
                own = weight(r.pattern) if which == 0 else sum(weight(s.pattern) for s in r.subs)
                if size and size + own > SHARD_BYTES:
                    out.append(([], []))
                    size = 0
                out[-1][which].append((i, r))
                size += own
        return out
