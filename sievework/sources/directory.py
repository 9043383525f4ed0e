"""Signature directories: containers and loose files, in path order, to a SignatureSet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parse import member_kind_column
from ..operators.sigset import SignatureSet
from . import container


def read_members(spark: SparkSession, path: str, unwanted: bool = False, mode: str = "official") -> DataFrame:
    """seq, db, member, content, error of all members under a directory, files by path.

    .cvd files are checked as `mode` says, .cld files for integrity only (unless mode is none)."""
    files = spark.read.format("binaryFile").load(path)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    lower = F.lower("file")
    full = files.filter(F.endswith(lower, F.lit(".cvd")))
    light = files.filter(F.endswith(lower, F.lit(".cld")))
    packed = container.members(full, unwanted, mode, "path").unionByName(container.members(light, unwanted, "none" if mode == "none" else "integrity", "path"))
    loose = files.filter(member_kind_column(F.col("file"), unwanted).isNotNull())
    loose = loose.select(F.col("path").alias("db"), F.col("file").alias("member"), F.lit(0).alias("member_pos"), "content", F.lit(None).cast("string").alias("error"))
    return packed.unionByName(loose)


def load(spark: SparkSession, path: str, unwanted: bool = False, mode: str = "official", version: int = 0) -> SignatureSet:
    """One container that can't be read fails the load. Signature files are few: their order is a single window."""
    members = read_members(spark, path, unwanted, mode).cache()
    bad = members.filter("error is not null").select("db", "error").first()
    if bad:
        raise container.ContainerError(f"{bad.db}: {bad.error}")
    order = F.row_number().over(Window.orderBy("db", "member_pos")).cast("bigint")
    heads = container.read_header(spark, path).filter("md5 is not null").orderBy("path").collect()
    databases = tuple(h.asDict() | {"name": h.path.rpartition("/")[2].rpartition(".")[0]} for h in heads)
    return SignatureSet.from_members(members.select(order.alias("seq"), "member", "content"), unwanted, databases, version)


def load_bytes(spark: SparkSession, data: bytes, unwanted: bool = False, mode: str = "integrity") -> SignatureSet:
    """One container in memory; members in name order."""
    header = container.parse_header(data)
    container.verify(data, header, mode)
    found = container.unpack(data)
    return load_unpacked(spark, found, unwanted, (header.__dict__ | {"name": "container"},), header.version)


def load_unpacked(spark: SparkSession, members: dict[str, bytes], unwanted: bool = False, databases: tuple[dict, ...] = (), version: int = 0) -> SignatureSet:
    rows = [(i, name, bytearray(content)) for i, (name, content) in enumerate(members.items())]
    return SignatureSet.from_members(spark.createDataFrame(rows, "seq bigint, member string, content binary"), unwanted, databases, version)


def load_or_empty(spark: SparkSession, path: str, **options) -> SignatureSet:
    """The startup load: an unreadable directory gives the empty set."""
    try:
        return load(spark, path, **options)
    except Exception as e:  # whatever the store or the container raises
        print(f"signatures not loaded: {e}")
        return SignatureSet.empty(spark)
