"""Signature database containers: header, checks, packing and members.

A container is a 512-byte text header and a gzipped tar of signature files. Reading one is
driver work of one row; `members` reads many containers in parallel, a row each.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import member_kind

HEADER = 512
# Fixed values of the container format.
MAGIC = "ClamAV-VDB"
RADIX64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
MODULUS = 118640995551645342603070001658453189751527774412027743746599405743243142607464144767361060640655844749760788890022283424922762488917565551002467771109669598189410434699034532232228621591089508178591428456220796841621637175567590476666928698770143328137383952820383197532047771780196576957695822641224262693037
EXPONENT = 100001027


class ContainerError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    time: str
    version: int
    signatures: int
    flevel: int
    md5: str
    dsig: str
    builder: str
    stime: int = 0

    def to_bytes(self) -> bytes:
        fields = (MAGIC, self.time, self.version, self.signatures, self.flevel, self.md5, self.dsig, self.builder, self.stime)
        return ":".join(map(str, fields)).encode()[:HEADER].ljust(HEADER, b"\0")


def _number(text: str, bits: int) -> int:
    if not re.fullmatch(r"\+?\d+", text, re.A) or int(text) >= 1 << bits:
        raise ContainerError(f"bad number {text!r}")
    return int(text)


def parse_header_text(text: str) -> Header:
    """The time may hold colons, so fields are counted from the right: with stime, else without."""
    text = text.strip()
    if not text.startswith(MAGIC + ":"):
        raise ContainerError("magic mismatch")
    fields = text[len(MAGIC) + 1 :].rsplit(":", 7)
    if len(fields) < 7:
        raise ContainerError("not enough fields")
    time, version, signatures, flevel, md5, dsig, builder, *stime = fields
    head = Header(time, _number(version, 32), _number(signatures, 32), _number(flevel, 32), md5.lower(), dsig, builder)
    if not re.fullmatch("[0-9a-f]{32}", head.md5):
        raise ContainerError("invalid MD5 field")
    if not dsig or not builder:
        raise ContainerError("empty signature or builder")
    try:
        return replace(head, stime=_number(stime[0], 64)) if stime else head
    except ContainerError:
        return head


def parse_header(data: bytes) -> Header:
    if len(data) < HEADER:
        raise ContainerError("truncated header")
    raw = data[:HEADER].split(b"\0", 1)[0]
    try:
        return parse_header_text(raw.decode())
    except UnicodeDecodeError as e:
        raise ContainerError("header is not valid UTF-8") from e


def header_columns(content) -> dict:
    """The header's fields as native columns of a binary column; null where it can't be read."""
    text = F.trim(F.regexp_extract(F.decode(F.substring(content, 1, HEADER), "ISO-8859-1"), r"(?s)^([^\x00]*)", 1))
    eight = rf"(?s)^{MAGIC}:(.*):([0-9]+):([0-9]+):([0-9]+):([0-9a-fA-F]{{32}}):([^:]+):([^:]+):([^:]*)$"
    seven = rf"(?s)^{MAGIC}:(.*):([0-9]+):([0-9]+):([0-9]+):([0-9a-fA-F]{{32}}):([^:]+):([^:]+)$"
    pick = lambda i: F.when(text.rlike(eight), F.regexp_extract(text, eight, i)).when(text.rlike(seven), F.regexp_extract(text, seven, i))
    stime = F.coalesce(F.regexp_extract(text, eight, 8).try_cast("bigint"), F.lit(0))
    return {
        "time": pick(1), "version": pick(2).try_cast("bigint"), "signatures": pick(3).try_cast("bigint"), "flevel": pick(4).try_cast("bigint"),
        "md5": F.lower(pick(5)), "dsig": pick(6), "builder": pick(7), "stime": F.when(pick(1).isNotNull(), F.when(text.rlike(eight), stime).otherwise(F.lit(0))),
    }


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Header rows of containers; the body stays unread beyond the bytes that binaryFile loads."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", *[c.alias(n) for n, c in header_columns(F.col("content")).items()])


# --- checks ---------------------------------------------------------------------------------


def radix64_decode(text: str) -> int | None:
    """A little-endian radix-64 number."""
    total = 0
    for i, c in enumerate(text):
        if (digit := RADIX64.find(c)) < 0:
            return None
        total |= digit << 6 * i
    return total


def radix64_encode(n: int) -> str:
    out = []
    while True:
        n, digit = divmod(n, 64)
        out.append(RADIX64[digit])
        if not n:
            return "".join(out)


def recover(signature: str, size: int, exponent: int = EXPONENT, modulus: int = MODULUS) -> bytes | None:
    number = radix64_decode(signature)
    if number is None:
        return None
    plain = pow(number, exponent, modulus)
    return plain.to_bytes(size, "big") if plain.bit_length() <= 8 * size else None


def signed_md5(md5: str, signature: str, exponent: int = EXPONENT, modulus: int = MODULUS) -> bool:
    return bool(re.fullmatch("[0-9a-fA-F]{32}", md5)) and recover(signature, 16, exponent, modulus) == bytes.fromhex(md5)


def sign_md5(md5: bytes, private: int, modulus: int) -> str | None:
    return radix64_encode(pow(int.from_bytes(md5, "big"), private, modulus)) if len(md5) == 16 else None


def signed_pss(sha256: bytes, signature: str, exponent: int = EXPONENT, modulus: int = MODULUS) -> bool:
    """A 2048-bit probabilistic signature: SHA-256, a 32-byte salt, trailer 0xbc."""
    block = recover(signature, 256, exponent, modulus)
    if len(sha256) != 32 or block is None or block[-1] != 0xBC:
        return False
    masked, digest = block[:223], block[223:255]
    mask = b"".join(hashlib.sha256(digest + i.to_bytes(4, "big")).digest() for i in range(7))[:223]
    plain = int.from_bytes(masked, "big") ^ int.from_bytes(mask, "big")
    plain = (plain & (1 << 223 * 8 - 1) - 1).to_bytes(223, "big")
    salt = plain[plain.find(b"\x01") + 1 :]
    return b"\x01" in plain and len(salt) == 32 and hashlib.sha256(bytes(8) + sha256 + salt).digest() == digest


def verify(data: bytes, header: Header, mode: str = "official") -> None:
    """mode: none, integrity (checksum of the body) or official (and a signature)."""
    if mode == "none":
        return
    if len(data) < HEADER:
        raise ContainerError("shorter than a header")
    if hashlib.md5(data[HEADER:]).hexdigest() != header.md5:
        raise ContainerError("checksum mismatch")
    if mode == "official" and not signed_md5(header.md5, header.dsig) and not signed_pss(hashlib.sha256(data[HEADER:]).digest(), header.dsig):
        raise ContainerError("signature mismatch")


def checked(containers: DataFrame, content: str = "content") -> DataFrame:
    """Adds the header's fields and intact (the body has the header's checksum), natively."""
    c = F.col(content)
    out = containers.withColumns({f"header_{n}": x for n, x in header_columns(c).items()})
    body = F.expr(f"substring({content}, {HEADER + 1})")
    return out.withColumn("intact", F.coalesce(F.md5(body) == F.col("header_md5"), F.lit(False)))


# --- members --------------------------------------------------------------------------------


def visit(body: bytes, wanted=None) -> Iterator[tuple[str, bytes]]:
    """Members in archive order under their base names; unwanted ones are not read."""
    with tarfile.open(fileobj=gzip.GzipFile(fileobj=io.BytesIO(body)), mode="r|") as tar:
        for member in tar:
            name = member.name.rpartition("/")[2]
            if member.isfile() and name and (wanted is None or wanted(name)):
                yield name, tar.extractfile(member).read()


def unpack(data: bytes) -> dict[str, bytes]:
    """All members by name, in name order; a later one of a name replaces an earlier one."""
    return dict(sorted(dict(visit(data[HEADER:])).items()))


def pack_body(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as zipped, tarfile.open(fileobj=zipped, mode="w|") as tar:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def pack(members: dict[str, bytes], version: int = 1, time: str = "01 Jan 2026 00-00 +0000", builder: str = "builder", signatures: int | None = None, stime: int = 0, flevel: int = 90) -> bytes:
    """An unsigned container of the members, with a right checksum."""
    body = pack_body(members)
    count = sum(c.count(b"\n") for c in members.values()) if signatures is None else signatures
    return Header(time, version, count, flevel, hashlib.md5(body).hexdigest(), "unsigned", builder, stime).to_bytes() + body


def members(containers: DataFrame, unwanted: bool = False, mode: str = "integrity", db: str = "db", content: str = "content") -> DataFrame:
    """db, member, member_pos, content, error from rows of db and content, in archive order.

    A container that can't be read gives one row with its error."""

    def read(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("db").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    verify(data, parse_header(data), mode)
                    found = list(visit(data[HEADER:], lambda m: member_kind(m, unwanted) is not None))
                    rows += [(name, m, i, c, None) for i, (m, c) in enumerate(found)]
                except (ContainerError, OSError, EOFError, tarfile.TarError, TypeError) as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["db", "member", "member_pos", "content", "error"])

    given = containers.select(F.col(db).cast("string").alias("db"), F.col(content).alias("content"))
    return given.mapInArrow(read, "db string, member string, member_pos int, content binary, error string")
