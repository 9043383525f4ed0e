"""Digests, sizes and small scalar functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest -> algorithm (fixed values).
ALGORITHMS = {32: "md5", 40: "sha1", 64: "sha256"}


def with_digests(objects: DataFrame, content: str = "content") -> DataFrame:
    """Adds size, md5, sha1, sha256 (lower hex) of a binary column."""
    c = F.col(content)
    return objects.withColumns({"size": F.octet_length(c).cast("long"), "md5": F.md5(c), "sha1": F.sha1(c), "sha256": F.sha2(c, 256)})


def latin(content: Column) -> Column:
    """One character for each byte, so that string functions and regexes are byte-exact."""
    return F.decode(content, "ISO-8859-1")


#: Leading bytes -> target number (fixed values); anything else is 0.
MAGIC = [("4D5A", 1), ("7F454C46", 6), ("25504446", 10), ("CAFEBABE", 9), ("FEEDFACE", 9), ("CEFAEDFE", 9), ("CFFAEDFE", 9)]


def file_kind(content: Column) -> Column:
    """Target number of the object's type by its leading bytes."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.lit(0)
    for magic, target in reversed(MAGIC):
        kind = F.when(F.startswith(head, F.lit(magic)), F.lit(target)).otherwise(kind)
    return F.when(content.isNull(), F.lit(None)).otherwise(kind).cast("int")


def target_ok(need: Column, have: Column) -> Column:
    return (need == 0) | (need == have)


def digest_algorithm(digest: Column) -> Column:
    """md5, sha1, sha256 or unknown, by form."""
    hexes = F.trim(digest)
    found = F.lit("unknown")
    for n, name in ALGORITHMS.items():
        found = F.when(hexes.rlike(f"^[0-9a-fA-F]{{{n}}}$"), F.lit(name)).otherwise(found)
    return found


def digest_error(digest: Column) -> Column:
    """Why a digest can't be looked up, or null. Blank space around it is ignored."""
    d = F.trim(digest)
    half = (F.length(d) / 2).cast("int")
    problem = (
        F.when(~d.rlike("^[0-9a-fA-F]*$"), F.lit("non-hex digest"))
        .when(F.length(d) % 2 == 1, F.lit("decode"))
        .when(~half.isin(16, 20, 32), F.concat(F.lit("unsupported length "), half.cast("string")))
    )
    return F.concat(F.lit("invalid hash: "), problem)


def _fixed(x: Column, digits: int) -> Column:
    """Rounded half up, with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", x)


def format_bytes(n: Column, mib_digits: int = 1) -> Column:
    """`512 B`, `1.5 KiB`, `2.0 MiB`; the report form takes two digits for MiB."""
    n = n.cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(_fixed(n / 1024, 1), F.lit(" KiB")))
        .otherwise(F.concat(_fixed(n / (1024 * 1024), mib_digits), F.lit(" MiB")))
    )


def format_duration_us(us: Column) -> Column:
    us = us.cast("double")
    return (
        F.when(us < 1000, F.concat(us.cast("long").cast("string"), F.lit(" µs")))
        .when(us < 1_000_000, F.concat(_fixed(us / 1000, 2), F.lit(" ms")))
        .otherwise(F.concat(_fixed(us / 1_000_000, 2), F.lit(" s")))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_unix(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("unknown")).otherwise(F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
