"""Signature lines to typed rows: digests, allow-lists and ignored names as native columns;
body and logical rules by a small parser on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logic
from .patterns import Offset, Pattern, PatternError, _u32, parse_offset

#: Member extensions (fixed values): those always read, and those of possibly unwanted applications.
SIGNATURES = ("hdb", "hsb", "mdb", "msb", "ndb", "ldb", "fp", "sfp", "ign", "ign2")
UNWANTED = ("hdu", "hsu", "mdu", "msu", "ndu", "ldu")
#: Target numbers that are known (fixed values); any other reads 255.
TARGETS = (0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12)
_KIND = {"hdu": "hdb", "hsu": "hsb", "mdu": "mdb", "msu": "msb", "ndu": "ndb", "ldu": "ldb", "sfp": "fp", "ign2": "ign"}
U32 = 0xFFFFFFFF


def member_kind(name: str, unwanted: bool = False) -> str | None:
    """hdb, hsb, mdb, msb, ndb, ldb, fp or ign; None if the member is not read."""
    ext = name.lower().rpartition(".")[2] if "." in name else ""
    if ext in SIGNATURES or unwanted and ext in UNWANTED:
        return _KIND.get(ext, ext)
    return None


def member_kind_column(name: Column, unwanted: bool = False) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    known = {e: _KIND.get(e, e) for e in SIGNATURES + (UNWANTED if unwanted else ())}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), ext)


def target_column(n: Column) -> Column:
    return F.when(n.isin(*TARGETS), n).otherwise(F.lit(255)).cast("int")


def strip(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def lines(members: DataFrame) -> DataFrame:
    """seq, kind, line from rows of seq, kind, text: trimmed lines without blanks and # lines.

    seq orders members and, below them, lines."""
    out = members.select("seq", "kind", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    out = out.select((F.col("seq") * F.lit(1 << 32) + F.col("n")).alias("seq"), "kind", strip(F.col("line")).alias("line"))
    return out.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))


def hash_rows(line_rows: DataFrame, size_first: bool = False, force: str | None = None, line: str = "line") -> DataFrame:
    """Adds algo, digest, size (null for *), name; algo is null where the line is invalid.

    force: an algorithm whose length the digest must have; else the length decides."""
    part = F.split(F.col(line), ":")
    at = lambda i: F.get(part, F.lit(i))
    digest, size, name = at(1 if size_first else 0), at(0 if size_first else 1), at(2)
    algo = F.when(F.length(digest) == 32, "md5").when(F.length(digest) == 40, "sha1").when(F.length(digest) == 64, "sha256")
    number = F.when(size.rlike(r"^\+?[0-9]{1,18}$"), size.try_cast("bigint")).otherwise(F.when(size.rlike(r"^\+?0*[0-9]{1,10}$"), F.regexp_replace(size, r"^\+?0*", "0").try_cast("bigint")))
    ok = digest.rlike("^[0-9a-fA-F]+$") & (name != "") & ((size == "*") | (number <= U32))
    if force:
        ok &= algo == force
    valid = F.coalesce(ok & algo.isNotNull(), F.lit(False))
    return line_rows.withColumns(
        {
            "algo": F.when(valid, algo),
            "digest": F.when(valid, F.lower(digest)),
            "size": F.when(valid & (size != "*"), number),
            "name": F.when(valid, name),
        }
    )


def first_wins(rows: DataFrame) -> DataFrame:
    """One row for each algo and digest, the first by seq, whatever the sizes: a partial aggregation."""
    first = F.min_by(F.struct("size", "name", "seq"), F.col("seq")).alias("r")
    return rows.groupBy("algo", "digest").agg(first).select("algo", "digest", "r.size", "r.name", "r.seq")


def allow_rows(line_rows: DataFrame, line: str = "line") -> DataFrame:
    """Distinct algo and digest; sizes must be readable but do not matter."""
    return hash_rows(line_rows, line=line).filter("algo is not null").select("algo", "digest").distinct()


def ignore_rows(line_rows: DataFrame, line: str = "line") -> DataFrame:
    """name and is_prefix: `prefix:*` ignores all names that start so."""
    prefix = F.endswith(line, F.lit(":*"))
    return line_rows.select(F.when(prefix, F.expr(f"substring({line}, 1, length({line}) - 2)")).otherwise(F.col(line)).alias("name"), prefix.alias("is_prefix")).distinct()


@dataclass(frozen=True)
class BodyRule:
    name: str
    target: int
    offset: Offset
    pattern: Pattern


@dataclass(frozen=True)
class SubSignature:
    offset: Offset
    pattern: Pattern


@dataclass(frozen=True)
class LogicalRule:
    name: str
    target: int
    file_size: tuple[int, int] | None
    expression: tuple
    subs: tuple[SubSignature, ...]


def _target(text: str) -> int:
    n = _u32(text)
    if n > 255:
        raise PatternError(f"target {text!r}")
    return n if n in TARGETS else 255


def strip_levels(text: str) -> str:
    """Without one or two trailing fields of digits."""
    for _ in range(2):
        head, colon, tail = text.rpartition(":")
        if not (colon and tail.isascii() and tail.isdigit()):
            break
        text = head
    return text


def body_rule(line: str) -> BodyRule:
    """name:target:offset:hex[:min[:max]]"""
    fields = line.strip().split(":", 3)
    if len(fields) < 4:
        raise PatternError("missing field")
    name, target, offset, rest = fields
    return BodyRule(name, _target(target), parse_offset(offset), Pattern.parse(strip_levels(rest)))


def _sub(text: str) -> SubSignature:
    body, marks, modifiers = text.rpartition("::")
    if not marks:
        body, modifiers = text, ""
    offset, hexes = Offset(), body
    head, colon, tail = body.partition(":")
    if colon and tail:
        try:
            offset, hexes = parse_offset(head), tail
        except PatternError:
            pass
    return SubSignature(offset, Pattern.parse(hexes, wide="w" in modifiers))


def logical_rule(line: str) -> LogicalRule:
    """name;Target:n,FileSize:a-b;expression;sub;sub...; empty subs are skipped and shift the rest."""
    fields = line.strip().rstrip(";").split(";", 3)
    if len(fields) < 3 or not fields[0]:
        raise PatternError("missing field")
    target, file_size = 0, None
    for part in fields[1].split(","):
        if not (part := part.strip()):
            continue
        key, colon, value = part.partition(":")
        if not colon:
            raise PatternError(f"block {part!r}")
        if key == "Target":
            target = _target(value)
        elif key == "FileSize" and "-" in value:
            low, _, high = value.partition("-")
            file_size = _u32(low), _u32(high)
    try:
        tree = logic.parse(fields[2])
    except logic.ExpressionError as e:
        raise PatternError(str(e)) from e
    subs = tuple(_sub(x) for x in (fields[3].split(";") if len(fields) > 3 else []) if x)
    return LogicalRule(fields[0], target, file_size, tree, subs)


def rules(text_lines, parse) -> tuple[list, int]:
    """Rules of the lines that parse, and how many others there were; blanks and # lines don't count."""
    out, skipped = [], 0
    for line in text_lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        try:
            out.append(parse(line))
        except PatternError:
            skipped += 1
    return out, skipped
