"""More queries over the supplied tables: slow rules, anchors, offsets in executables, sections, containers, list lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parse, scan
from ..operators.sigset import SignatureSet
from ..sources import container, objects
from . import catalogue as c
from .catalogue import hexed, query, table

_HEX = "(SELECT doc_id, hex(encode(text)) AS h FROM documents)"


def _hits(rules: list[tuple[str, str, str]]):
    """Hits of body rules (name, pattern, regex over upper-case hex from the start) in documents, and their SQL."""
    sql = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name FROM {_HEX} WHERE regexp_matches(h, '{regex}')" for name, _, regex in rules)

    def run(spark, sf_dir):
        sigs = c.rule_set(spark, [parse.body_rule(f"{name}:0:*:{pattern}") for name, pattern, _ in rules])
        return scan.body_hits(c.documents(spark, sf_dir), sigs, "doc_id").select("doc_id", "name")

    return sql, run


#: Anchors of one byte, or none: the slow search.
SLOW = [
    ("Slow.comma", "7?2c??6?", "^(?:..)*7.2C..6."),
    ("Slow.none", "7?7?7?7?7?", "^(?:..)*7.7.7.7.7."),
    ("Slow.space", "!(65|73)20", "^(?:..)*(?:[^67].|6[^5]|7[^3])20"),
]
_sql, _run = _hits(SLOW)


@query(_sql)
def slow_rules(spark, sf_dir):
    return _run(spark, sf_dir)


#: Anchors that don't stand first; behind a skip of variable length a rule only fits at the first byte.
ANCHORS = [
    ("Anchor.second", "??20746865", "^(?:..)*..20746865"),
    ("Anchor.behind", "6e64{2}20746865", "^(?:..)*6E64(?:..){2}20746865"),
    ("Anchor.choice", "(61|65)6e20746861", "^(?:..)*(?:61|65)6E20746861"),
    ("Anchor.pinned", "54{-30}2074686174", "^54(?:..){0,30}2074686174"),
]
_sql_anchors, _run_anchors = _hits(ANCHORS)


@query(_sql_anchors)
def body_anchors(spark, sf_dir):
    return _run_anchors(spark, sf_dir)


@query("SELECT doc_id, 'Log.wide' AS name FROM documents WHERE contains(text, 'tion') AND NOT contains(text, 'anan')")
def wide_modifier(spark, sf_dir):
    """Sub-signatures of two-byte characters, over documents in that encoding."""
    rule = parse.logical_rule(f"Log.wide;Target:0;0>0&1=0;{hexed('tion')}::w;{hexed('anan')}::w")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-16LE").alias("content"))
    return scan.sub_counts(docs, c.rule_set(spark, logical=[rule]), "doc_id").filter("holds").select("doc_id", "name")


@query("SELECT doc_id, 'Log.mixed' AS name FROM documents WHERE contains(text, 'tion') AND NOT contains(text, 'sttion')")
def logical_candidates(spark, sf_dir):
    """A rule that holds without a hit has no row; only rules with a hit are looked at."""
    rules = [parse.logical_rule(f"Log.none;Target:0;0=0;{hexed('zzqqzz')}"), parse.logical_rule(f"Log.mixed;Target:0;0=0&1>0;{hexed('sttion')};{hexed('tion')}")]
    return scan.sub_counts(c.documents(spark, sf_dir), c.rule_set(spark, logical=rules), "doc_id").filter("holds").select("doc_id", "name")


@query(
    f"""SELECT doc_id, 'Pe.entry' AS name FROM {_HEX} WHERE starts_with(h, '54686520') UNION ALL SELECT doc_id, 'Pe.first' FROM {_HEX} WHERE regexp_matches(h, '^(?:..){{4,8}}6E6420')
UNION ALL SELECT doc_id, 'Pe.last' FROM {_HEX} WHERE regexp_matches(h, '^(?:..){{0,40}}74696F6E') UNION ALL SELECT doc_id, 'Pe.section' FROM {_HEX} WHERE starts_with(h, '5468')"""
)
def executable_offsets(spark, sf_dir):
    """Offsets from the entry point, a section and the last section; documents as the section of an executable."""
    lines = [f"Pe.entry:1:EP+0:{hexed('The ')}", f"Pe.first:1:S0+4,4:{hexed('nd ')}", f"Pe.last:1:SL+0,40:{hexed('tion')}", f"Pe.section:1:SE0:{hexed('Th')}", f"Pe.none:1:S1+0:{hexed('The ')}", f"Pe.elf:6:*:{hexed('The ')}"]
    files = c.documents(spark, sf_dir).withColumn("content", c.image_of(F.col("content")))
    return scan.body_hits(files, c.rule_set(spark, [parse.body_rule(x) for x in lines]), "doc_id").select("doc_id", "name")


@query(
    """WITH s AS (SELECT md5(text) AS md5, 'Sec.' || min(doc_id) AS name FROM documents SEMI JOIN labels l ON l.doc_id = documents.doc_id AND toxic = 1 WHERE text <> '' GROUP BY 1)
SELECT doc_id, CASE WHEN s.name IS NOT NULL THEN 'infected' ELSE 'clean' END AS result, s.name AS signature, CASE WHEN s.name IS NOT NULL THEN 'section' ELSE 'none' END AS stage, CAST(512 + strlen(text) AS BIGINT) AS size
FROM documents d LEFT JOIN s ON s.md5 = md5(d.text)"""
)
def verdict_sections(spark, sf_dir):
    """The whole verdict where only digests of sections decide."""
    docs = c.documents(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    own = docs.join(toxic, "doc_id").filter(F.octet_length("content") > 0).groupBy(F.md5("content").alias("digest")).agg(F.min("doc_id").alias("seq"), F.first(F.octet_length("content").cast("long")).alias("size"))
    own = own.select(F.lit("md5").alias("algo"), "digest", "size", F.concat(F.lit("Sec."), F.col("seq").cast("string")).alias("name"), "seq")
    none = SignatureSet.empty(spark)
    sigs = SignatureSet(none.file_hashes, own, none.allow, none.ignored)
    files = docs.withColumn("content", c.image_of(F.col("content")))
    return scan.verdict(files, sigs, "doc_id").select("doc_id", "result", "signature", "stage", "size")


@query("SELECT DISTINCT 'md5' AS algo, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0 UNION SELECT 'sha1', sha1(text) FROM documents WHERE doc_id % 7 = 1")
def allow_lines(spark, sf_dir):
    """Lines of an allow-list; one without a readable size or digest is left out."""
    rows = c.digested(spark, sf_dir)
    md5 = rows.select(F.concat_ws(":", "md5", F.when(F.col("doc_id") % 7 == 0, F.lit("many")).otherwise(F.col("size").cast("string")), F.lit("Ok")).alias("line"))
    sha1 = rows.filter("doc_id % 7 = 1").select(F.concat_ws(":", "sha1", F.lit("*"), F.lit("Ok")).alias("line"))
    return parse.allow_rows(md5.unionByName(sha1))


@query("SELECT DISTINCT source || '.' || lang AS name, doc_id % 3 = 0 AS is_prefix FROM documents")
def ignore_lines(spark, sf_dir):
    """Lines of an ignore-list: names, and prefixes with a star."""
    name = F.concat_ws(".", "source", "lang")
    rows = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    return parse.ignore_rows(rows.select(F.when(F.col("doc_id") % 3 == 0, F.concat(name, F.lit(":*"))).otherwise(name).alias("line")))


#: Line, and what it reads as: name, target, kind and numbers of the offset, least length, anchor; nulls where it is skipped.
RULE_LINES = [
    ("Plain:0:*:41424344", ("Plain", 0, "any", 0, 0, 4, "41424344")),
    ("Levels:1:EP+4,8:4142??43444546:60:90", ("Levels", 1, "ep", 4, 8, 7, "43444546")),
    ("Level:6:EOF-20:414243:90", ("Level", 6, "eof", 20, 0, 3, "414243")),
    ("Far:77:S3+16,2:4142{2-4}43", ("Far", 255, "section", 16, 2, 5, "4142")),
    ("Last:9:SL+1:(41|42)4344", ("Last", 9, "last", 1, 0, 3, "4344")),
    ("Start:10:100,20:4142*4344", ("Start", 10, "absolute", 100, 20, 4, "4142")),
    ("Whole:0:SE2:4142", ("Whole", 0, "section", 0, 0, 2, "4142")),
    ("Short:0:*", None),
    ("Target:x:*:4142", None),
    ("Odd:0:*:414", None),
    ("Offset:0:EQ+1:4142", None),
]


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, " + ("NULL, CAST(NULL AS INTEGER), NULL, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), NULL)" if r is None else f"'{r[0]}', {r[1]}, '{r[2]}', CAST({r[3]} AS BIGINT), CAST({r[4]} AS BIGINT), {r[5]}, '{r[6]}')") for i, (_, r) in enumerate(RULE_LINES))
    + ") t(line_no, name, target, offset_kind, offset_add, offset_shift, least, anchor)"
)
def rule_lines(spark, sf_dir):
    """Lines of body rules as they are read: levels stripped, targets mapped, offsets, anchors; bad lines are skipped."""
    rows = []
    for i, (line, _) in enumerate(RULE_LINES):
        found, _skipped = parse.rules([line], parse.body_rule)
        r = found[0] if found else None
        rows.append((i, *((r.name, r.target, r.offset.kind, r.offset.add, r.offset.shift, r.pattern.min_len, r.pattern.anchor.hex()) if r else (None,) * 7)))
    return spark.createDataFrame(rows, "line_no int, name string, target int, offset_kind string, offset_add long, offset_shift long, least int, anchor string")


@query("SELECT CAST(doc_id AS VARCHAR) AS object_id, CASE WHEN strlen(text) <= 5000 THEN 'clean' END AS result, CASE WHEN strlen(text) > 5000 THEN 'payload too large: exceeds 5000 bytes' END AS error FROM documents")
def size_limit(spark, sf_dir):
    """Objects beyond a limit get an error instead of a result."""
    return scan.verdict(objects.limited(c.documents(spark, sf_dir), 5000), SignatureSet.empty(spark)).select("object_id", "result", "error")


# --- containers ----------------------------------------------------------------------------------

_LDB = "\n".join(c.LOGICAL).replace("'", "''") + "\n"
_FILES = f"""f AS (SELECT 0 AS member_pos, 'daily.hdb' AS member, string_agg(md5(text) || ':' || strlen(text) || ':Item.' || item_id || chr(10), '' ORDER BY item_id) AS content FROM benchmark WHERE text <> ''
UNION ALL SELECT 1, 'daily.ndb', string_agg('Bench.' || item_id || ':0:*:' || lower(hex(encode(text))) || chr(10), '' ORDER BY item_id) FROM benchmark WHERE text <> ''
UNION ALL SELECT 2, 'daily.ldb', '{_LDB}' UNION ALL SELECT 3, 'daily.ign', 'Bench.7' || chr(10) || 'Log.often:*' || chr(10))"""

c.SQL["container_members"] = f"WITH {_FILES} SELECT 'daily' AS db, member, member_pos, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS md5, CAST(NULL AS VARCHAR) AS error FROM f"


@query(
    f"""WITH {_FILES} SELECT 'daily' AS db, '01 Jan 2026 00-00 +0000' AS header_time, CAST(9 AS BIGINT) AS header_version, CAST(sum(strlen(content) - strlen(replace(content, chr(10), ''))) AS BIGINT) AS header_signatures,
CAST(90 AS BIGINT) AS header_flevel, 'unsigned' AS header_dsig, 'builder' AS header_builder, CAST(0 AS BIGINT) AS header_stime, TRUE AS intact FROM f"""
)
def container_fields(spark, sf_dir):
    """The header of a container but its checksum, which follows the compression, and whether the body has it."""
    packed = spark.createDataFrame([("daily", bytearray(c.sample_container(spark, sf_dir)))], "db string, content binary")
    return container.checked(packed).drop("content", "header_md5")


_OBJECT_COUNTS = c._LOGICAL.replace("doc_id", "object_id").replace("FROM documents", "FROM o")
c.SQL["container_scan"] = f"""WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS object_id, text FROM documents UNION ALL SELECT 'item ' || item_id, text FROM benchmark), {_OBJECT_COUNTS},
hs AS (SELECT md5(text) AS md5, min(item_id) AS item_id FROM benchmark WHERE text <> '' GROUP BY 1),
bh AS (SELECT object_id, 'Bench.' || item_id AS name, item_id, strlen(b.text) AS n, strlen(substr(o.text, 1, instr(o.text, b.text) - 1)) + strlen(b.text) AS e FROM o JOIN benchmark b ON contains(o.text, b.text) WHERE item_id <> 7 AND b.text <> ''),
b1 AS (SELECT object_id, arg_min(name, (e, -n, item_id)) AS name FROM bh GROUP BY 1),
g1 AS (SELECT object_id, arg_min(name, rule) AS name FROM g WHERE name <> 'Log.often' GROUP BY 1),
s AS (SELECT o.object_id, text, CASE WHEN hs.item_id IS NOT NULL THEN 'hash' WHEN b1.name IS NOT NULL THEN 'body' WHEN g1.name IS NOT NULL THEN 'logical' ELSE 'none' END AS stage,
    coalesce('Item.' || hs.item_id, b1.name, g1.name) AS signature FROM o LEFT JOIN hs ON hs.md5 = md5(text) LEFT JOIN b1 USING (object_id) LEFT JOIN g1 USING (object_id))
SELECT object_id, CASE WHEN signature IS NULL THEN 'clean' ELSE 'infected' END AS result, signature, stage, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS error FROM s"""
