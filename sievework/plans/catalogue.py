"""Queries over the supplied tables, each with equivalent SQL where SQL can express it.

Signature tables are derived from the data: documents labelled as low quality become digest
signatures (MD5, SHA-1 or SHA-256 by language), good ones the allow-list, and benchmark items
literal body rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import parse, scan
from ..operators.patterns import Pattern, parse_offset
from ..operators.sigset import HASHES, SignatureSet
from ..sources import container, objects


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- objects and signatures from the tables ------------------------------------------------------


def documents(spark, sf_dir, *more) -> DataFrame:
    return objects.from_text(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id", *more)


def digested(spark, sf_dir, *more) -> DataFrame:
    return digests.with_digests(documents(spark, sf_dir, *more)).drop("content")


def algo_of(lang: Column) -> Column:
    return F.when(lang == "en", "md5").when(lang == "de", "sha1").otherwise("sha256")


def hash_signatures(spark, sf_dir) -> DataFrame:
    """seq, algo, digest, size, name of documents of low quality; English ones fit any size."""
    rows = digested(spark, sf_dir, "lang").join(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id")
    algo = algo_of(F.col("lang"))
    return rows.select(
        F.col("doc_id").alias("seq"),
        algo.alias("algo"),
        F.when(algo == "md5", F.col("md5")).when(algo == "sha1", F.col("sha1")).otherwise(F.col("sha256")).alias("digest"),
        F.when(F.col("lang") != "en", F.col("size")).alias("size"),
        F.concat(F.lit("Doc."), "lang", F.lit("-"), F.col("doc_id").cast("string")).alias("name"),
    )


def allow_digests(spark, sf_dir) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return digested(spark, sf_dir).join(good, "doc_id").select(F.lit("sha1").alias("algo"), F.col("sha1").alias("digest")).distinct()


IGNORED = [("Doc.fr-1", True), ("Bench.7", False), ("Doc.es-5", True)]


def ignored_names(spark) -> DataFrame:
    return spark.createDataFrame(IGNORED, "name string, is_prefix boolean")


def bench_rules(spark, sf_dir) -> tuple:
    """A literal body rule for each benchmark item, by item_id."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.hex(F.encode("text", "UTF-8")).alias("hexes")).orderBy("item_id")
    return tuple(parse.body_rule(f"Bench.{r.item_id}:0:*:{r.hexes}") for r in items.toLocalIterator() if r.hexes)


def hexed(text: str) -> str:
    return text.encode().hex()


LOGICAL = [
    f"Log.often;Target:0;0>20&1>5;{hexed(' the ')};{hexed('tion')}",
    f"Log.sized;Target:0,FileSize:300-900;(0=2|0=3)&1<4;{hexed('. ')};{hexed('que')}",
    f"Log.overlap;Target:0;0=3,9;{hexed('anan')}",
    f"Log.pe;Target:1;0;{hexed('the')}",
]

_SIGNATURES = """
d AS (SELECT doc_id, text, lang, source, strlen(text) AS size, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents),
h0 AS (SELECT doc_id AS seq, CASE lang WHEN 'en' THEN 'md5' WHEN 'de' THEN 'sha1' ELSE 'sha256' END AS algo,
    CASE lang WHEN 'en' THEN md5 WHEN 'de' THEN sha1 ELSE sha256 END AS digest, CASE WHEN lang <> 'en' THEN size END AS size,
    'Doc.' || lang || '-' || doc_id AS name FROM d SEMI JOIN labels l ON l.doc_id = d.doc_id AND quality = 0),
h AS (SELECT algo, digest, arg_min({'size': size, 'name': name}, seq) AS r, min(seq) AS seq FROM h0 GROUP BY 1, 2),
hs AS (SELECT algo, digest, r.size AS size, r.name AS name, seq FROM h),
allow AS (SELECT DISTINCT sha1 FROM d SEMI JOIN labels l ON l.doc_id = d.doc_id AND quality = 1),
hit AS (SELECT d.doc_id, coalesce(c.name, b.name, a.name) AS hash_name FROM d
    LEFT JOIN hs c ON c.algo = 'sha256' AND c.digest = d.sha256 AND (c.size IS NULL OR c.size = d.size)
    LEFT JOIN hs b ON b.algo = 'sha1' AND b.digest = d.sha1 AND (b.size IS NULL OR b.size = d.size)
    LEFT JOIN hs a ON a.algo = 'md5' AND a.digest = d.md5 AND (a.size IS NULL OR a.size = d.size))"""
_IGNORED = "(starts_with({0}, 'Doc.fr-1') OR starts_with({0}, 'Doc.es-5') OR {0} = 'Bench.7')"


# --- digests and lines -------------------------------------------------------------------------


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def object_digests(spark, sf_dir):
    return digested(spark, sf_dir).select("doc_id", "size", "md5", "sha1", "sha256")


_KINDS = [("%/de/%", "4D5A", 1), ("%/fr/%", "7F454C46", 6), ("%/es/%", "25504446", 10), ("%#top", "CAFEBABE", 9), ("%/", "FEEDFACE", 9)]


def _pages(spark, sf_dir) -> DataFrame:
    """Pages as objects whose leading bytes follow their url."""
    url, head = F.col("url"), F.lit("")
    for like, magic, _ in reversed(_KINDS):
        head = F.when(url.like(like), F.lit(magic)).otherwise(head)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.unhex(head), F.encode("html", "UTF-8")).alias("content"))


_KIND_SQL = "CASE " + " ".join(f"WHEN url LIKE '{like}' THEN {t}" for like, _, t in _KINDS) + " ELSE 0 END"


@query(f"SELECT page_id, CAST({_KIND_SQL} AS INTEGER) AS kind FROM pages")
def file_kind(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", digests.file_kind(F.col("content")).alias("kind"))


@query(f"SELECT page_id, ({_KIND_SQL}) = 1 AND contains(html, '</nav>') AS hit_pe, contains(html, '</nav>') AS hit_any, FALSE AS hit_html FROM pages")
def body_target(spark, sf_dir):
    p, c = Pattern.parse(hexed("</nav>")), F.col("content")
    return _pages(spark, sf_dir).select("page_id", scan.matches(c, p, 1).alias("hit_pe"), scan.matches(c, p).alias("hit_any"), scan.matches(c, p, 3).alias("hit_html"))


_LINE = """CASE source WHEN 'src1' THEN upper(md5) || ':' || size || ':D.' || doc_id WHEN 'src2' THEN 'zz' || md5 || ':1:D.' || doc_id
    WHEN 'src3' THEN sha1 || ':abc:D.' || doc_id WHEN 'src4' THEN sha256 || ':*:' WHEN 'src5' THEN '  ' || sha256 || ':*:D.' || doc_id || ':90:255 '
    WHEN 'src6' THEN md5 || ':4294967296:D.' || doc_id WHEN 'src7' THEN '# ' || md5 WHEN 'src8' THEN sha1 || ':4294967295:D.' || doc_id
    WHEN 'src9' THEN substr(sha1, 1, 39) || ':1:D.' || doc_id WHEN 'src10' THEN md5 || ':7' ELSE md5 || ':*:D.' || doc_id END"""


def _hash_lines(spark, sf_dir) -> DataFrame:
    d = digested(spark, sf_dir, "source").withColumn("id", F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("seq"), parse.strip(F.expr(_LINE.replace("size", "CAST(size AS STRING)").replace("doc_id", "id"))).alias("line"))


@query(
    f"""WITH d AS (SELECT doc_id, source, strlen(text) AS size, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents),
l AS (SELECT doc_id AS seq, string_split(trim({_LINE}), ':') AS p FROM d),
v AS (SELECT seq, p[1] AS digest, p[2] AS size, p[3] AS name, regexp_full_match(p[1], '[0-9a-fA-F]+') AND len(p[1]) IN (32, 40, 64) AND coalesce(p[3], '') <> ''
    AND (p[2] = '*' OR coalesce(TRY_CAST(p[2] AS BIGINT) <= 4294967295, FALSE)) AS ok FROM l)
SELECT seq, CASE WHEN ok THEN CASE len(digest) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END END AS algo, CASE WHEN ok THEN lower(digest) END AS digest,
    CASE WHEN ok THEN TRY_CAST(size AS BIGINT) END AS size, CASE WHEN ok THEN name END AS name FROM v"""
)
def hash_lines(spark, sf_dir):
    return parse.hash_rows(_hash_lines(spark, sf_dir)).select("seq", "algo", "digest", "size", "name")


@query(
    """WITH d AS (SELECT doc_id, source, strlen(text) AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents),
l AS (SELECT doc_id, size, md5, CASE WHEN source = 'src1' THEN '*' WHEN source = 'src2' THEN '' ELSE CAST(size AS VARCHAR) END AS s, CASE WHEN source = 'src3' THEN sha256 ELSE md5 END AS g FROM d)
SELECT doc_id AS seq, s <> '' AND len(g) = 32 AS valid_forced, s <> '' AS valid_free, CASE WHEN s NOT IN ('', '*') THEN CAST(s AS BIGINT) END AS size FROM l"""
)
def section_lines(spark, sf_dir):
    d = digested(spark, sf_dir, "source")
    size = F.when(F.col("source") == "src1", "*").when(F.col("source") == "src2", "").otherwise(F.col("size").cast("string"))
    digest = F.when(F.col("source") == "src3", F.col("sha256")).otherwise(F.col("md5"))
    rows = d.select(F.col("doc_id").alias("seq"), F.concat(size, F.lit(":"), digest, F.lit(":Sec")).alias("line"))
    forced = parse.hash_rows(rows, True, "md5").select("seq", "line", F.col("algo").isNotNull().alias("valid_forced"))
    return parse.hash_rows(forced, True).select("seq", "valid_forced", F.col("algo").isNotNull().alias("valid_free"), "size")


@query(
    """WITH x AS (SELECT doc_id, CASE source WHEN 'src1' THEN ' ' || md5(text) || ' ' WHEN 'src2' THEN sha1(text) WHEN 'src3' THEN upper(sha256(text)) WHEN 'src4' THEN 'xyz' ELSE substr(md5(text), 1, 31) END AS v, strlen(text) AS n FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(trim(v), '[0-9a-fA-F]{32}') THEN 'md5' WHEN regexp_full_match(trim(v), '[0-9a-fA-F]{40}') THEN 'sha1' WHEN regexp_full_match(trim(v), '[0-9a-fA-F]{64}') THEN 'sha256' ELSE 'unknown' END AS algorithm,
    CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%d.%d KiB', (n * 20 + 1024) // 2048 // 10, (n * 20 + 1024) // 2048 % 10) END AS size_text, format('{:,}', n) AS count_text,
    CASE WHEN n < 1000 THEN n || ' µs' ELSE printf('%d.%02d ms', (n + 5) // 10 // 100, (n + 5) // 10 % 100) END AS duration_text FROM x"""
)
def report_formats(spark, sf_dir):
    d = digested(spark, sf_dir, "source")
    s = F.col("source")
    v = F.when(s == "src1", F.concat(F.lit(" "), "md5", F.lit(" "))).when(s == "src2", F.col("sha1")).when(s == "src3", F.upper("sha256")).when(s == "src4", "xyz").otherwise(F.substring("md5", 1, 31))
    return d.select("doc_id", digests.digest_algorithm(v).alias("algorithm"), digests.format_bytes(F.col("size")).alias("size_text"), digests.format_count(F.col("size")).alias("count_text"), digests.format_duration_us(F.col("size")).alias("duration_text"))


# --- digest joins ------------------------------------------------------------------------------


def signatures(spark, sf_dir) -> DataFrame:
    return parse.first_wins(hash_signatures(spark, sf_dir))


@query(f"WITH {_SIGNATURES} SELECT algo, digest, size, name, seq FROM hs")
def hash_sigs_first_wins(spark, sf_dir):
    return signatures(spark, sf_dir)


@query(f"WITH {_SIGNATURES} SELECT doc_id, hash_name FROM hit")
def hash_match(spark, sf_dir):
    return scan.hash_match(digested(spark, sf_dir), signatures(spark, sf_dir)).select("doc_id", "hash_name")


@query(f"WITH {_SIGNATURES}, w AS (SELECT algo, digest, size + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS size, name FROM hs) SELECT d.doc_id, c.name AS hash_name FROM d LEFT JOIN w c ON c.algo = 'sha256' AND c.digest = d.sha256 AND c.size = d.size")
def hash_match_sizes(spark, sf_dir):
    """Half of the signatures carry a wrong size and fit nothing."""
    sigs = signatures(spark, sf_dir).filter("algo = 'sha256'").withColumn("size", F.col("size") + (F.col("seq") % 2 == 0).cast("int"))
    return scan.hash_match(digested(spark, sf_dir), sigs).select("doc_id", "hash_name")


@query(
    """WITH d AS (SELECT doc_id, lang, source, md5(text) AS md5 FROM documents),
s AS (SELECT md5, bool_or(source IN ('src0', 'src1')) AS c, bool_or(lang IN ('en', 'fr')) AS b, bool_or(lang IN ('en', 'de')) AS a FROM d GROUP BY 1)
SELECT doc_id, CASE WHEN c THEN 'by-sha256' WHEN b THEN 'by-sha1' WHEN a THEN 'by-md5' END AS hash_name FROM d JOIN s USING (md5)"""
)
def digest_precedence(spark, sf_dir):
    d = digested(spark, sf_dir, "lang", "source")

    def sigs(algo, keep):
        return d.filter(keep).select(F.lit(algo).alias("algo"), F.col(algo).alias("digest"), F.lit(None).cast("bigint").alias("size"), F.lit(f"by-{algo}").alias("name")).distinct()

    every = sigs("sha256", F.col("source").isin("src0", "src1")).union(sigs("sha1", F.col("lang").isin("en", "fr"))).union(sigs("md5", F.col("lang").isin("en", "de")))
    return scan.hash_match(d, every).select("doc_id", "hash_name")


@query(f"WITH {_SIGNATURES} SELECT doc_id, sha1 IN (SELECT sha1 FROM allow) AS allowed FROM d")
def allow_list(spark, sf_dir):
    return scan.allow_match(digested(spark, sf_dir), allow_digests(spark, sf_dir)).select("doc_id", "allowed")


@query(f"WITH {_SIGNATURES} SELECT name, {_IGNORED.format('name')} AS ignored FROM hs")
def ignored_signatures(spark, sf_dir):
    return scan.ignore_flag(signatures(spark, sf_dir), ignored_names(spark), "name").select("name", "ignored")


def digest_set(spark, sf_dir) -> SignatureSet:
    return SignatureSet(signatures(spark, sf_dir), spark.createDataFrame([], HASHES), allow_digests(spark, sf_dir), ignored_names(spark))


_LOOKUP = """CASE lang WHEN 'en' THEN CASE source WHEN 'src1' THEN substr(md5, 1, 31) WHEN 'src2' THEN 'no-digest' WHEN 'src3' THEN '' WHEN 'src4' THEN substr(md5, 1, 30) ELSE md5 END
    WHEN 'de' THEN 'sha1:' || sha1 WHEN 'fr' THEN CASE source WHEN 'src5' THEN '{broken' ELSE '{"sha256":"' || sha256 || '","md5":"' || md5 || '","size":' || size || '}' END ELSE upper(sha256) END"""


def _lookups(spark, sf_dir) -> DataFrame:
    d = digested(spark, sf_dir, "lang", "source")
    rows = d.select(F.col("doc_id").alias("line_no"), F.expr(_LOOKUP.replace("size", "CAST(size AS STRING)").replace('"CAST(size AS STRING)"', '"size"')).alias("given"))
    rows = rows.select("line_no", *[c.alias(n) for n, c in objects.lookup_columns(F.col("given")).items()])
    return scan.digest_lookup(rows.filter("line <> ''"), digest_set(spark, sf_dir))


_LOOKUP_SQL = f"""WITH {_SIGNATURES},
q0 AS (SELECT doc_id AS line_no, {_LOOKUP} AS line, lang, sha256, sha1, size FROM d),
q AS (SELECT *, CASE WHEN line = '{{broken' THEN NULL WHEN starts_with(line, '{{') THEN sha256 WHEN starts_with(line, 'sha1:') THEN sha1 ELSE line END AS digest,
    CASE WHEN starts_with(line, '{{"') THEN size END AS want FROM q0 WHERE line <> ''),
e AS (SELECT *, CASE WHEN digest IS NULL THEN 'invalid json' WHEN NOT regexp_full_match(digest, '[0-9a-fA-F]*') THEN 'invalid hash: non-hex digest'
    WHEN len(digest) % 2 = 1 THEN 'invalid hash: decode' WHEN len(digest) NOT IN (32, 40, 64) THEN 'invalid hash: unsupported length ' || (len(digest) // 2) END AS error FROM q),
r AS (SELECT line_no, e.line, e.digest, error, CASE WHEN NOT {_IGNORED.format("hs.name")} THEN hs.name END AS name FROM e LEFT JOIN hs ON error IS NULL AND hs.digest = lower(e.digest) AND (want IS NULL OR hs.size IS NULL OR hs.size = want)),
o AS (SELECT line_no, digest AS hash, CASE WHEN error IS NULL THEN CASE WHEN name IS NULL THEN 'clean' ELSE 'infected' END END AS result, name AS signature, error FROM r)"""


@query(_LOOKUP_SQL + " SELECT line_no, hash, result, signature, error FROM o")
def digest_lookup_batch(spark, sf_dir):
    return _lookups(spark, sf_dir).select("line_no", F.col("digest").alias("hash"), "result", "signature", "error")


@query(_LOOKUP_SQL + " SELECT count(*) AS total, count(*) FILTER (result = 'infected') AS infected, count(error) AS errors FROM o")
def batch_tallies(spark, sf_dir):
    return scan.tallies(_lookups(spark, sf_dir))


@query(
    f"""WITH {_SIGNATURES},
q AS (SELECT doc_id, CASE WHEN lang = 'en' THEN md5 END AS m, CASE WHEN lang = 'de' THEN sha1 END AS s1, CASE WHEN lang = 'fr' THEN sha256 END AS s2, size FROM d),
g AS (SELECT *, coalesce(s2, s1, m) AS digest FROM q)
SELECT doc_id, CASE WHEN digest IS NULL THEN NULL WHEN hs.name IS NOT NULL AND NOT {_IGNORED.format("hs.name")} THEN 'infected' ELSE 'clean' END AS result,
    CASE WHEN digest IS NULL THEN 'invalid hash: missing hash field' END AS error, CAST(g.size AS BIGINT) AS size, CASE WHEN digest IS NULL THEN '' ELSE coalesce(m, '') END AS md5
FROM g LEFT JOIN hs USING (digest) WHERE hs.size IS NULL OR hs.size = g.size OR digest IS NULL"""
)
def hash_requests(spark, sf_dir):
    d = digested(spark, sf_dir, "lang")
    pick = lambda lang, c: F.when(F.col("lang") == lang, F.col(c)).alias(c)
    rows = d.select("doc_id", F.lit(None).cast("string").alias("hash"), pick("fr", "sha256"), pick("de", "sha1"), pick("en", "md5"), "size")
    out = scan.hash_request(rows, digest_set(spark, sf_dir))
    return out.select("doc_id", "result", "error", "size", F.coalesce("md5", F.lit("")).alias("md5"))


# --- body rules --------------------------------------------------------------------------------


def rule_set(spark, body=(), logical=(), ignored=None) -> SignatureSet:
    empty = SignatureSet.empty(spark)
    return SignatureSet(empty.file_hashes, empty.section_hashes, empty.allow, ignored if ignored is not None else empty.ignored, tuple(body), tuple(logical))


@query("SELECT doc_id, 'Bench.' || item_id AS name FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def body_literal(spark, sf_dir):
    sigs = rule_set(spark, bench_rules(spark, sf_dir))
    return scan.body_hits(documents(spark, sf_dir), sigs, "doc_id").select("doc_id", "name")


#: Bytes that are not alphanumeric, in upper-case hex.
_W = "(?:[0-289A-F].|3[A-F]|40|5[B-F]|60|7[B-F])"
#: Two bytes that are none of of, an, to.
_NONE = "(?:[^67]...|6[^F1]..|6F[^6].|6F6[^6]|61[^6].|616[^E]|7[^4]..|74[^6].|746[^F])"
#: Name, pattern, and the same as a regex over the upper-case hex of the text, aligned to bytes. All have their
#: anchor first: a variable skip before it would pin a rule to byte 0.
WILDCARDS = [
    ("literal", hexed("tion of "), "74696F6E206F6620"),
    ("any", "74??65206f66", "74..65206F66"),
    ("high", "7468652?6f66", "7468652.6F66"),
    ("low", "746865?06f66", "746865.06F66"),
    ("skip", "74686520{3}6f6620", "74686520(?:..){3}6F6620"),
    ("range", "74686520{2-6}6f6620", "74686520(?:..){2,6}6F6620"),
    ("most", "74686520{-4}6f6620", "74686520(?:..){0,4}6F6620"),
    ("least", "74686520{200-}6f6620", "74686520(?:..){200,}6F6620"),
    ("brackets", "74686520[2-6]6f6620", "74686520(?:..){2,6}6F6620"),
    ("any_length", "74686520*616e616e", "74686520(?:..)*616E616E"),
    ("either", "746865(206f66|20616e)6420", "746865(?:206F66|20616E)6420"),
    ("neither", "74686520!(6f66|616e|746f)20", f"74686520{_NONE}20"),
    ("word_end", "74696f6e(W)74686520", f"74696F6E{_W}74686520"),
    ("line_end", "6e2e(L)54", "6E2E(?:0A|0D0A|0D)54"),
    ("bound", "20(B)7468652074", "207468652074"),
]


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(x, '^(?:..)*{regex}') AS w_{name}" for name, _, regex in WILDCARDS) + " FROM (SELECT doc_id, hex(encode(text)) AS x FROM documents)")
def body_wildcards(spark, sf_dir):
    """One rule for each token of the pattern language, natively."""
    return documents(spark, sf_dir).select("doc_id", *[scan.matches(F.col("content"), Pattern.parse(p)).alias(f"w_{name}") for name, p, _ in WILDCARDS])


@query("SELECT doc_id, 'W.' || name AS name FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name FROM x WHERE regexp_matches(h, '^(?:..)*{regex}')" for name, _, regex in WILDCARDS).join(("WITH x AS (SELECT doc_id, hex(encode(text)) AS h FROM documents) ", ")")))
def body_automaton(spark, sf_dir):
    """The same rules in one pass of the automaton."""
    sigs = rule_set(spark, [parse.body_rule(f"W.{name}:0:*:{p}") for name, p, _ in WILDCARDS])
    return scan.body_hits(documents(spark, sf_dir), sigs, "doc_id").select("doc_id", "name")


@query(
    """SELECT page_id, starts_with(h, '3C21444F4354595045') AS at_start, h[31:40] = '3C68746D6C' AS at_15, regexp_matches(h, '^(?:..){5,20}3C68746D6C') AS near_start, ends_with(h, '3C2F68746D6C3E') AS at_end,
    regexp_matches(right(h, 40), '^(?:..){0,10}3C2F626F6479') AS near_end, regexp_matches(right(h, 40), '^(?:..){0,10}3C2F666F6F746572') AS near_footer FROM (SELECT page_id, hex(encode(html)) AS h FROM pages)"""
)
def body_offsets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    c = F.col("content")
    at = lambda text, offset, name: scan.matches(c, Pattern.parse(hexed(text)), 0, parse_offset(offset)).alias(name)
    return pages.select("page_id", at("<!DOCTYPE", "0", "at_start"), at("<html", "15", "at_15"), at("<html", "5,15", "near_start"), at("</html>", "EOF-7", "at_end"), at("</body", "EOF-20,10", "near_end"), at("</footer", "EOF-20,10", "near_footer"))


@query("SELECT conv_id, turn, role, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS INTEGER) AS n_tion, contains(text, 'that') AS that FROM conversations")
def conversation_scan(spark, sf_dir):
    c = F.encode("text", "UTF-8")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", scan.hit_count(c, Pattern.parse(hexed("tion"))).alias("n_tion"), scan.matches(c, Pattern.parse(hexed("that"))).alias("that"))


@query("SELECT event_id, regexp_matches(h, '^(?:..)*226B223A(?:..){0,1}3.') AS digit, starts_with(h, '7B22') AS object FROM (SELECT event_id, hex(encode(props)) AS h FROM events)")
def event_props_scan(spark, sf_dir):
    c = F.encode("props", "UTF-8")
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", scan.matches(c, Pattern.parse("226b223a{-1}3?")).alias("digit"), scan.matches(c, Pattern.parse("7b22"), 0, parse_offset("0")).alias("object"))


# --- logical rules -----------------------------------------------------------------------------

_COUNT = lambda word: f"CAST((strlen(text) - strlen(replace(text, '{word}', ''))) // {len(word)} AS INTEGER)"
_OVERLAP = "CAST(len(list_filter(range(1, length(text)), lambda i: substr(text, i, 4) = 'anan')) AS INTEGER)"
#: ' the ' can share a space with the next one, so its occurrences are counted by their starts.
_THE = "CAST(len(list_filter(range(1, length(text)), lambda i: substr(text, i, 5) = ' the ')) AS INTEGER)"
_LOGICAL = f"""c AS (SELECT doc_id, strlen(text) AS size, {_THE} AS the, {_COUNT("tion")} AS tion, {_COUNT(". ")} AS stop, {_COUNT("que")} AS que, {_OVERLAP} AS anan FROM documents),
g AS (SELECT doc_id, 0 AS rule, 'Log.often' AS name FROM c WHERE the > 20 AND tion > 5
    UNION ALL SELECT doc_id, 1, 'Log.sized' FROM c WHERE size BETWEEN 300 AND 900 AND stop IN (2, 3) AND que < 4
    UNION ALL SELECT doc_id, 2, 'Log.overlap' FROM c WHERE anan BETWEEN 3 AND 9)"""


def logical_rules() -> list:
    return [parse.logical_rule(x) for x in LOGICAL]


@query(f"WITH {_LOGICAL} SELECT doc_id, the, tion, anan FROM c")
def subsig_counts(spark, sf_dir):
    c = F.col("content")
    count = lambda text: scan.hit_count(c, Pattern.parse(hexed(text)))
    return documents(spark, sf_dir).select("doc_id", count(" the ").alias("the"), count("tion").alias("tion"), count("anan").alias("anan"))


@query(f"WITH {_LOGICAL} SELECT doc_id, CAST(rule AS INTEGER) AS rule, name FROM g")
def logical_match(spark, sf_dir):
    rules = rule_set(spark, logical=logical_rules())
    return scan.sub_counts(documents(spark, sf_dir), rules, "doc_id").filter("holds").select("doc_id", "rule", "name")


# --- verdicts ----------------------------------------------------------------------------------


def full_set(spark, sf_dir) -> SignatureSet:
    d = digest_set(spark, sf_dir)
    return SignatureSet(d.file_hashes, d.section_hashes, d.allow, d.ignored, bench_rules(spark, sf_dir), tuple(logical_rules()), version=1)


_VERDICT = f"""WITH {_SIGNATURES}, {_LOGICAL},
bh AS (SELECT doc_id, 'Bench.' || item_id AS name, item_id, strlen(b.text) AS n, strlen(substr(d.text, 1, instr(d.text, b.text) - 1)) + strlen(b.text) AS e
    FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE item_id <> 7),
b1 AS (SELECT doc_id, arg_min(name, (e, -n, item_id)) AS name FROM bh GROUP BY 1),
g1 AS (SELECT doc_id, arg_min(name, rule) AS name FROM g GROUP BY 1),
s AS (SELECT d.*, hit.hash_name, coalesce({_IGNORED.format("hit.hash_name")}, FALSE) AS ign, d.sha1 IN (SELECT sha1 FROM allow) AS allowed, b1.name AS body, g1.name AS logical
    FROM d JOIN hit USING (doc_id) LEFT JOIN b1 USING (doc_id) LEFT JOIN g1 USING (doc_id)),
st AS (SELECT *, CASE WHEN hash_name IS NOT NULL AND NOT ign AND NOT allowed THEN 'hash' WHEN allowed THEN 'allowed' WHEN body IS NOT NULL THEN 'body' WHEN logical IS NOT NULL THEN 'logical' ELSE 'none' END AS stage FROM s),
v AS (SELECT doc_id, source, CASE WHEN stage IN ('hash', 'body', 'logical') THEN 'infected' ELSE 'clean' END AS result,
    CASE stage WHEN 'hash' THEN hash_name WHEN 'body' THEN body WHEN 'logical' THEN logical END AS signature, stage, CAST(size AS BIGINT) AS size, md5, sha1, sha256 FROM st)"""


def _verdicts(spark, sf_dir) -> DataFrame:
    return scan.verdict(documents(spark, sf_dir, "source"), full_set(spark, sf_dir), "doc_id", "source")


@query(_VERDICT + " SELECT doc_id, result, signature, stage, size, md5, sha1, sha256 FROM v")
def verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("doc_id", "result", "signature", "stage", "size", "md5", "sha1", "sha256")


@query(_VERDICT + """ SELECT doc_id, '{"result":"' || result || '"' || coalesce(',"signature":"' || signature || '"', '') || ',"size":' || size || ',"md5":"' || md5 || '"}' AS json FROM v""")
def verdict_json(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).select("doc_id", "result", "signature", "size", "md5")
    return scan.as_json(rows, "result", "signature", "size", "md5").select("doc_id", "json")


@query(_VERDICT + " SELECT source, stage, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM v GROUP BY 1, 2")
def infected_by_source(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("source", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(_VERDICT + " SELECT quality, result, count(*) AS n FROM v JOIN labels USING (doc_id) GROUP BY 1, 2")
def verdict_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _verdicts(spark, sf_dir).join(labels, "doc_id").groupBy("quality", "result").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SIGNATURES} SELECT (SELECT count(*) FROM hs) AS file_hash, CAST(0 AS BIGINT) AS section_hash, (SELECT count(*) FROM benchmark WHERE text <> '') AS body, CAST(4 AS BIGINT) AS logical, CAST(0 AS BIGINT) AS skipped")
def signature_counters(spark, sf_dir):
    return full_set(spark, sf_dir).counters()


@query(f"WITH {_SIGNATURES} SELECT (SELECT count(*) FROM hs) + (SELECT count(*) FROM benchmark WHERE text <> '') + 4 > 0 AS ready, (SELECT count(*) FROM hs) AS file_hashes, (SELECT count(*) FROM benchmark WHERE text <> '') AS body_sigs")
def readiness(spark, sf_dir):
    return full_set(spark, sf_dir).readiness()


# --- containers, sections and streams (rows only) --------------------------------------------------


def sample_container(spark, sf_dir) -> bytes:
    """A container of the benchmark's rules, the logical rules and a digest line for each benchmark item."""
    import hashlib

    items = table(spark, sf_dir, "benchmark").orderBy("item_id").collect()
    ndb = "".join(f"Bench.{r.item_id}:0:*:{hexed(r.text)}\n" for r in items if r.text)
    hdb = "".join(f"{hashlib.md5(r.text.encode()).hexdigest()}:{len(r.text.encode())}:Item.{r.item_id}\n" for r in items if r.text)
    files = {"daily.hdb": hdb, "daily.ndb": ndb, "daily.ldb": "\n".join(LOGICAL) + "\n", "daily.ign": "Bench.7\nLog.often:*\n", "notes.cbc": "not read"}
    return container.pack({k: v.encode() for k, v in files.items()}, version=9)


@query()
def container_members(spark, sf_dir):
    packed = spark.createDataFrame([("daily", bytearray(sample_container(spark, sf_dir)))], "db string, content binary")
    return container.members(packed).select("db", "member", "member_pos", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("md5"), "error")


@query()
def container_header(spark, sf_dir):
    packed = spark.createDataFrame([("daily", bytearray(sample_container(spark, sf_dir)))], "db string, content binary")
    return container.checked(packed).drop("content")


@query()
def container_scan(spark, sf_dir):
    """The container loaded as a signature set, scanning documents and benchmark items."""
    from ..sources import directory

    sigs = directory.load_bytes(spark, sample_container(spark, sf_dir))
    docs = documents(spark, sf_dir).drop("doc_id")
    items = objects.from_text(table(spark, sf_dir, "benchmark").withColumn("id", F.concat(F.lit("item "), F.col("item_id").cast("string"))), "id", "text")
    return scan.verdict(docs.unionByName(items), sigs)


def image_of(section: Column) -> Column:
    """An executable of one section."""
    le = lambda n, width: F.lit(n.to_bytes(width, "little"))
    size = F.unhex(F.regexp_replace(F.lpad(F.hex(F.octet_length(section)), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    head = b"MZ".ljust(0x3C, b"\0") + (0x80).to_bytes(4, "little")
    coff = b"PE\0\0" + (0x14C).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes(12) + (0xE0).to_bytes(2, "little") + bytes(2)
    options = (0x10B).to_bytes(2, "little") + bytes(14) + (0x1000).to_bytes(4, "little") + bytes(0xE0 - 20)
    before = head.ljust(0x80, b"\0") + coff + options + b".text\0\0\0"
    table_end = len(before) + 32
    return F.concat(F.lit(before), size, le(0x1000, 4), size, le(0x200, 4), F.lit(bytes(16)), F.lit(bytes(0x200 - table_end)), section)


@query(
    """WITH s AS (SELECT md5(text) AS md5, 'Sec.' || min(doc_id) AS name FROM documents SEMI JOIN labels l ON l.doc_id = documents.doc_id AND toxic = 1 WHERE text <> '' GROUP BY 1)
SELECT doc_id, s.name AS section_name FROM documents d JOIN s ON s.md5 = md5(d.text)"""
)
def section_hashes(spark, sf_dir):
    """Documents as the only section of an executable, against section digests of toxic documents."""
    docs = documents(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    sigs = docs.join(toxic, "doc_id").filter(F.octet_length("content") > 0).groupBy(F.md5("content").alias("digest")).agg(F.min("doc_id").alias("m"), F.first(F.octet_length("content").cast("long")).alias("size"))
    sigs = sigs.select(F.lit("md5").alias("algo"), "digest", "size", F.concat(F.lit("Sec."), F.col("m").cast("string")).alias("name"))
    files = docs.withColumn("content", image_of(F.col("content")))
    return scan.section_match(scan.sections(files, "doc_id"), sigs, "doc_id")


@query(_VERDICT + " SELECT CAST(doc_id AS VARCHAR) AS object_id, result, signature, CAST(1 AS BIGINT) AS signature_version FROM v")
def stream_scan(spark, sf_dir):
    """Documents as a stream in micro-batches; verdicts land in a table of the shared folder."""
    import tempfile
    import uuid

    from ..streaming.scan import Snapshots, scan_stream

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sievework-")
    base = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parquet*")
    stream = objects.from_text(stream, "doc_id", "text")

    def sink(rows: DataFrame, number: int) -> None:
        rows.select("object_id", "result", "signature", F.col("signature_version").cast("bigint").alias("signature_version")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    scan_stream(stream, Snapshots(full_set(spark, sf_dir)), sink, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


from . import details  # noqa: E402, F401  (adds its queries)
