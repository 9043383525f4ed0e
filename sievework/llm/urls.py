"""URL filters: rules by host and path, and a path-template tree judged by labelled purity.

Only DataFrame functions. Each path becomes a template: runs of digits read `{n}`, long hex
names `{h}`, A-Z lowered. Urls are first counted by host and template, and the tree work is
on those counts alone. At each depth, from the deepest labelled segment up to the first,
siblings (templates equal elsewhere, below as merged so far) merge when a branch's share of
bad labels does not differ from that of its siblings (two proportions, |z| <= Z), however
many there are: branches of at least MIN_LABELS labels into the wildcard `*`, those with
fewer, such as variable words, among themselves into `?`.

The merged templates make a tree for each host. A node has as units its branches and its own
template, each with its share of bad labels, and from the root down the purity to expect below a
node is (sum of its units' shares + ALPHA * that of its parent) / (units + ALPHA); above a host
stands PRIOR. The purity of a template with labels is (bad + ALPHA * expected) / (labels +
ALPHA), where expected leaves out its own share. A template without labels goes down the tree by
its segments, by `?` or else `*` where its own segment is not there, and takes the purity to
expect where it stops. So evidence passes to urls that no label names, but one bad branch
doesn't condemn its siblings. Templates whose purity reaches REJECT are rejected.

Labels: the query joins the table `labels` by the document number that ends a path (bad: toxic
or of quality 0), so that they reach urls without a rule; a url without such a label is
labelled by the verdict of its rule. A host without labels stays at PRIOR and is allowed.

Skew: the work is on one row for each host and template; a host with very many templates
meets its nodes by broadcast where they are hot (common.join_each).

Defined results: null url or one without `://` has an empty host and path; repeated rows
each get a row; an empty table gives none; a number with two labels takes the worse; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: (verdict, host, path prefix): the contract's rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_LABELS, Z, ALPHA, PRIOR, REJECT = 5, 1.96, 4.0, 0.2, 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The number of a page's document, at the end of its path.
NUMBER = r"/([0-9]+)(?:\.[^/.]*)?/?$"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The typed segments of a path."""

    def typed(s: Column) -> Column:
        hexy = s.rlike("^[0-9a-f]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-f]")
        return F.when(hexy, F.lit("{h}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))

    return F.transform(F.filter(F.split(F.translate(path, UPPER, LOWER), "/"), lambda s: s != ""), typed)


def _merge(t: DataFrame, depth: int) -> DataFrame:
    """Replaces the segment of `seg` at a depth (from 1) by * or ? where siblings merge."""
    put = lambda mark: F.transform("seg", lambda s, i: F.when(i + 1 == depth, mark).otherwise(s))
    t = t.withColumn("mask", F.concat_ws("/", put(F.lit("*")))).withColumn("own", F.expr(f"get(seg, {depth - 1})"))
    branch = t.filter("own is not null").groupBy("host", "mask", "own").agg(F.sum("labels").alias("bl"), F.sum("bad").alias("bb"))
    branch = branch.withColumn("few", F.col("bl") < MIN_LABELS)
    group = branch.groupBy("host", "mask", "few").agg(F.sum("bl").alias("gl"), F.sum("bb").alias("gb"))
    rest, one = F.col("gl") - F.col("bl"), F.lit(1)
    p = F.try_divide(F.col("gb"), F.col("gl"))
    gap = F.try_divide(F.col("bb"), F.col("bl")) - F.try_divide(F.col("gb") - F.col("bb"), rest)
    alike = (rest > 0) & (gap * gap <= Z * Z * p * (1 - p) * (F.try_divide(one, F.col("bl")) + F.try_divide(one, rest)))
    branch = branch.join(group, ["host", "mask", "few"]).filter(alike).select("host", "mask", "own", F.when(F.col("few"), F.lit("?")).otherwise(F.lit("*")).alias("wild"))
    joined = t.join(branch, ["host", "mask", "own"], "left")
    return joined.withColumn("seg", F.when(F.col("wild").isNull(), F.col("seg")).otherwise(put(F.col("wild")))).drop("mask", "own", "wild")


def templates(urls: DataFrame) -> DataFrame:
    """host, template, merged, purity, rejected from rows of host, path, bad (true, false or null).

    merged: the part of the tree that the template reaches."""
    scratch = C.Scratch(urls.sparkSession, "urls")
    t = urls.select("host", segments(F.col("path")).alias("seg"), "bad")
    t = t.groupBy("host", F.concat_ws("/", "seg").alias("template")).agg(F.first("seg").alias("seg"), F.count("bad").alias("labels"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    every = scratch.keep(t, "templates")
    t = every.filter("labels > 0")
    deepest = t.agg(F.max(F.size("seg"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        t = scratch.keep(_merge(t, depth), f"depth-{depth}")

    # the nodes of the tree: labels below each, and of its own template
    path = lambda depth: F.concat_ws("/", F.slice("seg", 1, depth))
    nodes = t.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("seg"))))
    ends = lambda c: F.sum(F.when(F.col("depth") == F.size("seg"), F.col(c))).alias(f"own_{c}")
    nodes = nodes.withColumns({"node": path(F.col("depth")), "parent": path(F.greatest(F.col("depth") - 1, F.lit(0))), "own": F.expr("get(seg, depth - 1)")})
    nodes = nodes.groupBy("host", "depth", "node", "parent", "own").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"), ends("labels"), ends("bad"))
    nodes = scratch.keep(nodes, "tree")
    share = F.col("bad") / F.col("labels")
    units = nodes.filter("depth > 0").select("host", F.col("parent").alias("node"), share.alias("share"), F.lit(False).alias("itself"))
    units = units.unionByName(nodes.filter("own_labels is not null").select("host", "node", (F.col("own_bad") / F.col("own_labels")).alias("share"), F.lit(True).alias("itself")))
    units = units.groupBy("host", "node").agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum(F.when(~F.col("itself"), F.col("share"))), F.lit(0.0)).alias("below"), F.coalesce(F.sum(F.when(F.col("itself"), F.col("share"))), F.lit(0.0)).alias("itself"))
    nodes = scratch.keep(nodes.join(units, ["host", "node"]), "nodes")

    def pure(above):
        """What to expect below a node, and the purity of its own template (null without labels)."""
        rest = (F.col("below") + above * ALPHA) / (F.col("units") - 1 + ALPHA)
        own = (F.col("own_bad") + rest * ALPHA) / (F.col("own_labels") + ALPHA)
        return ((F.col("below") + F.col("itself") + above * ALPHA) / (F.col("units") + ALPHA)).alias("expected"), own.alias("known")

    # purities from the root down, and the templates on their way through the tree
    level = scratch.keep(nodes.filter("depth = 0").select("host", "node", *pure(F.lit(PRIOR))), "level-0")
    walk = every.filter("labels = 0").select("host", "template", "seg").unionByName(t.select("host", "template", "seg"))
    hosts = walk.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(level, "host", "left")
    hosts = scratch.keep(hosts.withColumns({"go": F.col("node").isNotNull(), "node": F.coalesce("node", F.lit("")), "expected": F.coalesce("expected", F.lit(PRIOR))}), "hosts")
    walk = C.join_each(walk, hosts, ["host"]).select("host", "template", "seg", "node", "expected", "known", "go")
    walk, there = scratch.keep(walk, "walk-0"), []
    for depth in range(1, deepest + 1):
        on = F.col("go") & (F.size("seg") >= depth)
        there.append(walk.filter(~on))
        walk = walk.filter(on).withColumn("own", F.expr(f"get(seg, {depth - 1})"))
        above = level.select("host", F.col("node").alias("parent"), F.col("expected").alias("above"))
        level = nodes.filter(F.col("depth") == depth).join(above, ["host", "parent"])
        level = scratch.keep(level.select("host", "parent", "own", "node", *pure(F.col("above"))), f"level-{depth}")
        end = F.struct("node", "expected", "known")
        ways = level.groupBy("host", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("own") == wild, end)).alias(c) for wild, c in (("?", "few"), ("*", "many"))])
        ways = scratch.keep(walk.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n")).join(ways, ["host", "node"], "left"), f"ways-{depth}")
        exact = level.select("host", F.col("parent").alias("node"), "own", end.alias("exact"))
        walk = C.join_each(walk, ways, ["host", "node"]).join(exact, ["host", "node", "own"], "left").withColumn("next", F.coalesce("exact", "few", "many"))
        stop = F.col("next").isNull()  # a template that goes on is none of this node's own
        walk = walk.select("host", "template", "seg", *[F.when(stop, F.lit(None) if c == "known" else F.col(c)).otherwise(F.col(f"next.{c}")).alias(c) for c in ("node", "expected", "known")], (~stop).alias("go"))
        walk = scratch.keep(walk, f"walk-{depth}")
    for more in there:
        walk = walk.unionByName(more)
    # own labels count where the template ends, and what to expect where it leaves the tree
    purity = F.when(F.col("go") & (F.size("seg") <= deepest), F.coalesce("known", "expected")).otherwise(F.col("expected"))
    out = walk.select("host", "template", F.col("node").alias("merged"), purity.alias("purity"))
    return out.withColumn("rejected", F.col("purity") >= REJECT)


def doc_labels(labels: DataFrame) -> DataFrame:
    """number, given (true for bad) from doc_id, quality, toxic; one row for each document."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("number")).agg(F.max(bad).alias("given"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, template, verdict; a row for each row. labels: rows of number, given."""
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat_ws("/", segments(F.col("path"))).alias("template"))
    known = rows.withColumn("bad", F.col("ruled") == "block")
    if labels is not None:
        known = known.withColumn("number", F.regexp_extract("path", NUMBER, 1).try_cast("long")).join(labels, "number", "left").withColumn("bad", F.coalesce("given", "bad"))
    bad = templates(known).filter("rejected").select("host", "template", F.lit("block").alias("judged"))
    out = rows.join(bad, ["host", "template"], "left")
    return out.select("id", "host", "path", "rule", "template", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = doc_labels(C.table(spark, sf_dir, "labels"))
    return judge(C.table(spark, sf_dir, "pages"), labels=labels).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


#: The SQL is written out to this depth of paths; the tables have two.
SQL_DEPTH = 4


def _merge_sql(d: int) -> str:
    put = lambda mark: f"[CASE WHEN i = {d} THEN {mark} ELSE seg[i] END FOR i IN range(1, len(seg) + 1)]"
    return f"""
m{d}_t AS (SELECT *, array_to_string({put("'*'")}, '/') AS mask, seg[{d}] AS own FROM m{d + 1}),
m{d}_b AS (SELECT host, mask, own, sum(labels) AS bl, sum(bad) AS bb, sum(labels) < {MIN_LABELS} AS few FROM m{d}_t WHERE own IS NOT NULL GROUP BY ALL),
m{d}_g AS (SELECT host, mask, few, sum(bl) AS gl, sum(bb) AS gb FROM m{d}_b GROUP BY ALL),
m{d}_p AS (SELECT b.*, gl - bl AS rest, gb / CAST(gl AS DOUBLE) AS p, bb / CAST(bl AS DOUBLE) - (gb - bb) / nullif(CAST(gl - bl AS DOUBLE), 0) AS gap FROM m{d}_b b JOIN m{d}_g g USING (host, mask, few)),
m{d}_w AS (SELECT host, mask, own, CASE WHEN few THEN '?' ELSE '*' END AS wild FROM m{d}_p
    WHERE rest > 0 AND gap * gap <= CAST({Z * Z!r} AS DOUBLE) * p * (1 - p) * (1 / CAST(bl AS DOUBLE) + 1 / CAST(rest AS DOUBLE))),
m{d} AS (SELECT host, template, labels, bad, CASE WHEN wild IS NULL THEN seg ELSE {put("wild")} END AS seg FROM m{d}_t LEFT JOIN m{d}_w USING (host, mask, own)),"""


def _pure_sql(above: str) -> str:
    a = f"{ALPHA!r}::DOUBLE"
    return f"(below + itself + {above} * {a}) / (units + {a}) AS expected, (own_bad + (below + {above} * {a}) / (units - 1 + {a}) * {a}) / (own_labels + {a}) AS known"


def _walk_sql(d: int) -> str:
    ways = lambda c: " ".join(f"WHEN {t}.node IS NOT NULL THEN {t}.{c}" for t in "efm")
    pick = lambda c: f"CASE WHEN NOT go OR len(seg) < {d} THEN w.{c} {ways(c)} ELSE {'NULL' if c == 'known' else f'w.{c}'} END AS {c}"
    return f"""
l{d} AS (SELECT n.host, n.parent, n.own, n.node, {_pure_sql('l.expected')} FROM nodes n JOIN l{d - 1} l ON l.host = n.host AND l.node = n.parent WHERE depth = {d}),
w{d} AS (SELECT w.host, template, seg, {pick("node")}, {pick("expected")}, {pick("known")}, go AND (len(seg) < {d} OR coalesce(e.node, f.node, m.node) IS NOT NULL) AS go
    FROM w{d - 1} w LEFT JOIN l{d} e ON go AND e.host = w.host AND e.parent = w.node AND e.own = seg[{d}]
    LEFT JOIN l{d} f ON go AND len(seg) >= {d} AND f.host = w.host AND f.parent = w.node AND f.own = '?'
    LEFT JOIN l{d} m ON go AND len(seg) >= {d} AND m.host = w.host AND m.parent = w.node AND m.own = '*'),"""


def _rules_sql() -> tuple[str, str]:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return tuple("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{x}'" for x, h, p in ((v if k else h + p, h, p) for v, h, p in order)) + " END" for k in (0, 1))


SQL = (
    rf"""
WITH u0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
g AS (SELECT CAST(doc_id AS VARCHAR) AS number, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS given FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
u AS (SELECT *, {_rules_sql()[0]} AS rule, {_rules_sql()[1]} AS ruled, regexp_extract(path, '{NUMBER}', 1) AS number, [CASE WHEN regexp_matches(s, '^[0-9a-f]{{8,}}$') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-f]') THEN '{{h}}'
    ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END FOR s IN string_split(translate(path, '{UPPER}', '{LOWER}'), '/') IF s <> ''] AS seg FROM u0),
x AS (SELECT u.*, array_to_string(seg, '/') AS template, coalesce(given, ruled = 'block') AS label FROM u LEFT JOIN g ON g.number = ltrim(u.number, '0')),
t AS (SELECT host, template, first(seg) AS seg, count(label) AS labels, count(*) FILTER (label) AS bad FROM x GROUP BY 1, 2),
m{SQL_DEPTH + 1} AS (SELECT * FROM t WHERE labels > 0),"""
    + "".join(_merge_sql(d) for d in range(SQL_DEPTH, 0, -1))
    + f"""
n0 AS (SELECT host, seg, labels, bad, unnest(range(0, len(seg) + 1)) AS depth FROM m1),
tree AS (SELECT host, depth, array_to_string(seg[1:depth], '/') AS node, array_to_string(seg[1:greatest(depth - 1, 0)], '/') AS parent, seg[depth] AS own, sum(labels) AS labels, sum(bad) AS bad,
    sum(labels) FILTER (depth = len(seg)) AS own_labels, sum(bad) FILTER (depth = len(seg)) AS own_bad FROM n0 GROUP BY host, depth, 3, 4, 5),
units AS (SELECT host, node, count(*) AS units, coalesce(sum(share) FILTER (NOT itself), 0) AS below, coalesce(sum(share) FILTER (itself), 0) AS itself FROM
    (SELECT host, parent AS node, bad / labels::DOUBLE AS share, false AS itself FROM tree WHERE depth > 0 UNION ALL SELECT host, node, own_bad / own_labels::DOUBLE, true FROM tree WHERE own_labels IS NOT NULL) GROUP BY 1, 2),
nodes AS (SELECT * FROM tree JOIN units USING (host, node)),
l0 AS (SELECT host, NULL AS parent, NULL AS own, '' AS node, {_pure_sql(f"{PRIOR!r}::DOUBLE")} FROM nodes WHERE depth = 0),
every AS (SELECT host, template, seg FROM t WHERE labels = 0 UNION ALL SELECT host, template, seg FROM m1),
w0 AS (SELECT e.host, template, seg, '' AS node, coalesce(expected, {PRIOR!r}::DOUBLE) AS expected, known, expected IS NOT NULL AS go FROM every e LEFT JOIN l0 USING (host)),"""
    + "".join(_walk_sql(d) for d in range(1, SQL_DEPTH + 1))
    + f"""
r AS (SELECT host, template FROM w{SQL_DEPTH} WHERE CASE WHEN go THEN coalesce(known, expected) ELSE expected END >= {REJECT!r})
SELECT page_id, x.host, path, rule, coalesce(ruled, CASE WHEN r.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM x LEFT JOIN r ON x.host = r.host AND x.template = r.template
"""
)
