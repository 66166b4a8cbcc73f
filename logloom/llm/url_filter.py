"""URL filter by a path-template tree (native DataFrame functions only).

Hand-written rules decide first.  For the rest, every host gets a tree of path
templates.  Level by level, the children of a node are one wildcard when there
are many and none dominates (more than ``MANY`` kinds, the commonest at most
``TOP_SHARE``); other segments stay as they are, so ``/en/853`` and
``/en/12.html`` share ``/en/*``.  Where a rule decides some of a node's pages
but not all, the children that hold such pages stay fixed and out of the
count: a rule speaks for its own branch, not for the siblings of a wildcard.
The tree goes as deep as the paths do.  Sibling templates, which differ in their last fixed segment only,
merge when their share of bad labels does not differ from that of the other
siblings (two-proportion z at most ``SIMILAR``), or when none of them has a
label.  A template is rejected when its Laplace-smoothed purity
``(bad + 1) / (labelled + 2)`` reaches ``REJECT``.

Labels are the pages that a rule decides (block: bad), or any given
(page_id, bad) table.  All statistics are over distinct (host, path) rows with
counts, by partial aggregation, so a host with a third of all pages is spread.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged with the others of that kind; repeated rows count each and get
the same verdict; an empty table gives an empty result; extra columns do not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import LOWER, UPPER, written

#: levels that the SQL statement is written out for; the operator itself takes paths of any depth
SQL_LEVELS = 16
MANY = 8
TOP_SHARE = 0.25
SIMILAR = 1.96
REJECT = 0.9

#: fixed values: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_LAST_FIXED = r"(?s)^(.*)/([^/*]+)((?:/\*+)*)\z"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    return F.array_max(F.array(*fits))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, ruled, ...) with the template of each path;
    ``ruled``: how many of the path's n pages a rule decides."""
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = written(paths.withColumn("segs", F.transform(segments, lambda s: F.replace(s, F.lit("*"), F.lit("%2A"))))
                   .withColumn("template", F.lit("")), "paths")
    deepest = rows.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0]
    for d in range(deepest):
        rows = rows.withColumn("seg", F.get("segs", F.lit(d)))
        kids = rows.filter("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("c"), F.sum("ruled").alias("r"))
        loose = F.when(F.col("r") == 0, F.col("c"))
        nodes = kids.groupBy("host", "template").agg(
            (F.sum("r") == F.sum("c")).alias("pure"),
            *[F.struct(F.count(x).alias("kinds"), F.sum(x).alias("all"), F.max(x).alias("top")).alias(name)
              for name, x in (("every", F.col("c")), ("open", loose))])
        nodes = nodes.select("host", "template", "pure", F.when(F.col("pure"), F.col("every")).otherwise(F.col("open")).alias("k"))
        wild = written(nodes.filter((F.col("k.kinds") > MANY) & (F.col("k.top") <= TOP_SHARE * F.col("k.all")))
                       .select("host", "template", "pure", F.lit(True).alias("wild")), "wild")
        fixed = written(kids.filter("r > 0").join(wild.filter(~F.col("pure")), ["host", "template"], "left_semi")
                        .select("host", "template", "seg", F.lit(True).alias("fixed")), "fixed")
        part = F.when(F.col("seg").isNull(), F.lit("")).when(
            F.col("wild") & F.col("fixed").isNull(), F.lit("/*")).otherwise(F.concat(F.lit("/"), "seg"))
        rows = written(rows.join(wild.drop("pure"), ["host", "template"], "left").join(fixed, ["host", "template", "seg"], "left")
                       .withColumn("template", F.concat("template", part)).drop("wild", "fixed", "seg"), f"level-{d}")
    return rows.drop("segs")


def merged_templates(rows: DataFrame) -> DataFrame:
    """(host, template, merged): similar siblings share their common shape."""
    stats = rows.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    stats = stats.withColumn("shape", F.regexp_replace("template", _LAST_FIXED, "$1/~$3"))
    pool = stats.groupBy("host", "shape").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    both = stats.join(pool, ["host", "shape"])
    l2, b2 = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
    p1, p2 = (F.col("b") + 1.0) / (F.col("l") + 2.0), (b2 + 1.0) / (l2 + 2.0)
    p = (F.col("pb") + 1.0) / (F.col("pl") + 2.0)
    z = F.abs(p1 - p2) / F.sqrt(p * (1.0 - p) * (1.0 / (F.col("l") + 2.0) + 1.0 / (l2 + 2.0)))
    similar = (F.col("pl") == 0) | ((F.col("l") > 0) & (l2 > 0) & (z <= SIMILAR))
    return both.select("host", "template", F.when(similar, F.col("shape")).otherwise(F.col("template")).alias("merged"))


def rejected(rows: DataFrame) -> DataFrame:
    """(host, path) of every path whose merged template is rejected."""
    # narrow, and written: the two joins on it then see plain exchanges
    names = written(merged_templates(rows), "merged")
    full = rows.join(names, ["host", "template"])
    bad = full.groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    bad = bad.filter((F.col("b") + 1.0) / (F.col("l") + 2.0) >= REJECT).select("host", "merged")
    return written(full.join(written(bad, "rejected"), ["host", "merged"], "left_semi").select("host", "path"), "bad-paths")


def url_report(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    ``labels`` (page_id, bad) adds labelled pages to those that rules decide."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    seen = urls.withColumn("label", (F.col("ruled") == "block").cast("int"))
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("given"))
        seen = seen.join(given, "page_id", "left").withColumn("label", F.coalesce("label", "given"))
    paths = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("ruled"), F.count("label").alias("labelled"),
                                             F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    bad = rejected(templates(paths)).withColumn("bad", F.lit(True))
    return (urls.join(bad, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")))


def sql(rules=RULES) -> str:
    """The same result as DuckDB SQL, for paths of up to ``SQL_LEVELS`` segments."""
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}|{v}'"
                     for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])))
    out = rf"""
WITH u0 AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
u1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
u AS (SELECT *, split_part(r, '|', 1) AS rule, split_part(r, '|', 2) AS ruled
      FROM (SELECT *, CASE {cases} END AS r FROM u1)),
t0 AS (SELECT host, path, count(*) AS n, count(ruled) AS ruled, count(ruled) AS labelled,
              coalesce(sum((ruled = 'block')::INT), 0) AS bad,
              list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
                             lambda s: replace(s, '*', '%2A')) AS segs, '' AS template
       FROM u GROUP BY host, path)"""
    for d in range(SQL_LEVELS):
        out += rf""",
k{d} AS (SELECT host, template, segs[{d + 1}] AS seg, sum(n) AS c, sum(ruled) AS r FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
w{d} AS (SELECT host, template, sum(r) = sum(c) AS pure FROM k{d} GROUP BY host, template
         HAVING CASE WHEN sum(r) = sum(c) THEN count(*) > {MANY} AND max(c) <= {TOP_SHARE} * sum(c)
                ELSE count(*) FILTER (r = 0) > {MANY}
                     AND max(c) FILTER (r = 0) <= {TOP_SHARE} * sum(c) FILTER (r = 0) END),
f{d} AS (SELECT k.host, k.template, k.seg FROM k{d} k JOIN w{d} w ON k.host = w.host AND k.template = w.template
         WHERE k.r > 0 AND NOT w.pure),
t{d + 1} AS (SELECT t.* EXCLUDE (template), t.template || CASE WHEN len(segs) <= {d} THEN ''
                    WHEN w.host IS NOT NULL AND f.host IS NULL THEN '/*' ELSE '/' || segs[{d + 1}] END AS template
             FROM t{d} t LEFT JOIN w{d} w ON t.host = w.host AND t.template = w.template
             LEFT JOIN f{d} f ON t.host = f.host AND t.template = f.template AND t.segs[{d + 1}] = f.seg)"""
    return out + rf""",
t AS (SELECT host, path, labelled, bad, template FROM t{SQL_LEVELS}),
s AS (SELECT host, template, sum(labelled) AS l, sum(bad) AS b,
             regexp_replace(template, '{_LAST_FIXED}', '\1/~\3') AS shape FROM t GROUP BY host, template),
m AS (SELECT *, sum(l) OVER w AS pl, sum(b) OVER w AS pb FROM s WINDOW w AS (PARTITION BY host, shape)),
z AS (SELECT *, abs((b + 1.0::DOUBLE) / (l + 2.0::DOUBLE) - (pb - b + 1.0::DOUBLE) / (pl - l + 2.0::DOUBLE))
             / sqrt((pb + 1.0::DOUBLE) / (pl + 2.0::DOUBLE) * (1 - (pb + 1.0::DOUBLE) / (pl + 2.0::DOUBLE))
                    * (1 / (l + 2.0::DOUBLE) + 1 / (pl - l + 2.0::DOUBLE))) AS z FROM m),
g AS (SELECT host, template, l, b, CASE WHEN pl = 0 OR (l > 0 AND pl - l > 0 AND z <= {SIMILAR}) THEN shape
                                   ELSE template END AS merged FROM z),
x AS (SELECT host, merged FROM g GROUP BY ALL HAVING (sum(b) + 1.0::DOUBLE) / (sum(l) + 2.0::DOUBLE) >= {REJECT}),
bad AS (SELECT DISTINCT t.host, t.path FROM t JOIN g ON t.host = g.host AND t.template = g.template
        JOIN x ON x.host = g.host AND x.merged = g.merged)
SELECT u.page_id, u.host, u.path, u.rule,
       CASE WHEN ruled IS NOT NULL THEN ruled WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN bad ON u.host = bad.host AND u.path = bad.path
"""
