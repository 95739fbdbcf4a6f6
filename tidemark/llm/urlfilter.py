"""Operator 3 [native]: URL filters that follow redirects.

Rules name a host and a path prefix. A URL that no rule fits takes over what is decided for its
aliases: URLs tied by redirect and canonical-link edges form components, found by distributed
connected components. An explicit allow takes precedence: over a block for the URL itself by being
the longer rule, and over blocks elsewhere in the component for its members without a rule.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, durable

#: (host, path prefix, action)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def node(url: Column) -> Column:
    """What aliases are told by: the URL without scheme and fragment, its host lower-cased; null if it has no ``://``."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"^[^#?]*(\?[^#]*)?", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host, path, query))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` URLs: from each page to its canonical link and its refresh target.

    A target that begins with one slash belongs to the page's own host; targets that are neither
    such nor absolute are skipped.
    """
    tagged = pages.where(F.col(html_col).rlike(r"(?i)\bcanonical\b|\brefresh\b") & F.col(url_col).isNotNull())
    targets = F.filter(
        F.array(
            F.regexp_extract(F.regexp_extract(html_col, _CANONICAL, 0), _HREF, 1),
            F.regexp_extract(F.regexp_extract(html_col, _REFRESH, 0), _TARGET, 1),
        ),
        lambda x: x != "",
    )
    found = tagged.select(F.col(url_col).alias("src"), F.explode(targets).alias("t"))
    found = found.withColumn("t", F.replace("t", F.lit("&amp;"), F.lit("&")))
    own = F.concat(F.regexp_extract("src", r"^(.*?://[^/?#]*)", 1), F.col("t"))
    dst = F.when(F.locate("://", F.col("t")) > 0, F.col("t")).when(F.col("t").rlike("^/(?!/)"), own)
    return found.select("src", dst.alias("dst")).where("dst is not null")


def _rules(spark: SparkSession, rules) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules.selectExpr("host as r_host", "path as r_path", "action")
    return spark.createDataFrame(list(rules), "r_host string, r_path string, action string")


def fit_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, action)`` for the distinct ``(host, path)`` that a rule fits: the longest.

    Every host is expanded to its suffixes at label borders, so rules of any number are found by an
    equality join; Spark broadcasts them only if they are small.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = places.withColumn("r_host", F.explode(suffixes)).join(rules, "r_host").where(F.startswith("path", "r_path"))
    length = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "action")
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "action"), length)
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def judge(pages: DataFrame, edges: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, decided_by)``, one row per input row.

    ``edges(src, dst)`` are redirects and canonical links between URLs, which need not be in
    ``pages``. ``rules`` are (host, path, action) tuples or a DataFrame of these. ``rule`` is the
    longest that fits (null if none); ``verdict`` is its action, else allow if the URL's component
    holds an explicitly allowed URL, else block if it holds a blocked one, else allow; ``decided_by``
    says rule, alias or default. A null URL or one without ``://`` has empty host and path and fits
    no rule. Repeated rows and null ids stay; other columns are ignored; empty tables give an empty
    result.
    """
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), node(F.col(url_col)).alias("node"))
    links = durable(edges.where("src is not null and dst is not null").select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst"), F.col("src").alias("s"), F.col("dst").alias("d")).where("src is not null and dst is not null"))
    ends = links.select(F.col("s").alias("u")).unionByName(links.select(F.col("d").alias("u"))).distinct()
    e_host, e_path = host_path(F.col("u"))
    ends = ends.select(node(F.col("u")).alias("node"), e_host.alias("host"), e_path.alias("path")).distinct()
    places = rows.select("host", "path").unionByName(ends.select("host", "path")).distinct()
    decided = durable(fit_rules(places, _rules(pages.sparkSession, rules)))
    comp = connected_components(links.select("src", "dst"))
    known = ends.join(decided, ["host", "path"]).join(comp, "node").groupBy("component").agg(F.max(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("a"))
    alias = comp.join(known, "component").select("node", F.when(F.col("a") == 1, "allow").otherwise("block").alias("by_alias"))
    out = rows.join(decided, ["host", "path"], "left").join(durable(alias.distinct()), "node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", "by_alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("by_alias").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )


#: The same over ``pages`` in DuckDB: edges from canonical links and refreshes, decisions flooded along them.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), rows_ AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), targets AS (
  SELECT url AS src, replace(t, '&amp;', '&') AS t FROM (
    SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                        regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
    FROM rows_ WHERE url IS NOT NULL AND html IS NOT NULL) WHERE t <> ''
), edges AS (
  SELECT src, CASE WHEN strpos(t, '://') > 0 THEN t WHEN t LIKE '/%' AND t NOT LIKE '//%' THEN regexp_extract(src, '^(.*?://[^/?#]*)', 1) || t END AS dst FROM targets
), urls AS (
  SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT src FROM edges UNION ALL SELECT dst FROM edges) WHERE strpos(u, '://') > 0
), parsed AS (
  SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         regexp_extract(u, '^[^#?]*(\?[^#]*)?', 1) AS query FROM (SELECT u, substr(u, strpos(u, '://') + 3) AS rest FROM urls)
), rules(r_host, r_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), decided AS (
  SELECT u, host || path || query AS node, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(action, length(r_host || r_path)) AS action
  FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY 1, 2
), arcs AS (
  SELECT a.host || a.path || a.query AS x, b.host || b.path || b.query AS y FROM edges JOIN parsed a ON a.u = src JOIN parsed b ON b.u = dst
), both_ AS (SELECT x, y FROM arcs UNION SELECT y, x FROM arcs), reach(node, action) AS (
  SELECT DISTINCT node, action FROM decided WHERE node IN (SELECT x FROM both_) UNION SELECT y, action FROM reach JOIN both_ ON node = x
), alias_ AS (SELECT node, min(action) AS action FROM reach GROUP BY 1)
SELECT r.page_id, r.host, r.path, d.rule, coalesce(d.action, a.action, 'allow') AS verdict,
       CASE WHEN d.action IS NOT NULL THEN 'rule' WHEN a.action IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM rows_ r LEFT JOIN decided d ON r.url = d.u LEFT JOIN parsed q ON r.url = q.u LEFT JOIN alias_ a ON a.node = q.host || q.path || q.query
"""
