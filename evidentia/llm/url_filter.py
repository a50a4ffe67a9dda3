"""URL filters: prefix rules, and redirect equivalence that carries block decisions to aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.graph import connected_components

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or end, A-Z lower-cased; '' without ://."""
    raw = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct(rule, verdict), else null: one conditional expression, longest rule first.

    The rule list is a short setting of the job, held in the plan. A rule fits its host and all subdomains where the path starts with the rule's.
    """
    chain = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _without_dots(path: Column) -> Column:
    """``path`` with its . and .. segments resolved, as browsers do; a path without a dot after a slash is taken as it is."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.lit(1), F.size(a) - 1))).otherwise(a)  # noqa: E731  never above the root
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.when(path.contains("/."), F.array_join(kept, "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL as a graph node: no fragment, scheme and host in lower case, dot segments resolved, / for no path; null without ://."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host = F.regexp_extract(bare, r"^(?s).*?://([^/?#]*)", 1)
    path = F.regexp_extract(bare, r"^(?s).*?://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"^(?s).*?://[^?]*(.*)$", 1)
    full = F.concat(F.lower(F.substring_index(bare, "://", 1)), F.lit("://"), F.lower(host), F.when(path == "", F.lit("/")).otherwise(_without_dots(path)), query)
    return F.when(F.instr(url, "://") > 0, full)


def _resolved(base: Column, link: Column) -> Column:
    """``link`` as an absolute URL, seen from the page ``base``; null for schemes without an authority, such as mailto:."""
    scheme = F.substring_index(base, "://", 1)
    host = F.regexp_extract(base, r"^(?s).*?://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when((link != "") & ~link.startswith("#"), F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's URL and the target of each canonical link or redirect (meta refresh) in its HTML."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"), 0)
    found = pages.filter(F.col(url).contains("://")).select(F.col(url).alias("_u"), F.explode(tags).alias("tag"))
    canonical = F.regexp_extract("tag", r"(?is)^<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?is)^<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    link = F.when(canonical != "", canonical).when(refresh != "", refresh)
    return found.select(node_of(F.col("_u")).alias("a"), node_of(_resolved(F.col("_u"), link)).alias("b")).filter("b IS NOT NULL")


def judge(pages: DataFrame, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, rules=RULES, default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule, component and verdict (allow or block); columns of those names are replaced.

    A page with a rule of its own gets that rule's verdict: an explicit allow holds whatever its aliases are. A page without one is blocked if
    a rule blocks any URL of its component, where the components are those of the redirect and canonical-link graph; else it gets ``default``.
    ``redirects`` (a, b) adds known redirects. A null URL, or one without ://, has an empty host and path and no component. Repeated pages and
    URLs all get their verdict; components are joined by URL, so a URL with very many pages can be split by adaptive skew handling.
    """
    new = ("host", "path", "rule", "verdict", "component")
    # The row travels as one struct, so none of its columns can clash with those used here.
    judged = pages.select(F.struct("*").alias("_row")).withColumn("_host", host_of(F.col("_row")[url])).withColumn("_path", path_of(F.col("_row")[url]))
    judged = judged.withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules)).withColumn("_node", node_of(F.col("_row")[url]))
    sources = [alias_edges(pages, url, html)] if html else []
    if redirects is not None:
        sources.append(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    if sources:
        members = connected_components(reduce(DataFrame.unionByName, sources))
        judged_by = members.withColumn("_v", matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
        blocked = judged_by.groupBy("component").agg(F.max(F.coalesce(F.col("_v") == "block", F.lit(False))).alias("_blocked"))
        aliases = members.join(blocked, "component").select(F.col("node").alias("_node"), F.col("component").alias("_component"), "_blocked")
        judged = judged.join(aliases, "_node", "left")
    else:
        judged = judged.withColumn("_component", F.lit(None).cast("string")).withColumn("_blocked", F.lit(False))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), F.lit("block")), F.lit(default))
    rest = [F.col("_row")[c].alias(c) for c in pages.columns if c not in new]
    return judged.select(*rest, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.col("_component").alias("component"), verdict.alias("verdict"))


ORACLE = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
u AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
t AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
e AS (SELECT url AS a, regexp_extract(tag, '(?is)\b(?:href|url)\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM t),
edge AS (SELECT regexp_replace(a, '#.*$', '') AS a, regexp_replace(b, '#.*$', '') AS b FROM e WHERE b <> ''),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
judged AS (SELECT r.a, max(CASE WHEN v.verdict = 'block' THEN 1 ELSE 0 END) AS blocked FROM reach r LEFT JOIN rules v
  ON starts_with(regexp_extract(r.b, '://[^/?#]*([^?#]*)', 1), v.p) AND ('.' || lower(regexp_extract(r.b, '://([^/?#]*)', 1))) LIKE ('%.' || v.h) GROUP BY r.a),
m AS (SELECT u.page_id, u.url, host, path, first(h || p ORDER BY length(h || p) DESC) FILTER (h IS NOT NULL) AS rule, first(verdict ORDER BY length(h || p) DESC) FILTER (h IS NOT NULL) AS v
      FROM u LEFT JOIN rules ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked = 1 THEN 'block' END, 'allow') AS verdict
FROM m LEFT JOIN judged ON regexp_replace(m.url, '#.*$', '') = judged.a
"""
