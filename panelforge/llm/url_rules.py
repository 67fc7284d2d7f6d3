"""URL rules with redirect equivalence.

Pages that redirect to each other or name each other as canonical are one thing under several names. Edges are read from
canonical links and refresh redirects in the pages; connected components over them make the classes; a class with a
blocked member is blocked in all its names, unless one of them is allowed by a rule. A url's own rule always decides first.
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, staged
from .components import components


@dataclass(frozen=True)
class UrlRule:
    verdict: str  #: allow or block
    rule: str  #: host and path prefix, like net/a/

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for urls without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, or null; of rules of one length the first listed."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.rule)):  # later ones are asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    blocks = [r.rule for r in rules if r.verdict == "block"]
    return F.when(rule.isNull(), F.lit(None)).when(rule.isin(blocks), F.lit("block")).otherwise(F.lit("allow"))


def name_of(url: Column) -> Column:
    """A url as a vertex: without its fragment, its host in lower case."""
    return F.when(F.contains(url, F.lit("://")), F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def _without_dots(path: Column) -> Column:
    """A path from the root with its . and .. segments applied."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    last = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    walked = F.concat(F.aggregate(parts, empty, step), F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(empty))
    return F.when(F.concat(path, F.lit("/")).rlike(r"/\.\.?/"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """A link's target as a whole url, by the rules for references: absolute where it begins with a scheme, else relative to
    base's scheme, host, path or query. Null where base has no :// or the target is of another kind of scheme (mailto:)."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    here = F.concat(scheme, F.lit("://"), host_of(base))
    path = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    bare_target, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(~F.contains(base, F.lit("://")), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(here, _without_dots(bare_target), rest))
        .when(F.startswith(target, F.lit("?")), F.concat(here, path, target))
        .when(bare_target == "", base)
        .otherwise(F.concat(here, _without_dots(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), bare_target)), rest))
    )


def equivalences(pages: DataFrame) -> DataFrame:
    """(u, v): edges between names, of canonical links and refresh redirects. pages: (url, html).

    A tag ends at the next < or >, so that a page of unclosed tags is walked once, whatever its length.
    """
    tag = r"""(?is)<(?:link|meta)\b(?=[^<>]*\b(?:rel\s*=\s*["']?canonical\b|http-equiv\s*=\s*["']?refresh\b))[^<>]*+>"""
    hinted = pages.filter(F.col("html").rlike(r"(?i)canonical|refresh"))
    tags = hinted.select("url", F.explode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("tag"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    fresh = F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    target = F.regexp_replace(F.when(href != "", href).otherwise(fresh), "&amp;", "&")
    linked = tags.select("url", target.alias("target")).filter("target != ''")
    ends = linked.select(name_of(F.col("url")).alias("u"), name_of(resolved(F.col("url"), F.col("target"))).alias("v"))
    return ends.filter("u is not null and v is not null and u != v").distinct()


def judged(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each row of pages.

    redirects: further edges (u, v) of urls, from a crawl log. A null url, or one without ://, has an empty host and path,
    fits no rule, is in no class and gets the default. Null html has no edges. Repeated rows each get a row; an empty
    table gives none. Other columns are not read.
    """
    rows = bare(pages, page_id="page_id", url="url", html="html")
    edges = equivalences(rows.select("url", "html"))
    if redirects is not None:
        more = redirects.select(name_of(F.col("u")).alias("u"), name_of(F.col("v")).alias("v")).filter("u != v")
        edges = edges.union(more)
    edges = staged(edges, "url-edges")
    own = rows.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    found = components(edges)
    said = found.withColumn("said", verdict_of(rule_of(host_of(F.col("vertex")), path_of(F.col("vertex")), rules), rules))
    per_class = said.groupBy("root").agg(
        F.when(F.count_if(F.col("said") == "allow") > 0, F.lit("allow"))
        .when(F.count_if(F.col("said") == "block") > 0, F.lit("block")).alias("shared")
    )
    names = found.join(per_class, "root").select(F.col("vertex").alias("name"), "shared")
    named = own.withColumn("name", name_of(F.col("url"))).join(names, "name", "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("shared"), F.lit(default))
    return named.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: The same rows in DuckDB. Classes are left out of it: it says so of pages without a canonical link or refresh, and a
#: test with such links compares with brute force.
SQL = r"""
WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')) AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, rule, h, q) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/'))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
GROUP BY page_id, host, path
"""
