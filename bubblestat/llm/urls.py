"""URL filters with redirect equivalence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut
from .components import components


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, where a url's path starts with the rule's."""

    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of what follows the first `://`: the part up to `/`, `?` or `#`, lower-cased, and the part up to `?` or `#`. Both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, or nulls."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(host, path)
        name, allow = F.when(fits, r.name).otherwise(name), F.when(fits, r.allow).otherwise(allow)
    return name, allow


def _node(url: Column) -> Column:
    """What stands for a url among aliases: host, path and query, whatever the scheme or fragment; null without a host."""
    host, _ = host_and_path(url)
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _targets(url: Column, html: Column) -> Column:
    """Absolute urls that the page's canonical links and refresh redirects name."""
    tags = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    wanted = F.filter(tags, lambda t: t.rlike(r"(?is)<link\b.*\brel\s*=\s*[\"']?\s*canonical\b") | t.rlike(r"(?is)<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    value = lambda t: F.when(
        t.rlike("(?i)^<link"), F.coalesce(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), F.lit(""))
    ).otherwise(F.regexp_extract(t, r"(?is)\burl\s*=\s*['\"]?\s*([^\"'\s>;]+)", 1))
    raw = F.filter(F.transform(wanted, lambda t: F.replace(value(t), F.lit("&amp;"), F.lit("&"))), lambda v: v != "")
    host = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    absolute = lambda v: (
        F.when(v.contains("://"), v).when(v.startswith("//"), F.concat(F.lit("http:"), v)).when(v.startswith("/"), F.concat(host, v)).otherwise(F.concat(folder, v))
    )
    return F.transform(raw, absolute)


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for each row of pages (page_id, url, html).

    A url that a rule fits has the verdict of the longest. Else it is blocked if a rule blocks any url that
    redirects and canonical links, either way and through any number of them, make it equal to; else allowed. So an explicit
    allow takes precedence over what aliases pass on. rules is a short list, applied as one expression; pages joins nothing else than its aliases' verdict.

    A null url, or one without `://`, has empty host and path, no aliases and, unless a rule fits, is allowed. Null html has no links. Repeated
    pages stay. Other columns are ignored. Empty table: empty result.
    """
    host, path = host_and_path(F.col("url"))
    name, allow = _ruled(rules, F.col("host"), F.col("path"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node"))
    own = own.select("*", name.alias("rule"), allow.alias("allow"))
    links = pages.select(_node(F.col("url")).alias("a"), F.explode(_targets(F.col("url"), F.col("html"))).alias("to")).select("a", _node(F.col("to")).alias("b"))
    alias = cut(components(links.where("a is not null and b is not null")), "urls")
    node_host, node_path = F.regexp_extract("node", "^([^/?#]*)", 1), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1)
    blocked = alias.where(_ruled(rules, node_host, node_path)[1] == F.lit(False)).select("component").distinct()
    passed_on = alias.join(blocked, "component", "left_semi").select(F.col("node").alias("blocked_node"))
    found = own.join(passed_on, own.node == F.col("blocked_node"), "left")
    verdict = F.when(F.coalesce("allow", F.col("blocked_node").isNull()), "allow").otherwise("block")
    return found.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))


RULES = [Rule(True, "com", "/"), Rule(False, "example.com", "/en/"), Rule(True, "www.example.com", "/en/"), Rule(False, "net", "/es/"), Rule(False, "net", "/fr/")]


def sql(rules: list[Rule]) -> str:
    """DuckDB: the same, with a recursive walk over aliases."""
    cases = lambda what, host, path: "CASE " + " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN {what(r)}" for r in sorted(rules, key=lambda r: -len(r.name))
    ) + " END"
    name, allow = (lambda r: f"'{r.name}'"), (lambda r: str(r.allow).lower())
    rest = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://(.*)$', 1)"
    node = "CASE WHEN lower(regexp_extract({0}, '^([^/?#]*)', 1)) <> '' THEN lower(regexp_extract({0}, '^([^/?#]*)', 1)) || CASE WHEN starts_with(regexp_extract({0}, '^[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract({0}, '^[^/?#]*([^#]*)', 1) END"
    absolute = "CASE WHEN contains(v, '://') THEN v WHEN starts_with(v, '//') THEN 'http:' || v WHEN starts_with(v, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || v ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) || v END"
    return f"""
WITH RECURSIVE own AS (
    SELECT page_id, url, html, lower(regexp_extract({rest.format('url')}, '^([^/?#]*)', 1)) AS host, regexp_extract({rest.format('url')}, '^[^/?#]*([^?#]*)', 1) AS path, {node.format(rest.format('url'))} AS node
    FROM pages
), tag AS (
    SELECT url, node, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\\b[^>]*>)', 1)) AS t FROM own WHERE regexp_matches(html, '(?i)canonical|refresh')
), target AS (
    SELECT url, node, replace(CASE WHEN regexp_matches(t, '(?is)^<link') THEN regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) ELSE regexp_extract(t, '(?is)\\burl\\s*=\\s*[''"]?\\s*([^"''\\s>;]+)', 1) END, '&amp;', '&') AS v
    FROM tag WHERE regexp_matches(t, '(?is)<link\\b.*\\brel\\s*=\\s*["'']?\\s*canonical\\b') OR regexp_matches(t, '(?is)<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')
), link AS (
    SELECT node AS a, {node.format(rest.format('(' + absolute + ')'))} AS b FROM target WHERE v <> ''
), edge AS (
    SELECT a, b FROM link WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM link WHERE a IS NOT NULL AND b IS NOT NULL
), walk AS (
    SELECT a AS blocked FROM edge WHERE {cases(allow, "regexp_extract(a, '^([^/?#]*)', 1)", "regexp_extract(a, '^[^/?#]*([^?#]*)', 1)")} = false
    UNION SELECT e.b FROM walk w JOIN edge e ON e.a = w.blocked
)
SELECT page_id, host, path, {cases(name, 'host', 'path')} AS rule,
       CASE WHEN coalesce({cases(allow, 'host', 'path')}, node IS NULL OR node NOT IN (SELECT blocked FROM walk)) THEN 'allow' ELSE 'block' END AS verdict
FROM own
"""
