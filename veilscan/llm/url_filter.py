"""URL filters that follow redirects and canonical links.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's; the
longest rule wins. Urls that a redirect or a canonical link joins are aliases of one page: connected components of
these links, found on the cluster. A url without a rule takes its aliases' verdict: allow if one of them is allowed by a
rule, else block if one is blocked by a rule, else the default.

* A null url, or one without ``://``, has an empty host and path, fits no rule and has no aliases.
* Null pages have no links. Repeated rows are judged alike. An empty table gives an empty result.
* Urls that differ after ``#`` alone are one url. Only page_id, url and html are read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import filled
from veilscan.llm.components import components

PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def absolute(base: Column, link: Column) -> Column:
    """A link as a full url, seen from the page at base. Null for links of other kinds (mailto:, data:) and empty ones."""
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return without_fragment(
        F.when(link.contains("://"), link)
        .when(F.length(link) == 0, None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(folder.endswith("/") & ~folder.endswith("://"), F.concat(folder, link))
        .otherwise(F.concat(origin, F.lit("/"), link)))


def links_of(pages: DataFrame) -> DataFrame:
    """from_url, to_url of each redirect (meta refresh) and canonical link in the pages."""
    html = filled(F.col("html"))
    targets = F.array(F.regexp_extract(F.regexp_extract(html, LINK, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TO, 1))
    found = pages.where(F.col("url").contains("://")).select(without_fragment(F.col("url")).alias("from_url"), "url", F.explode(targets).alias("link"))
    return (found.where(F.col("link") != "").select("from_url", absolute(F.col("url"), F.col("link")).alias("to_url"))
            .where(F.col("to_url").isNotNull() & (F.col("from_url") != F.col("to_url"))))


def alias_verdicts(links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """alias_url, alias_verdict (null if no alias has a rule) of every url on a link."""
    nodes = components(links.select("from_url", "to_url"))
    named = nodes.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    # 'allow' comes before 'block', so the least verdict of a component is the one that has precedence
    group = named.groupBy("component").agg(F.min("own").alias("alias_verdict"))
    return named.join(group, "component").select(F.col("node").alias("alias_url"), "alias_verdict")


def judged(pages: DataFrame, links: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each page; links: further (from_url, to_url) redirects, from a crawl's log for instance."""
    edges = links_of(pages)
    if links is not None:
        edges = edges.unionByName(links.select(without_fragment(F.col("from_url")).alias("from_url"), without_fragment(F.col("to_url")).alias("to_url")))
    url = F.col("url")
    own = pages.select("page_id", without_fragment(url).alias("alias_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return (own.join(alias_verdicts(edges, rules), "alias_url", "left")
            .select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit(default)).alias("verdict")))
