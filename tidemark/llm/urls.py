"""URL filters by redirect equivalence: rules on hosts and paths, block decisions carried along redirects and canonical links.

Urls that redirect to each other or name each other as canonical are one page under several addresses. They form connected
components (distributed, DataFrame operations only). A url that a rule fits keeps the verdict of that rule. Any other url takes
the verdict of its component: allow if a rule allows one of its members explicitly, else block if a rule blocks one, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import ascii_lower
from .components import components

# The rules of the contract, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query: what a redirect between schemes or a fragment doesn't change. Null without a host."""
    query = F.coalesce(F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null fields if none does."""
    found = F
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = found.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def _targets(html: Column) -> Column:
    """Urls that a page names as canonical or redirects to."""
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    jump = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    return F.array(
        F.regexp_extract(link, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
        F.regexp_extract(jump, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))


def _resolved(target: Column, url: Column) -> Column:
    """An absolute url for a target that is relative to the host or to the folder of the page."""
    site = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(F.instr(target, "://") > 0, target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target)))


def link_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: addresses joined by a redirect or a canonical link, taken from the html of ``pages(url, html)``."""
    return (
        pages.where("url is not null and html is not null")
        .select("url", F.explode(F.filter(_targets(F.col("html")), lambda t: t != "")).alias("target"))
        .select(address(F.col("url")).alias("a"), address(_resolved(F.col("target"), F.col("url"))).alias("b"))
        .where("a is not null and b is not null"))


def filter_urls(pages: DataFrame, rules=None, edges: DataFrame | None = None) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)``, one row per row of ``pages(page_id, url, html)``.

    ``edges(a, b)`` are addresses as `address` gives them; by default those of the html. A missing url has an empty host and
    path, no rule and no aliases: it is allowed. Repeated rows give repeated results; no rows give no rows.
    """
    rules = RULES if rules is None else rules
    judged = pages.select("page_id", "url").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    own = rule_of(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    judged = judged.withColumn("own", own)
    edges = materialize(link_edges(pages) if edges is None else edges, "url-edges")
    parts = materialize(components(edges, "urls"), "url-aliases")
    # An address is host, path and query, so it carries all that a rule looks at: pages and link targets alike.
    as_url = F.concat(F.lit("://"), F.col("node"))
    ruled = parts.withColumn("own", rule_of(host_of(as_url), path_of(as_url), rules)["verdict"] if rules else F.lit(None).cast("string"))
    of_root = ruled.groupBy("root").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    aliases = parts.join(of_root, "root").select("node", "allowed", "blocked")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block"), F.lit("allow"))
    return judged.join(aliases, "node", "left").select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
