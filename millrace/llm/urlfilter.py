"""URL filters with redirect equivalence.

Rules name a host, with all its subdomains, and a path prefix; the longest rule that fits decides, an allow rule wins a tie. Urls that
lead to the same page share decisions: redirects, canonical links and refresh headers found in the pages are edges of a graph whose
connected components are found in Spark. With ``plain_forms`` a url is also tied to its plain form (no scheme, ``www.`` or ``m.``,
fragment, tracking parameters, index page or closing slash), so links may name either. A page without a rule of its own is blocked if its component holds a blocked url and no
allowed one: an explicit allow takes precedence over what aliases bring along. Everything else is allowed. Urls that are only linked
or redirected to, and are no page themselves, count like pages: a blocked page is often never fetched.

Rules are matched once per distinct host, so their number does not multiply the pages; a host's rules are as many as fit it.

Edge cases: a null url, or one without ``://``, has the empty host and path, no rule and no aliases, and is allowed; links that are
empty or lead nowhere are ignored; relative links are taken against their page; repeated rows are judged row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)=.*$"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*['"]?([^"'\s>]+)"""


def host_of(url: F.Column) -> F.Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_form(url: F.Column) -> F.Column:
    """The form that urls of one page share; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: ~p.rlike(_TRACKING) & (p != ""))
    kept = F.array_join(parts, "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def links_of(pages: DataFrame) -> DataFrame:
    """(url, target): canonical and refresh links of the pages, absolute."""
    canonical = F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _TARGET, 1)
    found = pages.select("url", F.explode(F.array(canonical, refresh)).alias("link")).filter("link <> '' and url is not null")
    scheme = F.regexp_extract("url", "^(.*?://)", 1)
    root = F.concat(scheme, host_of(F.col("url")))
    folder = F.concat(root, F.regexp_replace(path_of(F.col("url")), "[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    link = F.col("link")
    target = (F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
              .when(link.startswith("/"), F.concat(root, link)).when(~link.rlike("^[#?]"), F.concat(folder, link)))
    return found.filter(scheme != "").select("url", target.alias("target")).filter("target is not null")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules that fit each host, the longest first and allow before block."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.filter("host <> ''").select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    item = F.struct((-F.length("rule")).alias("size"), F.col("verdict"), F.col("rule"), F.col("prefix"))
    return fitting.groupBy("host").agg(F.array_sort(F.collect_set(item)).alias("rules"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules like ``("allow", "example.net/en/")`` as a table."""
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], v, r) for v, r in rules]
    return spark.createDataFrame(rows, "rule_host string, prefix string, verdict string, rule string")


def judge_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, broadcast_bytes: int | None = None,
                plain_forms: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict and component of every page. ``redirects`` holds (url, target)."""
    url = F.col("url")
    named = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    links = links_of(pages) if "html" in pages.columns else None
    if redirects is not None:
        more = redirects.select("url", "target").filter("url is not null and target is not null")
        links = more if links is None else links.unionByName(more)
    hosts = named.select("host")
    if links is not None:
        links = stored(links, "links")
        linked = (links.select("url").unionByName(links.select(F.col("target").alias("url"))).distinct()
                  .select("url", host_of(url).alias("host"), path_of(url).alias("path")))
        hosts = hosts.unionByName(linked.select("host"))
    found = bounded(stored(host_rules(hosts.distinct(), rules), "host-rules"), 512, broadcast_bytes)
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])), F.lit(0))
    ruled = (named.join(found, "host", "left").withColumn("_best", best)
             .select("page_id", "url", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("own")))

    edges = pages.sparkSession.createDataFrame([], "u string, v string") if links is None else links.select(F.col("url").alias("u"), F.col("target").alias("v"))
    if plain_forms:  # a url's node is its plain form; the raw url is tied to it
        urls = named.select("url") if links is None else named.select("url").unionByName(linked.select("url"))
        edges = edges.unionByName(urls.select(url.alias("u"), plain_form(url).alias("v")).filter("v is not null"))
    member = components(edges).withColumnRenamed("node", "url")
    judged = stored(ruled.join(member, "url", "left"), "ruled-pages")
    decided = judged.select("component", "own")
    if links is not None:
        others = linked.join(found, "host").select("url", best["verdict"].alias("own")).filter("own is not null")
        decided = decided.unionByName(others.join(member, "url").select("component", "own"))
    spread = (decided.filter("component is not null and own is not null").groupBy("component")
              .agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
              .filter("blocked and not allowed").select("component", F.lit("block").alias("shared")))
    spread = stored(spread, "blocked-components")
    return (judged.join(bounded(spread, 256, broadcast_bytes), "component", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"), "component"))


#: Fixed values of the query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
