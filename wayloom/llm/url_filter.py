"""URL filters: allow and block rules, and decisions carried along redirects and canonical links. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import ascii_lower, cut, table
from wayloom.operators.shared import components

#: (verdict, host, path) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MOST_RULES = 256


def url_host(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """What names a page: the url without its fragment, scheme and host in lower case; null without ://."""
    whole = F.regexp_extract(url, r"^([^#]*)", 1)
    head = F.regexp_extract(whole, r"^((?s:.*?)://[^/?]*)", 1)
    return F.when(F.instr(whole, "://") > 0, F.concat(ascii_lower(head), F.substr(whole, F.length(head) + 1)))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path, rule and _verdict to df(url, ...): those of the longest rule that fits, allow first among equals; else null.

    The rules are one literal array, longest first, so there may be MOST_RULES of them at most."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow"))
    known = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in ordered))

    def judged(u):
        fits = F.filter(known, lambda r: ((u["h"] == r["h"]) | u["h"].endswith(F.concat(F.lit("."), r["h"]))) & u["p"].startswith(r["p"])) if rules else F.array().cast("array<struct<v:string,h:string,p:string>>")
        return F.struct(u["h"].alias("host"), u["p"].alias("path"), F.get(fits, F.lit(0)).alias("r"))

    asked = F.array(F.struct(url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p")))
    out = df.select(F.struct(*df.columns).alias("_own"), F.inline(F.transform(asked, judged)))  # a generator, so that nothing is computed twice
    return out.select("_own.*", "host", "path", F.concat("r.h", "r.p").alias("rule"), F.col("r.v").alias("_verdict"))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): keys of a page's url and of what its canonical link or its refresh redirect names; relative links are resolved."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = F.col("tag")
    tagged = pages.where(F.col("html").rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")).select("url", F.explode(tags).alias("tag"))
    quoted = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    wait = r"""(?i)\burl\s*=\s*['"]?([^'">]+)"""
    rel = r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
    once = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))  # noqa: E731  (a generator, so that nothing is computed twice)
    href = F.concat(*(F.coalesce(F.regexp_extract(tag, quoted, i), F.lit("")) for i in (1, 2, 3)))
    to = F.when(tag.rlike(r"(?i)^<link\b") & tag.rlike(rel), F.trim(href))
    to = to.when(tag.rlike(r"(?i)^<meta\b") & tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.trim(F.regexp_extract(tag, wait, 1)))
    site, folder = F.regexp_extract("url", r"^((?s:.*?)://[^/?#]*)", 1), F.regexp_extract("url", r"^((?s:.*?)://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    found = once(tagged.where(F.instr("url", "://") > 0), to=to, scheme=F.regexp_extract("url", r"^([^/?#]*?):", 1), site=site, folder=folder).where("to <> ''")
    to, folder = F.col("to"), F.when(F.col("folder").endswith("/"), F.col("folder")).otherwise(F.concat("folder", F.lit("/")))
    full = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat("scheme", F.lit(":"), "to"))
    full = full.when(to.startswith("/"), F.concat("site", "to")).otherwise(F.concat(folder, to))
    whole = once(found.select("url", full.alias("full")), a=url_key(F.col("url")), b=url_key(F.col("full")))
    return whole.select("a", "b").where("a <> b").distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to pages(url, html, ...).

    A page takes the verdict of the longest rule that fits its url. A page that no rule fits takes that of its
    group of aliases, which are the urls that canonical links, refresh redirects and `redirects(a, b)` connect,
    crawled or not: allow if any of them is allowed by a rule, else block if any is blocked, else allow.
    Null urls and urls without :// have an empty host and path, fit no rule and are allowed. Null html has no links.
    Equal urls share their decision; every row returns once."""
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(url_key(F.col("a")), url_key(F.col("b")))).where("a <> b").distinct()
    groups = components(links)
    own = with_rule(groups.withColumnRenamed("node", "url"), rules)
    judged = own.groupBy("component").agg(F.max((F.col("_verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("_verdict") == "block").cast("int")).alias("blocked"))
    verdict = F.when((F.col("blocked") == 1) & (F.coalesce("allowed", F.lit(0)) == 0), "block").otherwise("allow")
    spread = cut(groups.join(judged, "component").where("allowed = 1 or blocked = 1").select(F.col("node").alias("_key"), verdict.alias("_group")))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = with_rule(pages.select("url", F.struct(*kept).alias("_all")), rules).withColumn("_key", url_key(F.col("url"))).join(spread, "_key", "left")
    return out.select("_all.*", "host", "path", "rule", F.coalesce("_verdict", "_group", F.lit("allow")).alias("verdict"))


def op10_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


#: The same in DuckDB for pages whose html names no canonical link and no refresh, as those of the tables: without links a page that no rule fits is allowed.
OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS a FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(a, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(a, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (
  SELECT page_id, host, path, arg_max({'rule': h || s, 'verdict': v}, length(h || s)) FILTER (h IS NOT NULL) AS b
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM f
"""
