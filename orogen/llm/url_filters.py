"""URL rules, whose block decisions reach aliases: pages linked by redirects and canonical links, told by connected components."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen.llm.common import connected_components, cut, drop

#: The rules as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: An HTML attribute's value: in quotes of either kind or bare.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ALIAS = r"(?is)<link\s[^>]*canonical|<meta\s[^>]*refresh"
_TAG = r"""(?is)<(?:link|meta)\s(?:[^>"']|"[^"]*"|'[^']*')*>"""


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end to the next ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(url: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, null without one: its host is the url's or a domain above it, and the url's path begins with its path. Of equally long ones an allowing one."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host(url) == own_host) | F.endswith(host(url), F.lit("." + own_host))) & F.startswith(path(url), F.lit(slash + own_path))
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def same_page(url: Column) -> Column:
    """What tells pages apart: the url without its fragment, scheme and host in lower case."""
    parts = [F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", i) for i in (1, 2)]
    return F.when(F.length(parts[0]) > 0, F.concat(F.translate(parts[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), parts[1]))


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, r"(?is)[\s\"']" + name + _VALUE, i) for i in (1, 2, 3)))


@F.pandas_udf(T.StringType())
def _resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link seen from the page that holds it; null where it is none."""

    def one(b, x):
        try:
            return urljoin(b, x.strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def page_links(pages: DataFrame) -> DataFrame:
    """from_url, to_url: canonical links (<link rel=canonical href>) and redirects (<meta http-equiv=refresh content="0; url=…">) of pages (url, html), resolved against the page. Comments and scripts hold none."""
    some = pages.where(F.col("html").rlike(_ALIAS) & F.col("url").contains("://")).select(F.col("url").cast("string").alias("from_url"), F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "").alias("html"))
    tags = some.select("from_url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = F.when(_attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)^\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']+)", 1))
    links = tags.select("from_url", F.coalesce(canonical, refresh).alias("link")).where("link <> ''")
    plain = F.col("link")
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&#x2f;", "/"), ("&#47;", "/"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return links.select("from_url", _resolved("from_url", plain).alias("to_url")).where("to_url is not null")


def alias_verdicts(links: DataFrame, rules=RULES) -> DataFrame:
    """page, verdict: for every page (as same_page tells them) that a link joins to a page under a rule, `allow` where a rule allows any page of its component, else `block`.

    Pages are numbered in a written table, so that components are found over numbers and no hash can join what no link joins.
    """
    pairs = links.select(same_page(F.col("from_url")).alias("a"), same_page(F.col("to_url")).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    pairs = cut(pairs, "links")
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("page")).distinct().withColumn("id", F.monotonically_increasing_id()), "pages")
    left, right = nodes.select(F.col("page").alias("a"), F.col("id").alias("u")), nodes.select(F.col("page").alias("b"), F.col("id").alias("v"))
    component = connected_components(pairs.join(left, "a").join(right, "b").select("u", "v"))
    ruled = nodes.join(component, nodes["id"] == component["node"]).select("page", "component", rule_of(F.col("page"), rules)["verdict"].alias("own"))
    judged = ruled.where("own is not null").groupBy("component").agg(F.min("own").alias("verdict"))  # allow is less than block
    out = cut(ruled.select("page", "component").join(judged, "component").select("page", "verdict"), "verdicts")
    drop(pairs)
    drop(nodes)
    return out


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, aliased of every row of pages (page_id, url, html).

    The longest fitting rule decides, so a page that a rule allows stays allowed whatever its aliases are. A page under no rule is blocked where a rule blocks any page that redirects or
    canonical links connect it to (over any number of links in either direction, through pages that are not in the table too) and no rule allows one; else it is allowed. aliased: did its aliases decide.
    redirects: more links (from_url, to_url), such as a crawler's log. Null urls or such without :// have an empty host and path, no rule and no alias, and are allowed; null html holds no links; repeated rows each have a
    row; urls and pages of any length are read whole; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    links = page_links(pages.select("url", F.col("html").cast("string").alias("html")))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    known = alias_verdicts(links, rules).withColumnRenamed("verdict", "by_alias")
    rows = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), rule_of(F.col("url"), rules).alias("own"), same_page(F.col("url")).alias("page"))
    joined = rows.join(known, "page", "left")  # one row a page on the right; pages that stand often on the left are split by size
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "by_alias", F.lit("allow")).alias("verdict"), (F.col("own").isNull() & F.col("by_alias").isNotNull()).alias("aliased"))


_DUCK = """
WITH RECURSIVE u AS (SELECT page_id, url, html, lower(regexp_extract(url, '^(?:[^:]|:[^/]|:/[^/])*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^(?:[^:]|:[^/]|:/[^/])*://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '#.*', '') AS page FROM pages),
rules (verdict, rule, h, p) AS (VALUES {rules}),
hrefs AS (SELECT page AS a, host, unnest(list_concat(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1), regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]+; *url=([^"]*)"', 1))) AS href FROM u),
edges AS (SELECT a, CASE WHEN starts_with(href, '/') THEN regexp_extract(a, '^[^/]*//[^/?#]*') || href ELSE href END AS b FROM hrefs),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
fits AS (SELECT page, rule, r.verdict, row_number() OVER (PARTITION BY page ORDER BY length(rule) DESC) AS n
  FROM (SELECT page, host, path FROM u UNION SELECT b, lower(regexp_extract(b, '://([^/?#]*)', 1)), regexp_extract(b, '://[^/?#]*([^?#]*)', 1) FROM edges) x JOIN rules r ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)),
best AS (SELECT page, rule, verdict FROM fits WHERE n = 1),
alias AS (SELECT r.a AS page, min(verdict) AS verdict FROM reach r JOIN best ON best.page = r.b GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, b.rule AS rule, coalesce(b.verdict, a.verdict, 'allow') AS verdict, b.rule IS NULL AND a.verdict IS NOT NULL AS aliased
FROM u LEFT JOIN best b ON b.page = u.page LEFT JOIN alias a ON a.page = u.page
"""


def oracle_sql() -> str:
    """For urls and links as the given pages have them: absolute or from the root, with lower-case hosts."""
    quoted = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return _DUCK.format(rules=quoted)
