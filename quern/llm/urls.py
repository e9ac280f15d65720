"""URL filters: rules on hosts and paths, carried to aliases over redirect and canonical links.  DataFrame functions only.

Pages name their aliases in their HTML (canonical links and refresh redirects).  Distributed connected components over these
links make classes of equivalent URLs.  A rule that fits a URL itself decides it; otherwise an allowed URL in its class allows
it, otherwise a blocked one blocks it, otherwise it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits, and its verdict; nulls where none does.

    Rules come as a list that the driver holds.  A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _node(url: Column) -> Column:
    """A URL as a node: without scheme and fragment, host lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.nullif(F.concat(host_path(url)[0], rest), F.lit(""))


#: A link tag whose rel list has canonical, and a meta tag that refreshes.
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh["'\s/>]"""


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what leads above the root stays at the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
    joined = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(joined == "", "/").otherwise(joined)).otherwise(path)


def resolve(url: Column, to: Column) -> Column:
    """A link's target as a URL, seen from the page's URL: absolute, ``//host``, ``/path``, ``?query`` and relative forms.

    Fragments alone and other schemes (mailto and such) give null.  A base element is not looked at.
    """
    host, path = host_path(url)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    want, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    near = lambda p: F.concat(F.lit("x://"), host, _plain_path(p), rest)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | to.startswith("#") | (to == "") | (host == ""), F.lit(None).cast("string"))
        .when(to.startswith("/"), near(want))
        .when(to.startswith("?"), F.concat(F.lit("x://"), host, F.when(path == "", "/").otherwise(path), to))
        .otherwise(near(F.concat(folder, want)))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical links and refresh redirects in the HTML of (url, html).

    Comments and scripts don't count.  Targets are resolved against the page's URL.
    """
    html = F.col("html")
    some = pages.filter(F.col("url").isNotNull() & html.rlike(r"""(?i)canonical|http-equiv\s*=\s*["']?refresh"""))
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.regexp_extract_all(clean, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    one = some.select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1))
    to = one.select("url", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("to")).filter("to <> ''")
    return to.select(_node(F.col("url")).alias("src"), _node(resolve(F.col("url"), F.col("to"))).alias("dst")).filter("src is not null and dst is not null")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row.

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed.  Null HTML has no links.
    Repeated pages are judged alike.  No rows give no rows; other columns are ignored.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    of = connected_components(alias_links(p))
    host, path = host_path(F.concat(F.lit("x://"), F.col("node")))
    own = match_rule(host, path, rules)[1]
    told = of.withColumn("own", own).groupBy("component").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
    carried = cut(of.join(told.filter(F.coalesce("allow", F.lit(False)) | F.coalesce("block", F.lit(False))), "component").select("node", F.when(F.col("allow"), "allow").otherwise("block").alias("carried")))
    host, path = host_path(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    out = p.select("page_id", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node")).withColumns({"rule": rule, "own": verdict})
    if carried.isEmpty():
        return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    return out.join(carried, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "carried", F.lit("allow")).alias("verdict"))
