"""URL filters over redirect equivalence.

Rules name a host and a path prefix; the longest that fits a URL decides it. Where none fits, the URL's
class decides: pages are joined by redirect and canonical-link edges, connected components of these are
found, and a block of one URL reaches all its aliases; an explicit allow of any alias takes precedence.
DataFrame functions only.

Edges come from the pages (the first canonical link and the first refresh of the HTML) and from any further
edge table, such as `plain_edges`. A URL's node is the URL itself with scheme and host in lower case and
without its fragment; a null URL, and one without `://`, has no node and so no class, and its host and path are
empty. Null HTML gives no edges. Very long URLs are compared whole. Repeated rows and URLs each get a row;
extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import LOWER, UPPER, components, staged

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(host: Column, path: Column) -> Column:
    """Host and path as most sites take them to be the same page."""
    h = F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"^(?:www\.|m\.)+", "")
    p = F.regexp_replace(path, r"/{2,}", "/")
    return F.concat(h, F.regexp_replace(F.regexp_replace(p, r"(?:/index)?(?:\.html?|\.php)?/?$", ""), r"/$", ""))


def node_of(url: Column) -> Column:
    """What edges join: null for a URL without `://`."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?://)", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(scheme != "", F.concat(scheme, host_of(url), rest))


def plain_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) for `judge`, where a site's URLs of one plain form are to count as one page: each URL and the
    least one of its form."""
    url = F.col("url").cast("string")
    rows = pages.where(F.col("url").isNotNull()).select(url.alias("src"), plain(host_of(url), path_of(url)).alias("form")).where("form <> ''").distinct()
    return rows.join(rows.groupBy("form").agg(F.min("src").alias("dst")), "form").where("src <> dst").select("src", "dst")


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; equal lengths: an allow first."""
    out = F.lit(None)
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow"))
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def resolved(base: Column, target: Column) -> Column:
    """target as seen from a page at base; relative ones come without fragment. Null where it
    has a scheme without `//` or is relative and base has no scheme."""
    path, search = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    full = F.when(path.startswith("/"), path).when(path == "", path_of(base)).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    steps = F.split(F.substring(full, 2, 1 << 30), "/")
    # The first place stands for the root, so that `..` at the root stays there.
    walked = F.aggregate(steps, F.array(F.lit("")), lambda got, x: F.when(x == "..", F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(1)))).when(x == ".", got).otherwise(F.concat(got, F.array(x))))
    ends = F.when(full.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    inside = F.when(root != "", F.concat(root, F.concat_ws("/", walked), ends, search))
    return (
        F.when(target.rlike(r"^[^/?#]*://"), target)
        .when(target.startswith("//"), F.when(root != "", F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target)))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(inside)
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs of the pages' own canonical links and refreshes."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    lower = F.translate(html, UPPER, LOWER)
    told = F.when(lower.contains("canonical") | lower.contains("refresh"), F.array(F.regexp_extract(html, CANONICAL, 1), F.regexp_extract(html, REFRESH, 1)))
    return pages.where(F.col("url").isNotNull()).select(F.col("url").cast("string").alias("src"), F.explode(told).alias("dst")).where("dst <> ''").withColumn("dst", resolved(F.col("src"), F.col("dst"))).where("dst like '%://%'")


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, class_id) of every page.

    edges: further redirects (src, dst URLs). class_id is the least node of a URL's component. A class is
    blocked if one of its URLs is blocked by a rule and none is allowed by one; URLs that no rule fits
    take their class's verdict, else allow.
    """
    links = page_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null"))
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumns({"_m": matched(F.col("host"), F.col("path"), rules), "node": node_of(F.col("url"))})
    node = lambda c: node_of(F.col(c))
    told = lambda c: matched(host_of(F.col(c)), path_of(F.col(c)), rules)["verdict"]
    links = staged(links.select(node("src").alias("a"), node("dst").alias("b"), told("src").alias("va"), told("dst").alias("vb")), "links")
    roots = components(links).select("node", "root")
    # One row for each node that a rule decides, then one for each class; both sums are partial first.
    seen = rows.select("node", F.col("_m.verdict").alias("v")).unionByName(links.select(F.col("a").alias("node"), F.col("va").alias("v"))).unionByName(links.select(F.col("b").alias("node"), F.col("vb").alias("v")))
    seen = seen.where("v is not null and node is not null").groupBy("node").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    classes = seen.join(roots, "node", "left").select(F.coalesce("root", "node").alias("class_id"), "allowed", "blocked").groupBy("class_id").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    # Only classes that block can change a verdict.
    blocked = classes.where("blocked and not allowed").select("class_id", F.lit(True).alias("_b"))
    of_node = roots.select("node", F.col("root").alias("class_id")).unionByName(seen.select("node", F.col("node").alias("class_id")).join(roots.select("node"), "node", "left_anti"))
    bad = of_node.join(blocked, "class_id").select("node", "_b")
    out = rows.join(roots, "node", "left").join(bad, "node", "left")
    return out.select("page_id", "url", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce(F.col("_m.verdict"), F.when(F.col("_b"), F.lit("block")), F.lit("allow")).alias("verdict"), F.coalesce("root", "node").alias("class_id"))
