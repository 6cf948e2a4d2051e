"""URL filter rules with redirect equivalence, as DataFrame expressions only.

A rule (action, host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's
path; the longest rule wins (host and path together, an allow before a block of the same length). Urls joined by a
canonical link or an immediate refresh are one resource: connected components over these edges carry decisions to
aliases that no rule fits. There an explicit allow takes precedence: a component with an allowed member is allowed, else
one with a blocked member is blocked, else the default (allow) holds. A url that a rule fits keeps that rule's verdict.

Rules are compiled into the plan up to ``COMPILED`` of them; longer lists are joined on the host and its parent domains.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has no aliases; null html has
no links; relative targets are resolved against the page's host; repeated pages are judged row by row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import checkpoint
from sparsewing.llm.graph import components

COMPILED = 64
#: The rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    has = F.locate("://", url) > 0
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``action`` and ``rule`` (null where none fits) to a frame with ``host`` and ``path``."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow", r[1], r[2]))
    if len(ranked) <= COMPILED:
        action, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
        for a, h, p in reversed(ranked):
            fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
            action, rule = F.when(fits, F.lit(a)).otherwise(action), F.when(fits, F.lit(h + p)).otherwise(rule)
        return df.withColumns({"action": action, "rule": rule})
    r = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("a"), F.lit(h).alias("h"), F.lit(p).alias("p")) for i, (a, h, p) in enumerate(ranked)])))
    keys = df.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    up = keys.withColumn("h", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    best = up.join(r, "h").filter(F.col("path").startswith(F.col("p"))).groupBy("host", "path").agg(F.min(F.struct("pos", "a", "h", "p")).alias("x"))
    best = best.select("host", "path", F.col("x.a").alias("action"), F.concat("x.h", "x.p").alias("rule"))
    return df.join(best, ["host", "path"], "left")


def _attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]*)""", 1)


def _edges(pages: DataFrame) -> DataFrame:
    """(u, v): node of a page and node of the url that its canonical link or refresh names."""
    low = F.lower(F.coalesce("html", F.lit("")))
    canon = F.when(low.contains("canonical"), F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0))
    fresh = F.when(low.contains("refresh"), F.regexp_extract("html", r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*>""", 0))
    to = F.array(_attr(canon, "href"), F.regexp_extract(fresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))
    e = pages.select("host", "path", "node", F.explode(F.filter(to, lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)).alias("to"))
    e = e.withColumn("to", F.when(F.col("to").contains("://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).when(F.col("to").startswith("/"), F.concat(F.lit("http://"), "host", "to")).otherwise(F.concat(F.lit("http://"), "host", F.regexp_extract("path", r"^(.*/)?", 0), "to")))
    h, p = host_path(F.col("to"))
    e = e.withColumns({"th": h, "tp": p})
    return e.select(F.col("node").alias("u"), F.concat("th", _page_path(F.col("tp")), _query(F.col("to"))).alias("v"))


def _page_path(p: Column) -> Column:
    return F.when(p == "", "/").otherwise(p)


def _query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*(\?[^#]*)?", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url, html, ...) to (page_id, host, path, rule, verdict)."""
    h, p = host_path(F.col("url"))
    pages = pages.select("page_id", "url", "html").withColumns({"host": h, "path": p})
    node = F.when(F.col("host") != "", F.concat("host", _page_path(F.col("path")), _query(F.col("url"))))
    pages = pages.withColumn("node", node)
    edges = checkpoint(_edges(pages.filter("node is not null")))
    out = with_rule(pages.select("page_id", "host", "path", "node"), rules)
    if not edges.isEmpty():
        comp = components(edges)
        at = comp.withColumns({"host": F.regexp_extract("node", r"^[^/?#]*", 0), "path": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)})
        said = with_rule(at, rules).groupBy("component").agg(F.max(F.col("action") == "allow").alias("a"), F.max(F.col("action") == "block").alias("b"))
        said = comp.join(said, "component").select("node", F.when(F.col("a"), "allow").when(F.col("b"), "block").alias("alias"))
        out = out.join(said, "node", "left")
    else:
        out = out.withColumn("alias", F.lit(None).cast("string"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "alias", F.lit(default)).alias("verdict"))
