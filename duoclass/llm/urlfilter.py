"""URL filter with redirect equivalence.

Urls joined by canonical links, meta refreshes or given redirects are aliases of one
resource.  Connected components over those edges carry a decision about one url to all
its aliases; within a component an allow rule beats a block rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoclass.llm.common import cut, prepare
from duoclass.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, start of the path, verdict) of the registered query
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.when(url.isNotNull() & (at > 0), F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains, where the path starts with the rule's.  Of
    fitting rules with equal length an allow wins, then the first in order.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1]))
    for h, p, v in reversed(best):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted either way or bare."""
    one = [F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{p}", 1) for p in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in one])


def resolve(base: Column, target: Column) -> Column:
    """A link's target as an absolute url; null where it is empty, a fragment, of a scheme
    without ``//``, or the base is no absolute url.

    Targets may be absolute, begin with ``//`` (the page's scheme), ``/`` (its host) or ``?``
    (its path), or else lie beside the page; ``.`` and ``..`` parts of these are worked off.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    beside = F.concat(F.regexp_extract(path, r"^(.*/)", 1), target)
    full = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.when(F.startswith(beside, F.lit("/")), beside).otherwise(F.concat(F.lit("/"), beside)))
    way, rest = F.regexp_extract(full, r"^([^?#]*)", 1), F.regexp_extract(full, r"^[^?#]*(.*)$", 1)
    parts = F.split(way, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"),
                       lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
                       .otherwise(F.concat(a, F.array(x))))
    # "a/." and "a/.." name folders
    slash = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(origin, F.array_join(kept, "/"), slash, rest)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when((scheme == "") | (target == "") | F.startswith(target, F.lit("#")) | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
            .when(F.startswith(target, F.lit("?")), F.concat(origin, path, target))
            .otherwise(plain))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): each page's canonical links and meta refreshes, as absolute urls."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    t = pages.select(F.col(url_col).alias("src"), F.explode(tags).alias("tag"))
    canonical = F.when(F.lower(_attribute(F.col("tag"), "rel")) == "canonical", _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh",
                     F.nullif(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*['\"]?([^'\"\s]+)", 1), F.lit("")))
    target = F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&"))
    return t.select("src", target.alias("target")).where("target IS NOT NULL AND src IS NOT NULL").select(
        "src", resolve(F.col("src"), F.col("target")).alias("dst")).where("dst IS NOT NULL")


def _node(url: Column) -> Column:
    """One name for spellings of a url that differ in the host's case or the fragment."""
    return F.concat(url_host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame, url_col: str = "url") -> DataFrame:
    """All rows and columns of ``df`` with ``host``, ``path``, ``rule``, ``verdict``.

    ``edges`` is (src, dst) urls.  A url that a rule fits gets the rule's verdict.  Any
    other is allowed if an alias is allowed by a rule, blocked if an alias is blocked,
    and else allowed.  A null url, or one without ``://``, has an empty host and path,
    no alias and no rule.  Rows that repeat are judged each; urls of any length are read
    whole.  Columns of ``df`` with the four names are replaced.
    """
    prepare(df.sparkSession)
    u = F.col(url_col)
    host, path = url_host(u), url_path(u)
    name, verdict = rule_of(host, path, rules)
    # aliases: only urls that have an edge take part, and only they meet in the join below
    e = cut(edges.select(_node(F.col("src")).alias("u"), F.col("src"), _node(F.col("dst")).alias("v"), F.col("dst")), "url-edges")
    parts = connected_components(e.select("u", "v").where("u <> '' AND v <> ''"))
    ends = e.select(F.col("u").alias("node"), F.col("src").alias("url")).union(e.select("v", "dst"))
    decided = ends.select("node", rule_of(url_host(F.col("url")), url_path(F.col("url")), rules)[1].alias("d")).where("d IS NOT NULL")
    group = (parts.join(decided.distinct(), "node").groupBy("component")
             .agg(F.when(F.max(F.col("d") == "allow"), "allow").otherwise("block").alias("alias_verdict")))
    tag = uuid.uuid4().hex[:8]
    own, other, decision = f"_node_{tag}", f"_alias_{tag}", f"_verdict_{tag}"
    alias = parts.join(group, "component").select(F.col("node").alias(other), F.col("alias_verdict").alias(decision))
    base = df.drop("host", "path", "rule", "verdict") if url_col not in ("host", "path", "rule", "verdict") else df
    named = base.withColumn(own, F.when(u.contains("://"), _node(u)))
    new = [host.alias("host"), path.alias("path"), name.alias("rule"), F.coalesce(verdict, F.col(decision), F.lit("allow")).alias("verdict")]
    kept = [c for c in base.columns if c not in ("host", "path", "rule", "verdict")]
    # urls that are none take no part in the join
    joined = named.where(F.col(own).isNotNull()).join(alias, F.col(own) == F.col(other), "left")
    alone = named.where(F.col(own).isNull()).withColumn(decision, F.lit(None).cast("string"))
    return joined.select(*kept, *new).unionByName(alone.select(*kept, *new))
