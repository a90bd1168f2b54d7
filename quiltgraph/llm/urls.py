"""Allow and block rules for URLs, carried to aliases over redirect and canonical-link edges.

A page that no rule fits takes the decision of its equivalence class: the connected component over the edges that pages
state in ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``. Within a class an explicit allow of any member wins,
then a block; a class without a rule is allowed. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, salted_join
from quiltgraph.llm.components import SALTS, connected

#: (verdict, host, start of the path)
Rule = tuple[str, str, str]
_CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_TARGET = r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>;]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null when none fits."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        made = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _plain(url: Column) -> Column:
    """The form under which two spellings are one node: no scheme, no fragment, host in lower case."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(F.lit("://"), host_of(url), path_of(url), query)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between node names: a page and each address that it names as its redirect target or canonical form.

    Absolute addresses, ``//host/...`` and ``/path`` are understood; others are no edges.
    """
    stated = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).filter(
        F.instr("u", "://").cast("boolean") & F.col("h").rlike("(?i)canonical|refresh"))
    tags = stated.select("u", F.explode(F.concat(
        F.transform(F.regexp_extract_all("h", F.lit(_CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all("h", F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _TARGET, 1)),
    )).alias("t")).withColumn("t", F.replace("t", F.lit("&amp;"), F.lit("&")))
    target = (
        F.when(F.col("t").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("t"))
        .when(F.col("t").startswith("//"), F.concat(F.lit("http:"), "t"))
        .when(F.col("t").startswith("/"), F.concat(F.lit("http://"), host_of(F.col("u")), "t"))
    )
    return tags.select(_plain(F.col("u")).alias("a"), _plain(target).alias("b")).filter("b is not null and a != b").distinct()


def decide(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per page: ``key``, host, path, rule (null when none fits), verdict (allow or block).

    A null url, or one without ``://``, has an empty host and path, fits no rule and has no aliases. A null html states no
    edges. Pages with equal urls get equal verdicts; repeated rows stay. Other columns are not read.
    """
    classes = connected(links(pages, url, html))
    node = F.col("node")
    own = matched(host_of(node), path_of(node), rules).getField("verdict")
    decided = classes.groupBy("component").agg(
        F.max(own == "allow").alias("allowed"), F.max(own == "block").alias("blocked"))
    verdicts = salted_join(classes, decided, ["component"], SALTS).filter("blocked and not coalesce(allowed, false)")
    blocked = cut_lineage(verdicts.select("node", F.lit(True).alias("blocked")))
    address = F.col("u")
    parts = pages.select(F.col(key), F.col(url).alias("u")).select(
        key, _plain(address).alias("node"), host_of(address).alias("host"), path_of(address).alias("path"))
    rule = matched(F.col("host"), F.col("path"), rules)
    found = salted_join(parts, blocked, ["node"], SALTS, "left").withColumn("_rule", rule)
    return found.select(
        key, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"))
