"""URL rules that also reach the aliases of a page.

Redirects and canonical links say that two URLs are one page. The connected components over
these links carry a block from any URL of a component to all others; a URL that a rule allows
by name stays allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, stored, table
from .graph import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    """``verdict`` (allow or block) for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. Allow wins between equals.

    The rules become one expression, which suits a policy of up to a few hundred rules.
    """
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _absolute(href: Column, url: Column) -> Column:
    """A link as an absolute URL without its fragment; null if it is empty."""
    href = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme = F.regexp_extract(url, r"^([^:/?#]+):", 1)
    site = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.length(href) == 0, F.lit(None))
        .when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: canonical links and immediate redirects that pages declare in their HTML."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    declared = F.filter(tags, lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b|http-equiv\s*=\s*["']?refresh\b"""))
    target = r"""(?is)(?:\bhref\s*=\s*["']?|\burl\s*=\s*["']?)([^"'\s>]*)"""
    found = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(
        F.col(url).alias("a"), F.explode(declared).alias("tag")
    )
    link = _absolute(F.regexp_extract("tag", target, 1), F.col("a"))
    return found.select("a", link.alias("b")).where("b is not null")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_column: str = "page_id",
    url: str = "url",
    html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``pages``: ``id, host, path, rule, verdict``.

    ``redirects`` (``a, b``) adds links that are known from elsewhere, such as a crawl log; URLs
    that are only linked to are judged as well and pass a block on. The verdict is the rule's; without one it
    is block if any alias is blocked by a rule, else allow. URLs are one alias if equal up to their fragment.

    A null URL, or one without ``://``, has empty host and path, no aliases, and is allowed.
    Repeated rows are judged alike. No pages give no rows; other columns are not read.
    """
    seen = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"))
    links = page_links(pages, url, html)
    links = links if redirects is None else links.unionByName(redirects.select("a", "b"))
    whole = [F.regexp_replace(c, "#.*$", "").alias(c) for c in ("a", "b")]
    links = stored(links.select(*whole).where("a <> b").distinct(), "url-links")
    judged = seen.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    judged = judged.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    if not links.isEmpty():
        nodes = components(links, "a", "b")
        _, node_verdict = matched(host_of(F.col("node")), path_of(F.col("node")), rules)
        nodes = stored(nodes.withColumn("blocked", F.coalesce(node_verdict == "block", F.lit(False))), "url-nodes")
        hit = nodes.groupBy("component").agg(F.max("blocked").alias("hit"), F.count(F.lit(1)).alias("n"))
        hit = stored(hit.where("hit"), "url-hit")
        blocked = salted_join(nodes.select("node", "component"), hit, ["component"], "n", ["node"]).select("node", "hit")
        judged = judged.withColumn("node", F.regexp_replace("url", "#.*$", ""))
        counts = judged.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        groups = stored(counts.join(blocked, "node"), "url-blocked")
        judged = salted_join(judged, groups, ["node"], "n", ["id"], "left")
        judged = judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("hit"), F.lit("block"))))
    return judged.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


#: The policy of the registered query.
POLICY = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), POLICY).withColumnRenamed("id", "page_id")


QUERIES = {"op8_url_filters": op8}

_RULES = ",\n    ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in POLICY)

# Pages without links between them, as in the tables at hand: the verdict is then the rule's, else allow.
ORACLE = {
    "op8_url_filters": f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES
    {_RULES}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT page_id, host, path, max(struct_pack(l := length(rule_host || rule_path), r := rule_host || rule_path, v := verdict))
    FILTER (WHERE rule_host IS NOT NULL) AS b
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM best"""
}
