"""URL filters: list rules, and block decisions that reach all aliases of a page.

Redirects (``http-equiv=refresh``, or a given edge table) and canonical links
(``rel=canonical``) join pages into classes by distributed connected components.
A page that a rule fits gets the rule's verdict; among the rest, a class with an
explicitly allowed member is allowed, else a class with a blocked member is
blocked, else the page is allowed.

A page's name in the graph is its host, path and query, so pages that differ in
the query are different pages.  Every canonical and refresh link of a page
counts; ``&amp;`` in it is read as ``&``; a relative link starts at the page's
directory, one that begins with ``/`` at the host's root and one with ``?`` at the
page's own path; dot segments stay as they are; a link to a place in the page
itself joins nothing.  Only pages of the table have a say in their class.

A null url, or one without ``://``, has an empty host and path, belongs to no
class and is allowed.  Null HTML has no links.  Rows that repeat are judged each;
pages with the same host, path and query are one node.  Other columns are not
read.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import look_up
from chronolith.operators.components import connected_components
from chronolith.storage import written

RULES_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
#: Above this many rules, the rule table is shuffled instead of broadcast.
BROADCAST_RULES = 100_000

#: Tags that may hold an alias, what marks them, and the attribute with the link.  Nothing is tried twice: blanks are possessive.
ALIAS_TAGS = (
    (r"(?is)<link\b[^>]*+>", r"""(?is)\brel\s*+=\s*+("[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)""", r"""(?is)\bhref\s*+=\s*+["']?\s*+([^"'\s>]+)"""),
    (r"(?is)<meta\b[^>]*+>", r"""(?is)\bhttp-equiv\s*+=\s*+["']?refresh\b""", r"""(?is)\burl\s*+=\s*+["']?\s*+([^"'\s>]+)"""),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """Path and query, without what follows ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A page's name in the alias graph: host, path and query; null for a url without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, rest_of(url)))


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (key, host, path) with the longest fitting rule and its verdict.

    Rules meet a page by equality with one of the host's suffixes.  Of equally
    long rules, an allow goes first.  ``pages`` is read twice, and a host and path
    may be those of any share of them.
    """
    key = [c for c in pages.columns if c not in ("host", "path")]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tails = pages.select(*key, "host", "path", F.explode(suffixes).alias("rule_host"))
    listed = rules.dropDuplicates()
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    fits = tails.join(listed, "rule_host").where(F.expr("startswith(path, rule_path)"))
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("n"), (F.col("rule_verdict") == "allow").alias("a"), name.alias("rule"), F.col("rule_verdict").alias("rule_verdict"))).alias("best")
    found = fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.rule_verdict")
    return look_up(pages, found, ["host", "path"])


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` nodes of the canonical links and redirects in the HTML of ``pages`` (url, html)."""

    def links(tag: str, mark: str, attribute: str) -> Column:
        tags = F.filter(F.regexp_extract_all(closed, F.lit(tag), F.lit(0)), lambda t: t.rlike(mark))
        return F.transform(tags, lambda t: F.replace(F.regexp_extract(t, attribute, 1), F.lit("&amp;"), F.lit("&")))

    # behind the last > no tag ends, and each that begins there would be followed to the end of the page
    closed = F.left("html", F.length("html") - F.length(F.substring_index("html", ">", -1)))
    hints = F.col("html").rlike(r"(?i)canonical|http-equiv\s*+=\s*+[\"']?refresh")
    url, link = F.col("url"), F.col("link")
    each = pages.where(hints & node_of(url).isNotNull()).select("url", node_of(url).alias("src"), F.explode(F.concat(*[links(*a) for a in ALIAS_TAGS])).alias("link")).where((link != "") & ~link.startswith("#"))
    here, path = F.concat(F.lit("x://"), host_of(url)), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    full = F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(F.lit("x:"), link)).when(link.startswith("/"), F.concat(here, link)).when(link.startswith("?"), F.concat(here, path, link)).otherwise(F.concat(here, folder, link))
    return each.select("src", node_of(full).alias("dst")).where("dst is not null and src <> dst").distinct()


def alias_classes(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node with an alias; a class is named by its smallest node.

    The graph runs over 64-bit hashes of the names.  The names are read once to
    see that no two share a hash; should two do, it runs over the names.
    """
    edges = written(edges, "alias-edges")
    names = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.xxhash64("node")), "alias-names")
    if not names.groupBy("id").count().where("count > 1").isEmpty():
        return connected_components(edges)
    found = connected_components(edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")))
    named = names.join(found, names["id"] == found["node"]).select(names["node"], F.col("component").alias("number"))
    least = named.groupBy("number").agg(F.min("node").alias("component"))
    return named.join(least, "number").select("node", "component")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)`` of every row of ``pages`` (page_id, url, html).

    ``redirects`` may hold further ``(src, dst)`` urls.  ``component`` names the
    alias class by its smallest node, null for a page without aliases.
    """
    spread = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        ends = [node_of(F.col(c)).alias(c) for c in ("src", "dst")]
        edges = edges.unionByName(redirects.select(*ends).where("src is not null and dst is not null and src <> dst"))
    classes = written(alias_classes(edges), "aliases")
    ruled = written(with_rules(written(spread, "urls"), rules), "ruled-urls")
    named = look_up(ruled.where("node is not null"), classes, ["node"]).unionByName(ruled.where("node is null").withColumn("component", F.lit(None).cast("string")))
    votes = named.where("component is not null and rule is not null").groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "allow").alias("any_allow"), F.bool_or(F.col("rule_verdict") == "block").alias("any_block"))
    # pages without aliases have no class and are not joined: they would be one key with most rows
    alone = named.where("component is null").withColumns({"any_allow": F.lit(None).cast("boolean"), "any_block": F.lit(None).cast("boolean")})
    judged = named.where("component is not null").join(votes, "component", "left").unionByName(alone)
    of_class = F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", of_class).alias("verdict"), "component")
