"""URL filters: rules by host and path, and for the rest trust and distrust that flow along links between hosts.

A rule is for a host and all its subdomains, for paths that begin with its own; of the rules that fit a url
the longest (host and path together) decides, of equally long ones a block. Where none fits, the host does.

The graph has a node for each host and an edge for each pair of hosts of which one's pages link to the
other (``href`` of ``a`` and ``area``), or name it in full, if the table has pages of that one; what stands in comments,
scripts and styles is left out. An edge's weight is the number of those pages; a host has none to itself. Trust
starts at hosts of which rules allow pages, with the allowed share of the pages that rules judge, and flows along the
edges; distrust starts with the blocked share and flows against them, from a host to those that link to it. Both are
personalised PageRanks: at each step a host passes on ``DAMPING`` of what it got, by weight, and what a host without
edges would pass on is lost, which leaves the ranking as it is. There are as many steps as it takes until what is still to
come is less than ``TOLERANCE`` of what was started, so no host's score is off by more. A host is blocked if
distrust is more than ``THRESHOLD`` of its trust and distrust together; hosts that neither reaches get ``UNKNOWN``.

Everything is DataFrame expressions. The html is read once; links are counted with partial sums before
they are moved; edges, shares and each step's flow are tables in the shared folder, so joins by a host that
very many others link to, or that links to very many, can be split. Only what no rule judges is joined with the hosts.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets ``UNKNOWN``;
a null html has no links; links that name no host (``//``, ``mailto:``, paths) lead nowhere else; rows of one
id are judged each by itself, as are null ids; without rules or links no step is made; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.7
TOLERANCE = 0.01
THRESHOLD = 0.5
UNKNOWN = "allow"

# Unclosed ones reach to the end, so nothing is looked at twice.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_LINK = r"""(?is)<(?:a|area)\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""
_NAMED = r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the rule that decides; null if none fits."""
    found: Column | None = None
    for verdict, own, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        says = F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, says) if found is None else found.when(fits, says)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def judged_by_rules(pages: DataFrame, rules: tuple = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` as page_id, host, path, rule, verdict (null without a rule)."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return parts.withColumn("x", best_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "x.rule", "x.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): the number of pages of a host that link to another one, or name it. ``pages``: url, html."""
    shown = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), _HIDDEN, " ")
    linked = F.transform(F.regexp_extract_all("shown", F.lit(_LINK), F.lit(1)), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))
    named = F.transform(F.regexp_extract_all("shown", F.lit(_NAMED), F.lit(0)), lambda x: F.translate(x, _UPPER, _LOWER))
    both = let(linked, lambda links: F.transform(F.array_union(links, named), lambda x: F.struct(x.alias("dst"), F.array_contains(links, x).alias("linked"))))
    # an outer explode, and hosts compared once they are rows: else Spark would read the html twice, for a test below the generator
    rows = pages.select(host_of(F.col("url")).alias("src"), shown.alias("shown")).select("src", F.explode_outer(both).alias("x")).select("src", "x.dst", "x.linked")
    pairs = rows.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if("linked").alias("links"))
    known = pages.select(host_of(F.col("url")).alias("dst")).distinct().withColumn("known", F.lit(True))
    return pairs.join(known, "dst", "left").select("src", "dst", F.when(F.col("known"), F.col("n")).otherwise(F.col("links")).alias("n")).filter("n > 0")


def walks(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, at, to, share): what a host passes on to each other one, of trust along the links and of distrust against them."""
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    totals = scratch.keep("totals", ways.groupBy("kind", "at").agg(F.sum("n").alias("total")))
    return scratch.keep("walks", ways.join(totals, ["kind", "at"]).select("kind", "at", "to", (F.col("n") / F.col("total")).alias("share")))


def steps_for(damping: float, tolerance: float) -> int:
    """Steps after which less than ``tolerance`` of what was started is still to come: it shrinks by ``damping`` at each."""
    return max(1, math.ceil(math.log(tolerance * (1 - damping) / damping) / math.log(damping)))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of the hosts that either reaches. ``edges``: src, dst, n. ``seeds``: host, trust, distrust, where both start."""
    scratch = Scratch(edges.sparkSession, "links")
    ways = walks(edges, scratch)
    start = seeds.select("host", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.col(k).cast("double")) for k in ("trust", "distrust")]))).alias("kind", "mass"))
    flow = scratch.keep("flow0", start.filter("mass > 0").select("kind", "host", "mass"))
    steps = [flow]
    for _ in range(steps_for(damping, tolerance)):
        passed = flow.select("kind", F.col("host").alias("at"), "mass").join(ways, ["kind", "at"])
        flow = scratch.keep(f"flow{len(steps)}", passed.groupBy("kind", F.col("to").alias("host")).agg((F.lit(damping) * F.sum(F.col("mass") * F.col("share"))).alias("mass")))
        steps.append(flow)
        if not flow.limit(1).count():
            break
    every = steps[0]
    for flow in steps[1:]:
        every = every.union(flow)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    scores = scratch.keep("scores", every.groupBy("host").agg(part("trust"), part("distrust")))
    scratch.drop("totals", "walks", *(f"flow{k}" for k in range(len(steps))))
    return scores


def by_host(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, host_verdict)."""
    worse = F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))
    return scores.select("host", F.when(worse, "block").otherwise("allow").alias("host_verdict"))


def judge(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, unknown: str = UNKNOWN) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    said = judged_by_rules(pages, rules)
    seen = said.filter("rule IS NOT NULL").groupBy("host").agg(F.avg((F.col("verdict") == "allow").cast("double")).alias("trust"))
    seeds = scratch.keep("seeds", seen.select("host", "trust", (1 - F.col("trust")).alias("distrust")))
    edges = scratch.keep("edges", host_links(pages.select("url", "html")))
    verdicts = by_host(propagate(edges, seeds, damping, tolerance), threshold)
    scratch.drop("seeds", "edges")
    rest = said.filter("rule IS NULL").join(verdicts, "host", "left")
    by_graph = rest.select("page_id", "host", "path", "rule", F.coalesce("host_verdict", F.lit(unknown)).alias("verdict"))
    return said.filter("rule IS NOT NULL").unionByName(by_graph)


SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(own, start, says) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hosts AS (SELECT DISTINCT host, path FROM parts
), fitting AS (
  SELECT host, path, own || start AS rule, says, row_number() OVER (PARTITION BY host, path ORDER BY length(own || start) DESC, says DESC) AS at
  FROM hosts JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)
), said AS (SELECT p.page_id, p.host, p.path, p.html, f.rule, f.says FROM parts p LEFT JOIN fitting f ON f.at = 1 AND p.host = f.host AND p.path = f.path
), shown AS (
  SELECT host, regexp_replace(coalesce(html, ''), '<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', ' ', 'gis') AS t FROM parts
), found AS (
  SELECT host AS src, [translate(regexp_extract(CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR u IN
           regexp_extract_all(t, '(?is)<(?:a|area)\s(?:[^<>]*?\s)?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''<>]*)', 1)] AS links,
         [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN regexp_extract_all(t, '(?:^|[^A-Za-z0-9.-])([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1)] AS named
  FROM shown
), edges AS (
  SELECT src, dst, count_if(dst IN (SELECT host FROM hosts) OR linked) AS n
  FROM (SELECT src, dst, list_contains(links, dst) AS linked FROM (SELECT src, links, unnest(list_distinct(links || named)) AS dst FROM found)) WHERE src <> '' AND dst <> '' AND src <> dst
  GROUP BY src, dst HAVING count_if(dst IN (SELECT host FROM hosts) OR linked) > 0
), ways AS (
  SELECT 'trust' AS kind, src AS at, dst AS goes, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), seeds AS (SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END) AS trust FROM said WHERE rule IS NOT NULL GROUP BY host
), flow(step, kind, host, mass) AS (
  SELECT * FROM (SELECT 0 AS step, 'trust' AS kind, host, CAST(trust AS DOUBLE) AS mass FROM seeds UNION ALL SELECT 0, 'distrust', host, CAST(1 - trust AS DOUBLE) FROM seeds) WHERE mass > 0
  UNION ALL
  SELECT step + 1, w.kind, w.goes, 0.7 * sum(mass * share) FROM flow f JOIN ways w ON f.kind = w.kind AND f.host = w.at WHERE step < 16 GROUP BY step, w.kind, w.goes
), scores AS (
  SELECT host, sum(mass) AS total, coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM flow GROUP BY host
)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.says, CASE WHEN x.distrust > 0.5 * x.total THEN 'block' ELSE 'allow' END) AS verdict
FROM said s LEFT JOIN scores x ON s.host = x.host
"""
