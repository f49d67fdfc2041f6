"""URL filters: rules for hosts and paths, and trust and distrust spread over host links.

A page that a rule fits has the rule's verdict. For the others the host decides: personalised
PageRank spreads trust from hosts whose pages rules allow along the links, and distrust from
hosts whose pages rules block against the links (who links to a blocked host is distrusted).

A host shares its trust among the hosts that it links to. Distrust is not shared: a host takes it
over by the share of its own links that lead to a distrusted host, so it does not matter how
many others link there as well. What rules judge of a host takes over nothing. Both values count
in units of a host whose every page is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged

DAMPING = 0.85
# What all later rounds together can still add to any value when the rounds end.
RESIDUAL = 1e-6
# A host is blocked if its distrust, from 0 to 1, exceeds its trust by more than this.
MARGIN = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    host = F.translate(F.regexp_extract(url, PARTS, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host and path such as ``net/en/``)
    that fits: its host is the host or a parent domain of it, and the path starts with its
    path. Of equally long rules that with the longer host wins. Null where none fits."""
    order = sorted(rules, key=lambda rule: (-len(rule[1]), -rule[1].index("/"), rule[1]))
    rule = verdict = F.lit(None).cast("string")
    for kind, text in reversed(order):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n: links from host to other host in the HTML of ``pages`` (host, html)."""
    found = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("source"), found.alias("target"))
    target = F.translate(F.regexp_replace("target", r"^[^@]*@", ""), _UPPER, _LOWER).alias("target")
    return (
        links.select("source", target).where("target <> '' AND source <> target")
        .groupBy("source", "target").agg(F.count("*").alias("n"))
    )


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """host, trust, distrust, each short of its limit by ``RESIDUAL`` at most.

    ``seeds`` (of every host that links: host, trust, distrust): shares of its pages that rules
    allow and block. ``links``: source, target, n. A round moves only what the round before has
    added, one row per link, with sums combined before the shuffle; joins are left to adaptive
    execution, which splits a host of very many links. An addition is at most ``DAMPING`` times that
    before, in sum for trust and at the greatest for distrust, so the rest of the series is known
    and ends the rounds. State is written to the shared folder; the driver sees two numbers a round.
    """
    free = seeds.select(F.col("host").alias("source"), (1 - F.col("trust") - F.col("distrust")).alias("free"))
    whole = links.groupBy("source").agg(F.sum("n").alias("whole")).join(free, "source")
    parts = links.join(whole, "source").withColumn("share", F.col("n") / F.col("whole") * DAMPING)
    forth = parts.select(F.col("source").alias("host"), F.col("target").alias("to"), F.lit(True).alias("forth"), "share")
    against = parts.select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(False).alias("forth"), F.col("share") * F.col("free"))
    flows = staged(forth.union(against).where("share > 0"), "url-flows")
    judged = seeds.where("trust > 0 OR distrust > 0")
    now = staged(judged.select("host", "trust", "distrust", F.col("trust").alias("new_trust"), F.col("distrust").alias("new_distrust")), "url-seeds")
    while True:
        left = now.agg(F.sum("new_trust").alias("trust"), F.max("new_distrust").alias("distrust")).first()
        if max(left.trust or 0.0, left.distrust or 0.0) * DAMPING / (1 - DAMPING) <= RESIDUAL:
            break
        moved = flows.join(now.where("new_trust > 0 OR new_distrust > 0"), "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.when(F.col("forth"), F.col("new_trust") * F.col("share")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(~F.col("forth"), F.col("new_distrust") * F.col("share")).otherwise(0.0)).alias("distrust"),
        )
        added = moved.select("host", "trust", "distrust", F.col("trust").alias("new_trust"), F.col("distrust").alias("new_distrust"))
        kept = now.select("host", "trust", "distrust", F.lit(0.0).alias("new_trust"), F.lit(0.0).alias("new_distrust"))
        sums = [F.sum(name).alias(name) for name in ("trust", "distrust", "new_trust", "new_distrust")]
        after = staged(kept.union(added).groupBy("host").agg(*sums), "url-round")
        drop_staged(now)
        now = after
    drop_staged(flows)
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict (``allow`` or ``block``) of every row of ``pages``
    (page_id, url, html; other columns are ignored).

    A host's seeds are the shares of its pages that rules allow and block. A page that no rule
    fits is blocked if the distrust of its host exceeds the trust by more than ``MARGIN``, else
    allowed; so are pages without a host. A host is what stands in the url, so one with ``user@``
    is another than that without; links are followed without it. Null HTML has no links. Repeated
    rows stay, and count as pages. No rows give no rows.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    allowed, blocked = (F.avg(F.when(F.col("verdict") == kind, 1.0).otherwise(0.0)) for kind in ("allow", "block"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(allowed.alias("trust"), blocked.alias("distrust"))
    links = staged(host_links(parsed.select("host", "html")), "url-links")
    scores = propagate(seeds, links)
    bad = scores.where(F.col("distrust") - F.col("trust") > MARGIN + RESIDUAL).select(F.col("host").alias("bad_host"))
    joined = ruled.join(bad, ruled["host"] == bad["bad_host"], "left")
    by_host = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"))
