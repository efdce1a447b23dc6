"""Verdicts on urls by rules, and by trust and distrust spread over links between hosts.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.storage import written

#: Verdict, host, path of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or protocol-relative target of a link; the host is group 1.
LINK = r"""(?i:href)\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits. Equally long ones are
    taken in their order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(
            fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def host_edges(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """Links between different hosts, each pair once with its number of links: src, dst, links."""
    targets = F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))
    return (
        pages.filter(F.col(html_col).contains("//") & (F.col(host_col) != ""))
        .select(F.col(host_col).alias("src"), F.explode(targets).alias("dst"))
        .withColumn("dst", F.translate("dst", UPPER, LOWER))
        .filter("src <> dst and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("links"))
    )


def propagate(
    hosts: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float
) -> DataFrame:
    """Personalised PageRank from two seed weights at once: host, seeded, all.

    ``hosts``: host, seed, weight. ``seeded`` starts from ``seed``, ``all`` from ``weight``; both
    follow the same edges (src, dst, links) by their shares of the source's links, and what would
    leave a host without edges ends there. As seeds are at most weights, seeded is at most all.
    Rounds end when the values move by less than ``tolerance`` of their sum, at the latest after
    ``rounds``: by then 1 - damping**rounds of the final value is there.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    shares = written(
        edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")), "links"
    )
    start = hosts.select(
        "host",
        (F.col("seed") * (1 - damping)).alias("seed"),
        (F.col("weight") * (1 - damping)).alias("weight"),
    )
    now = written(start.withColumn("seeded", F.col("seed")).withColumn("all", F.col("weight")), "hosts")
    if shares.isEmpty():
        return now.select("host", "seeded", "all")
    for _ in range(rounds):
        received = (
            shares.join(now.select(F.col("host").alias("src"), "seeded", "all"), "src")
            .groupBy(F.col("dst").alias("host"))
            .agg(
                F.sum(F.col("share") * F.col("seeded")).alias("more_seeded"),
                F.sum(F.col("share") * F.col("all")).alias("more_all"),
            )
        )
        sums = lambda own, more: F.col(own) + damping * F.coalesce(F.col(more), F.lit(0.0))
        moved = now.join(received, "host", "left").select(
            "host",
            "seed",
            "weight",
            sums("seed", "more_seeded").alias("seeded"),
            sums("weight", "more_all").alias("all"),
            F.abs(sums("weight", "more_all") - F.col("all")).alias("change"),
        )
        now = written(moved, "hosts")
        change, whole = now.agg(F.sum("change"), F.sum("all")).first()
        if not change or change <= tolerance * whole:
            break
    return now.select("host", "seeded", "all")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = 0.85,
    rounds: int = 30,
    tolerance: float = 1e-4,
    blocked_share: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Judge every page by the longest fitting rule, else by its host's trust and distrust.

    Hosts are weighted by their pages. Pages that an allow rule fits seed trust, which follows the
    links; pages that a block rule fits seed distrust, which goes against them: who links to
    blocked pages is suspect. Both come as shares of what all pages would bring to the host, so
    they lie in 0 to 1 whatever its size. A page without a rule is blocked if its host's distrust
    reaches ``blocked_share`` and is above its trust.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the
    rule's. Returns ``id_col``, host, path, rule, verdict, trust, distrust. A null url or one
    without ``://`` has an empty host and path, no rule and is allowed; null html has no links.
    Links to hosts without pages lead on only through hosts known. Repeated rows are judged each. An
    empty table gives no rows. Other columns are not read.
    """
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    linked = pages.select(host_of(url).alias("host"), F.col(html_col).alias("html"))
    edges = written(host_edges(linked, "host", "html"), "links")
    is_ = lambda v: F.count_if(F.col("found.verdict") == v).cast("double")
    own = (
        parts.filter("host <> ''")
        .groupBy("host")
        .agg(F.count("*").cast("double").alias("weight"), is_("allow").alias("good"), is_("block").alias("bad"))
    )
    # A host that is only linked to has no pages, but lets trust and distrust through.
    named = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    hosts = written(own.join(named, "host", "full").na.fill(0.0, ["weight", "good", "bad"]), "hosts")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagate(hosts.withColumn("seed", F.col("good")), edges, damping, rounds, tolerance)
    distrust = propagate(hosts.withColumn("seed", F.col("bad")), against, damping, rounds, tolerance)
    share = lambda df, name: df.select(
        F.col("host").alias("of"), F.when(F.col("all") > 0, F.col("seeded") / F.col("all")).otherwise(0.0).alias(name)
    )
    scores = share(trust, "trust").join(share(distrust, "distrust"), "of")
    trust_, distrust_ = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    blocked = (distrust_ >= blocked_share) & (distrust_ > trust_)
    return parts.join(scores, F.col("host") == F.col("of"), "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        trust_.alias("trust"),
        distrust_.alias("distrust"),
    )
