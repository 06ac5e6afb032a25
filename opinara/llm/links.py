"""URL verdicts: listed rules first, then trust and distrust spread over the host graph.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and follows
links backwards, to those who point there. Both are personalised PageRank on host edges counted from the pages, walked
until no score changes any more by a relative ``TOLERANCE``; scores within a relative ``TIE`` are equal.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; a null
html has no links; pages of one url are judged alike, row by row; hosts that no seed reaches are allowed; an empty
table gives an empty result; a link to the page's own host is no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import measured

ALLOW, BLOCK = "allow", "block"
# --- fixed values: (host, path, verdict) -----------------------------------------------------------------
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
# ---------------------------------------------------------------------------------------------------------
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
DAMPING, STEPS_PER_CUT = 0.85, 5
#: A walk has settled when no host's score grows by more than this share of itself in a step.
TOLERANCE = 1e-12
#: Distrust exceeds trust only by more than this share of it, so that the order of additions decides nothing.
TIE = 1e-9
#: A host is blocked when its distrust exceeds this many times its trust.
RATIO = 1.0


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host_of: Column, path_of: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. One branch per rule: meant for lists of rules, not
    for tables of them."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(longest):
        fits = ((host_of == name) | host_of.endswith(f".{name}")) & path_of.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def placed(pages: DataFrame, url: str, rules) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``_listed``."""
    rows = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    rows = rows.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rows = rows.withColumn("_m", matched(F.col("host"), F.col("path"), rules))
    return rows.withColumns({"rule": F.col("_m.rule"), "_listed": F.col("_m.verdict")}).drop("_m")


def host_edges(rows: DataFrame, html: str) -> DataFrame:
    """Links between different hosts: (src, dst, n), counted before the shuffle."""
    targets = F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))
    links = rows.select(F.col("host").alias("src"), F.explode_outer(targets).alias("_t")).where(F.col("_t").isNotNull())
    links = links.select("src", F.translate("_t", UPPER, LOWER).alias("dst"))
    return links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank. ``edges``: (walk, a, b, share), ``seeds``: (walk, host, mass); gives (walk, host, score).

    Hosts without mass have no row. Mass at a host without links leaves the walk. A score is the sum of the mass that
    arrives in each step, so it only grows; the walk ends when no host's last arrival exceeds ``tolerance`` times its
    score, which a host reached just now always does. Every step is one join on the sending host and one sum that
    combines before the shuffle.
    """
    start = F.col("mass") * (1 - damping)
    now = seeds.select("walk", "host", start.alias("score"), start.alias("new"))
    while True:
        for _ in range(STEPS_PER_CUT):
            on = (F.col("e.walk") == F.col("r.walk")) & (F.col("e.a") == F.col("r.host"))
            moved = F.col("r.new") * F.col("e.share") * damping
            sent = edges.alias("e").join(now.where(F.col("new") > 0).alias("r"), on).select(
                F.col("e.walk").alias("walk"), F.col("e.b").alias("host"), moved.alias("score"), moved.alias("new")
            )
            now = now.withColumn("new", F.lit(0.0)).unionByName(sent).groupBy("walk", "host").agg(
                F.sum("score").alias("score"), F.sum("new").alias("new")
            )
        now = measured(now, "ranks")
        if not now.where(F.col("new") > tolerance * F.col("score")).take(1):
            return now.select("walk", "host", "score")


def host_scores(edges: DataFrame, hosts: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Per host with any mass: ``trust`` and ``distrust``. ``hosts``: (host, n_allow, n_block)."""
    edges = measured(edges, "edges")
    hosts = measured(hosts, "hosts")
    totals = hosts.agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).first()
    seeds = None
    for walk, column, total in (("trust", "n_allow", totals["a"]), ("distrust", "n_block", totals["b"])):
        if total:
            part = hosts.where(F.col(column) > 0).select(F.lit(walk).alias("walk"), "host", (F.col(column) / F.lit(total)).alias("mass"))
            seeds = part if seeds is None else seeds.unionByName(part)
    if seeds is None:
        return hosts.limit(0).select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))

    def shares(walk: str, a: str, b: str) -> DataFrame:
        sums = edges.groupBy(F.col(a).alias("a")).agg(F.sum("n").alias("total"))
        return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), "n").join(sums, "a").select(
            F.lit(walk).alias("walk"), "a", "b", (F.col("n") / F.col("total")).alias("share")
        )

    if edges.take(1):
        links = measured(shares("trust", "src", "dst").unionByName(shares("distrust", "dst", "src")), "shares")
        ranks = spread(links, seeds, damping, tolerance)
    else:  # A walk stays where it starts.
        ranks = seeds.select("walk", "host", (F.col("mass") * (1 - damping)).alias("score"))

    def score(walk: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("score"))), F.lit(0.0)).alias(walk)

    return ranks.groupBy("host").agg(score("trust"), score("distrust"))


def judge(
    pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, ratio: float = RATIO,
    damping: float = DAMPING, tolerance: float = TOLERANCE,
) -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``."""
    rows = placed(pages.drop(*[c for c in ("trust", "distrust") if c not in (url, html)]), url, rules)
    counted = rows.where(F.col("host") != "").groupBy("host").agg(
        F.count_if(F.col("_listed") == ALLOW).alias("n_allow"), F.count_if(F.col("_listed") == BLOCK).alias("n_block")
    )
    scores = measured(host_scores(host_edges(rows, html), counted, damping, tolerance), "host_scores")
    zero = F.lit(0.0)
    scored = rows.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    spread_verdict = F.when(F.col("distrust") > ratio * (1 + TIE) * F.col("trust"), BLOCK).otherwise(ALLOW)
    return scored.withColumn("verdict", F.coalesce("_listed", spread_verdict)).drop("_listed")
