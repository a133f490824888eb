"""URL verdicts from rules and from trust that spreads over links between hosts.

A rule (host, path) decides for its host and all subdomains where the url's
path starts with the rule's; of several the longest wins. For urls that no rule
fits, trust starts at hosts that rules allow and follows links; distrust starts
at hosts that rules block and goes against links, from a blocked host to those
that point at it. Both are personalised PageRanks over weighted host edges:
a seed is worth the share of the host's pages that rules decide, and a host is
blocked when its distrust exceeds its trust by more than half of what a wholly
blocked host without links has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import materialize

#: Rules that are matched as a literal in the plan; more are joined.
LITERAL_RULES = 1_000
DAMPING = 0.85
TOLERANCE = 1e-6
#: Excess of distrust over trust, as a share of a blocked host's own, from which on a host is blocked.
EXCESS = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str  #: allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*(/?[^?#]*)", 1)


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """urls (host, path and any other columns) with ``rule`` and ``rule_verdict`` of the longest rule that fits, or nulls.

    Of rules of one length the one whose text sorts first wins, and of rules
    with one text the one that blocks, however many rules there are.
    """
    best: dict[str, Rule] = {}
    for r in sorted(rules, key=lambda r: r.verdict):
        best[r.text] = r
    ordered = sorted(best.values(), key=lambda r: (-len(r.text), r.text))
    dotted = F.concat(F.lit("."), F.col("host"))
    if len(ordered) <= LITERAL_RULES:
        fits = F.lit(None).cast("struct<rule:string,verdict:string>")
        for r in reversed(ordered):
            hit = F.endswith(dotted, F.lit("." + r.host)) & F.startswith(F.col("path"), F.lit(r.path)) & (F.col("host") != "")
            fits = F.when(hit, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
        return urls.withColumn("_fit", fits).select("*", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("rule_verdict")).drop("_fit")
    # Many rules: a host's suffixes meet the rules once for each distinct (host, path).
    table = urls.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in ordered], "rule_host string, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = urls.filter("host <> ''").select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    met = places.join(table, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    longest = met.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule")).alias("_fit"))
    joined = urls.join(longest, ["host", "path"], "left")
    return joined.select(*urls.columns, F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of host src link to host dst, without links inside a host.

    Links are the href attributes with a scheme, or with // and the page's own.
    A page counts once for a host; pages are summed before anything is dealt out.
    """
    href = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)
    targets = F.array_distinct(F.transform(F.coalesce(href, F.array().cast("array<string>")), lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("x:"), x)).otherwise(x))))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """(host, score) with score = (1 - d) * seed + d * what source hosts pass on in proportion to their edges.

    Scores of hosts that nothing reaches are left out. A round is written to
    the checkpoint folder; it ends when no score moves by TOLERANCE, which comes
    after some log(TOLERANCE) / log(DAMPING) rounds at most.
    """
    out = edges.groupBy(source).agg(F.sum("pages").alias("all"))
    flow = materialize(edges.join(out, source).select(F.col(source).alias("from"), F.col(target).alias("to"), (F.col("pages") / F.col("all")).alias("share")))
    base = seeds.filter("seed > 0").select("host", ((1 - DAMPING) * F.col("seed")).alias("score"))
    score = base = materialize(base)
    if not flow.limit(1).count():
        return base
    while True:
        passed = flow.join(score.withColumnRenamed("host", "from"), "from").groupBy(F.col("to").alias("host")).agg((DAMPING * F.sum(F.col("share") * F.col("score"))).alias("score"))
        new = materialize(base.unionByName(passed).groupBy("host").agg(F.sum("score").alias("score")))
        moved = new.withColumnRenamed("score", "now").join(score, "host", "left").agg(F.max(F.abs(F.col("now") - F.coalesce("score", F.lit(0.0))))).first()[0]
        score = new
        if not moved or moved < TOLERANCE:
            return score


def host_scores(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust and whether the method blocks it, for every host that has either score."""
    seeds = judged.filter("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("rule_verdict", F.lit("")) == "allow").cast("double")).alias("allowed"),
        F.avg((F.coalesce("rule_verdict", F.lit("")) == "block").cast("double")).alias("blocked"),
    )
    seeds = materialize(seeds)
    trust = personalised_rank(edges, seeds.select("host", F.col("allowed").alias("seed")), "src", "dst")
    distrust = personalised_rank(edges, seeds.select("host", F.col("blocked").alias("seed")), "dst", "src")
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    both = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("bad", F.col("distrust") - F.col("trust") > EXCESS * (1 - DAMPING))


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    A url that is null or has no :// has an empty host and path and is allowed,
    as is a host that nothing speaks against. A null html has no links. Repeated
    rows are judged each; further columns are ignored. Hosts are few beside
    pages, and a host that a third of all pages share meets one row of scores.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rule(plain, rules)
    # written first, so that the join's sides are plain exchanges, which adaptive execution can split for a hot host
    scores = materialize(host_scores(judged, materialize(host_edges(pages))))
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
