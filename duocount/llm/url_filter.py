"""Operator 4: URL filters by link-graph propagation (DataFrame functions only).

Rules judge the urls they fit (the longest wins). The rest is judged by host: trust is a personalised
PageRank over host edges from the hosts of allowed pages, distrust one over the reversed edges from the
hosts of blocked pages, and a host is blocked where its distrust exceeds ``RATIO`` times its trust.

Host edges are the absolute and scheme-less links in a page's html (link counts as weights; links
inside a host carry nothing between hosts), and one edge each way between a host and its parent domain, up its whole
chain of suffixes to two labels, since a subdomain and its domain are under one owner. Edges are aggregated per (from, to)
before anything is joined; both ranks go through one join and one partial aggregation a step, in as many partitions as
the counted edges fill, and are written to a checkpoint table every ``CUT`` steps; the superseded one is deleted. Steps
go on until ``CUT`` of them change the ranks of either kind by less than ``TOLERANCE`` in sum; after ``STEP_LIMIT`` steps
without that an error is raised. ``MARGIN`` is more than what ranks settled so far can still move.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; a null or empty html has no links; ties in rank are allowed; repeated rows are judged row by
row; clashing columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.session import cut_lineage, drop_table

DAMPING, CUT, RATIO = 0.85, 8, 1.0
TOLERANCE, STEP_LIMIT = 1e-9, 256  # after n steps, the further change is at most 2 * DAMPING ** n
MARGIN = 1e-8                      # over TOLERANCE * DAMPING / (1 - DAMPING)
EDGES_A_TASK = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``verdict`` (allow or block) for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, of a table with ``host`` and ``html``."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'<>\s]+)"), 1)
    linked = (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
              .select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight")))
    hosts = pages.where("host <> ''").select("host").distinct().union(linked.select("dst")).distinct()
    labels = hosts.select(F.split("host", r"\.").alias("l")).where(F.size("l") > 2)
    chain = F.explode(F.expr("transform(sequence(1, size(l) - 2), i -> struct(array_join(slice(l, i, size(l)), '.') as src, "
                             "array_join(slice(l, i + 1, size(l)), '.') as dst))"))
    up = labels.select(chain.alias("e")).select("e.*").distinct()
    both = up.union(up.select("dst", "src")).select("src", "dst", F.lit(1).cast("long").alias("weight"))
    return linked.union(both).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, limit: int = STEP_LIMIT) -> DataFrame:
    """(host, trust, distrust), settled to ``tolerance``, from edges and seeds (kind trust or distrust, host, mass)."""
    directed = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust"), "dst", "src", "weight"))
    out = directed.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    tasks = -(-2 * edges.count() // EDGES_A_TASK) or 1
    shares = cut_lineage(directed.join(out, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")).coalesce(tasks), "link-shares")
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    start = cut_lineage(seeds.join(total, "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("rank")).coalesce(tasks), "link-seeds")
    restart = start.select("kind", "host", (F.col("rank") * (1 - DAMPING)).alias("rank"))
    last, step, change = start, 0, None
    while change is None or change >= tolerance:
        if step >= limit:
            raise RuntimeError(f"link ranks still change by {change} in sum after {step} steps")
        rank = last
        for step in range(step + 1, min(step + CUT, limit) + 1):
            moved = rank.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            rank = moved.union(restart).coalesce(tasks).groupBy("kind", "host").agg(F.sum("rank").alias("rank")).coalesce(tasks)
        rank = cut_lineage(rank, "link-ranks")
        moves = rank.union(last.select("kind", "host", -F.col("rank"))).coalesce(tasks).groupBy("kind", "host").agg(F.sum("rank").alias("move"))
        change = moves.coalesce(tasks).groupBy("kind").agg(F.sum(F.abs("move")).alias("change")).agg(F.max("change")).first()[0] or 0.0
        if last is not start:
            drop_table(last)
        last = rank

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)

    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    parsed = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{html}`").cast("string").alias("html"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.drop("html").withColumn("fit", fit)
    seeds = (ruled.where("fit is not null and host <> ''")
             .groupBy(F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
             .agg(F.count("*").alias("mass")))
    ranks = propagate(cut_lineage(host_edges(parsed), "host-edges"), seeds)
    verdict = ranks.select("host", "trust", "distrust", (F.col("distrust") > F.col("trust") * RATIO + MARGIN).alias("bad"))
    return ruled.join(verdict, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
