"""URL filtering by rules and by trust that flows along links between hosts.

Rules decide the pages they fit. Their hosts are seeds: trust starts at hosts with allowed pages and flows along
links (personalised PageRank); distrust starts at hosts with blocked pages and flows against the links, from a
blocked host to those that link to it. Pages without a rule get their host's verdict: block where distrust is more
than `ratio` times trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.llm.storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PLACE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PLACE, 2), F.lit(""))


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, said of each (host, path) that a rule fits; the longest rule wins, then `allow`, then by text."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = rules.select(F.col("host").alias("of"), F.col("path").alias("start"), F.col("verdict").alias("said"))
    fits = (places.where("host != ''").select("host", "path", F.explode(suffixes).alias("of")).join(known, "of")
            .where(F.startswith("path", "start")).withColumn("rule", F.concat("of", "start")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("said") == "allow").alias("yes"), "rule", "said"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.said")


def spread(edges: DataFrame, seeds: DataFrame, damping: float, steps: int, every: int, tolerance: float) -> DataFrame:
    """kind, host, score: PageRank of each kind with restart at its seeds (kind, host, seed summing up to 1).

    edges: kind, source, target, share (of the source's links). Mass of hosts without links returns to the seeds.
    Lineage is cut every `every` steps, and the run ends when scores move less than `tolerance` in such a span.
    """
    scores, last = seeds.withColumn("score", F.col("seed")), None
    for step in range(1, steps + 1):
        flow = (scores.join(edges.withColumnRenamed("source", "host"), ["kind", "host"])
                .groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got")))
        lost = F.broadcast(flow.groupBy("kind").agg(F.sum("got").alias("kept")))  # a row for each kind
        scores = (seeds.join(flow, ["kind", "host"], "full").join(lost, "kind", "left")
                  .select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed"),
                          (F.coalesce("seed", F.lit(0.0)) * (1 - damping * F.coalesce("kept", F.lit(0.0)))
                           + damping * F.coalesce("got", F.lit(0.0))).alias("score")))
        if step % every == 0 or step == steps:
            scores = cut(scores)
            if last is not None:
                moved = (scores.select("kind", "host", "score").join(last, ["kind", "host"], "full")
                         .agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0])
                if (moved or 0.0) < tolerance:
                    break
            last = scores.select("kind", "host", F.col("score").alias("was"))
    return scores.select("kind", "host", "score")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          damping: float = 0.85, ratio: float = 1.0, steps: int = 20, every: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """`page_id`, host, path, rule, verdict, trust, distrust of every page.

    rules: host, path, verdict (allow or block). A null url or one without `://` has empty host and path, no rule and
    the verdict `allow`, as have hosts that neither trust nor distrust reaches. Repeated pages stay repeated rows and
    weigh as often; null html has no links. Links are absolute ones between different hosts, weighted by their count.
    """
    rows = pages.select(F.col(page_id).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fits = fitting_rules(rows.select("host", "path").distinct(), rules)
    ruled = rows.join(fits, ["host", "path"], "left")
    seeds = (ruled.where("said is not null").groupBy(F.expr("if(said = 'allow', 'trust', 'distrust')").alias("kind"), "host")
             .agg(F.count("*").cast("double").alias("n")))
    total = F.broadcast(seeds.groupBy("kind").agg(F.sum("n").alias("all")))
    seeds = cut(seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")))
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1),
                        lambda x: F.translate(x, UPPER, LOWER))
    links = (pages.select(host_of(F.col(url)).alias("source"), F.explode(found).alias("target"))
             .where("source != '' and target != source").groupBy("source", "target").agg(F.count("*").alias("n")))
    both = links.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("source"), F.col("target")),
        F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"))))
        .alias("e"), "n").select("e.*", "n")
    out = both.groupBy("kind", "source").agg(F.sum("n").alias("all"))
    edges = cut(both.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("all")).alias("share")))
    scores = spread(edges, seeds, damping, steps, every, tolerance)
    hosts = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
                                       F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    judged = ruled.join(hosts, "host", "left").na.fill(0.0, ["trust", "distrust"])
    return judged.select(
        F.col("page").alias(page_id), "host", "path", "rule",
        F.coalesce("said", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")).alias("verdict"),
        "trust", "distrust")
