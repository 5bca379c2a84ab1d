"""URL filter: rules first, else trust and distrust spread over the host graph.

Personalised PageRank runs twice over the same loop: trust flows along host edges from trusted seeds, distrust
flows against them from blocked seeds. Edges are links from a page to another host, and the tie between a host and its
parent domain where both have pages. A host is blocked when more distrust than trust reaches it.

Only DataFrame functions are used. Masses are whole numbers below 2^53 held as doubles, so sums do not depend on their order
and every run, and the SQL, gives the same bits. Nothing is collected; each few rounds the masses are written.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null or empty html has
no links; a page that names a host in several spellings or places counts once; repeated pages count each time; of rules of equal length that fit, the one
whose string is smaller counts; without seeds all masses are zero and the method allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ROUNDS, DAMPING, TOTAL_MASS = 20, 0.85, 4.0e15
_WRITE_EVERY = 5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# A link's host is read like a page's: up to a path, query or fragment, with its port and user part if it has any.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the first rule that fits in the order of ``ranked_rules``, or null."""
    fits = []
    for verdict, rule in ranked_rules(rules):
        domain, _, rest = rule.partition("/")
        on = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        fits.append(F.when(on, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def ranked_rules(rules) -> list[tuple[str, str]]:
    """(verdict, rule), the longest first; equally long ones in the order of their strings, a rule with both verdicts allows."""
    return sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, and the rule's verdict."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = parts.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("by_rule"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): pages of src that link to dst, plus one for a host and its parent domain, both ways."""
    hosts_of = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts_of).alias("dst"))
    linked = links.groupBy("src", "dst").agg(F.count("*").alias("w")).where("src <> '' and src <> dst")
    child = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).where("src <> ''")
    tied = child.join(hosts.select(F.col("host").alias("dst")).where("host <> ''"), "dst").select("src", "dst", F.lit(1).cast("bigint").alias("w"))
    both = linked.unionByName(tied).unionByName(tied.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w"))


def _flows(edges: DataFrame) -> DataFrame:
    """Edges of both walks: (walk, src, dst, w, total leaving src); the distrust walk is reversed."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    walks = edges.withColumn("walk", F.lit("trust")).unionByName(back.withColumn("walk", F.lit("distrust")))
    out = walks.groupBy("walk", "src").agg(F.sum("w").alias("total"))
    return walks.join(out, ["walk", "src"])


def host_scores(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that mass reaches."""
    by_rule = judged(pages, rules)
    hosts = common.written(
        by_rule.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "hosts"
    )
    flows = common.written(_flows(host_edges(pages, hosts)), "host-flows")
    seeds = hosts.where("host <> ''").select(
        "host", F.when(F.expr("allowed > 0 and blocked = 0"), "trust").when(F.expr("2 * blocked >= n"), "distrust").alias("walk")
    ).where("walk is not null")
    counts = seeds.groupBy("walk").agg(F.count("*").alias("k"))
    start = common.written(seeds.join(counts, "walk").select("walk", "host", F.floor(F.lit(TOTAL_MASS) / F.col("k")).cast("double").alias("mass")), "host-seeds")
    mass = start
    again = start.select("walk", "host", F.floor(F.col("mass") * (1 - DAMPING)).cast("double").alias("mass"))
    for k in range(rounds):
        sent = flows.join(mass.withColumnRenamed("host", "src"), ["walk", "src"]).select(
            "walk", F.col("dst").alias("host"), F.floor(F.floor(F.col("mass") * F.col("w") / F.col("total")) * DAMPING).cast("double").alias("mass")
        )
        mass = sent.unionByName(again).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
        if (k + 1) % _WRITE_EVERY == 0:
            mass = common.written(mass, "host-mass")
    side = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("mass")).otherwise(0.0)).alias(walk)
    return mass.groupBy("host").agg(side("trust"), side("distrust"))


def verdicts(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    scores = common.written(host_scores(pages, rules, rounds), "host-scores")
    found = judged(pages, rules).join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "trust", "distrust")
