"""URL verdicts by explicit rules and by link-graph propagation, in DataFrame functions only.

Rules decide the pages they fit. Hosts that rules allow seed a personalised PageRank along host
edges; hosts that rules block seed distrust along the reversed edges. A host is blocked where its
distrust outweighs its trust by a threshold; pages without a rule take their host's verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import settled

#: Lists of up to so many hosts (about 40 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_HOSTS = 100_000
#: Parts into which pages of one host are dealt where the host list is joined by shuffle.
SALTS = 32
#: Edges of a host above which they are dealt over parts of about so many; rounds between checkpoints.
HUB_EDGES, TURNS = 10_000, 6
#: Rounds after which propagation raises an error: no way between hosts is nearly that long.
MOST_ROUNDS = 5_000
#: Graphs of up to so many edges (both kinds) are one task.
TASK_EDGES = 250_000
LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, LETTERS_UPPER, LETTERS_UPPER.lower())


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, one row per pair, pages counted before any shuffle of links.

    Edges are absolute and protocol-relative links of the page, hosts that its text names (three labels or more,
    `www.example.com` after white space or a tag: two could be the end of a sentence), and from a host to its parent
    domain and back. Links of a page to one host count once; an own link counts nothing.
    """
    linked = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), 1)
    named = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?<=[\s>;@])((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){2,}[A-Za-z]{2,24})(?=[\s<,;/?#]|$)"), 1)
    far = F.transform(F.array_distinct(F.concat(linked, named)), ascii_lower)
    links = pages.select("host", F.explode(F.array_distinct(far)).alias("dst")).where((F.col("host") != "") & (F.col("dst") != F.col("host")))
    links = links.groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"))
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    up = pages.select("host", parent.alias("dst")).where(F.col("dst") != "").distinct()
    up = up.select(F.col("host").alias("src"), "dst", F.lit(1.0).alias("weight"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank of both kinds at once: (kind, host, score).

    kind 't' runs along edges from trusted seeds, 'd' against them from blocked seeds. A host holds a score and a residual that
    it has not passed on yet. In each round, hosts whose residual is over `tolerance` of their own score pass it
    on; it ends when there is no such host. So far-off hosts are reached however long the way is, what is left out at a
    host is a small share of its own score, and neither depends on hosts that no path leads to. Edges, gathered by source, stay
    where their source hashes to, and so do scores: a round shuffles only pre-aggregated sums. The edges of a hub are
    gathered in parts of about HUB_EDGES, by destination.
    """
    spark = edges.sparkSession
    both = edges.select(F.lit("t").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = settled(both.groupBy("kind", "src").agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")
    both = settled(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share"), part))
    # One task for a small graph, whose rounds then need no shuffle at all.
    alone = both.count() <= TASK_EDGES
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(df: DataFrame, *keys: str) -> DataFrame:
        return df.coalesce(1) if alone else df.repartition(tasks, *keys)

    ways = both.groupBy("kind", "src", "part").agg(F.collect_list(F.struct("dst", "share")).alias("ways")).withColumnRenamed("src", "host")
    ways = kept(ways, "kind", "host").persist()
    seed = (1 - damping) * F.col("seed")
    state = kept(seeds.select("kind", "host", seed.alias("score"), seed.alias("residual")), "kind", "host")
    due = F.col("residual") > tolerance * F.col("score")
    try:
        for turn in range(1, MOST_ROUNDS + 1):
            # A host sends itself what it keeps, once, and its neighbours their shares: one join and one sum.
            kind = "array<struct<host: string, score: double, residual: double>>"
            own = F.when(F.coalesce("part", F.lit(0)) == 0, F.array(F.struct("host", "score", F.when(due, 0.0).otherwise(F.col("residual")).alias("residual"))))
            given = F.when(due, F.transform("ways", lambda w: F.struct(w["dst"].alias("host"), (damping * w["share"] * F.col("residual")).alias("score"), (damping * w["share"] * F.col("residual")).alias("residual"))))
            sent = state.join(ways, ["kind", "host"], "left").select("kind", F.inline(F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (own, given)])))
            state = sent.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("residual").alias("residual"))
            if turn % TURNS == 0:
                state = settled(state)
                if state.where(due).isEmpty():
                    return state.select("kind", "host", "score")
                state = kept(state, "kind", "host")
    finally:
        ways.unpersist()
    raise RuntimeError(f"scores have not settled after {MOST_ROUNDS} rounds")


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 1e-2, threshold: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, method for every page.

    Null urls and urls without `://` have an empty host and path, fit no rule and are allowed. Null
    html has no links. Hosts without any score are allowed; ties (distrust equal to threshold * trust)
    are allowed. Propagation ends when no host has more than `tolerance` of its own score left to pass on. Seeds are shares of a
    host's pages and are not scaled to add up to 1, and there is no least distrust: a host's verdict depends on hosts that paths
    join it to, not on others. Repeated pages keep their rows. An empty table gives an empty result. Only page_id,
    url and html are read, so other columns may have any name.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.drop("html").withColumn("_rule", ruled)
    votes = judged.where(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_rule.verdict") == "allow").alias("good"),
        F.count_if(F.col("_rule.verdict") == "block").alias("bad"),
    )
    votes = settled(votes)
    seeds = votes.select(F.lit("t").alias("kind"), "host", (F.col("good") / F.col("n")).alias("seed")).unionByName(votes.select(F.lit("d").alias("kind"), "host", (F.col("bad") / F.col("n")).alias("seed"))).where("seed > 0")
    scores = propagate(host_edges(parsed), seeds, damping, tolerance)
    trust = F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("score"))), F.lit(0.0))
    distrust = F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("score"))), F.lit(0.0))
    blocked = scores.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust")).where(F.col("distrust") > threshold * F.col("trust"))
    blocked = settled(blocked.join(votes.select("host"), "host", "left_semi").select("host"))
    if blocked.count() <= BROADCAST_HOSTS:
        joined = judged.join(F.broadcast(blocked.withColumn("_blocked", F.lit(True))), "host", "left")
    else:
        # A host may own a third of all pages: its pages are dealt over SALTS parts, the list once to each.
        copies = blocked.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_blocked"))
        salted = judged.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, ["host", "_salt"], "left")
    method = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), method.alias("graph_verdict"))
