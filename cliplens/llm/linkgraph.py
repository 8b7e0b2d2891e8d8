"""URL filtering by rules and by trust and distrust that links carry between hosts.

Hosts are the nodes, links between pages of different hosts the edges. Trust
starts at the hosts whose pages the rules allow and flows along the links, as
in a personalised PageRank; distrust starts at those whose pages they block and
flows against the links, to who links to them. A page without a rule gets the
verdict of its host. What arrives at a host is added up in decimals, so a run
gives the same verdicts however the rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplens.operators.joins import weighted_join
from cliplens.session import materialize

UNIT = 1_000_000_000  # of the whole numbers in the SQL
FOLLOW = 85  # per cent of an amount that follows the links
ROUNDS = 6  # that the SQL writes out
TOLERANCE = 1e-6  # largest change of an amount in the last round, as a share of it
AMOUNT = "decimal(38,24)"  # of sums; what is less is nothing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; NULL if none does.

    ``rules`` are few: (host and path, verdict). A rule fits its host and all
    subdomains if the path starts with its own. Of equal rules "block" wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
                       ).otherwise(found)
    return found


def host_edges(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """(src, dst, links, out, into): links between different hosts and the sums of either end.

    Links are counted before they are shuffled, so a host with very many pages
    costs no more than its distinct targets.
    """
    links = materialize(
        pages.where(F.col(host_col) != "").select(
            F.col(host_col).alias("src"),
            F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("target"))
        .select("src", F.translate("target", UPPER, LOWER).alias("dst"))
        .where("dst <> '' AND dst <> src")
        .groupBy("src", "dst").agg(F.count("*").alias("links")), "host-links")
    out = links.groupBy("src").agg(F.sum("links").alias("out"))
    into = links.groupBy("dst").agg(F.sum("links").alias("into"))
    return materialize(links.join(out, "src").join(into, "dst"), "host-edges")


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE,
              follow: int = FOLLOW) -> DataFrame:
    """(host, trust, distrust) when settled; ``seeds`` has the amounts of the start.

    Each round a host has 100 - ``follow`` per cent of its seed and ``follow``
    per cent of what its neighbours send, trust along the links and distrust
    against them, each neighbour dividing what it has by its links. Rounds go on
    until no amount changes by more than ``tolerance`` of itself, so that an
    amount has gone as far as links lead. Amounts only grow, and by ``follow``
    per cent of the change before, so this ends.
    """
    kinds, kept = ("trust", "distrust"), (100 - follow) / 100
    start = seeds.select("host", *[(F.col(c) * kept).alias(f"_{c}") for c in kinds])
    state = materialize(start.select("host", *[F.col(f"_{c}").alias(c) for c in kinds]), "host-trust")
    nothing = F.lit(0).cast(AMOUNT)
    while True:
        forward = edges.join(state.withColumnRenamed("host", "src"), "src").select(
            F.col("dst").alias("host"),
            (F.col("trust") * F.col("links") / F.col("out")).cast(AMOUNT).alias("trust"),
            nothing.alias("distrust"))
        back = edges.join(state.withColumnRenamed("host", "dst"), "dst").select(
            F.col("src").alias("host"), nothing.alias("trust"),
            (F.col("distrust") * F.col("links") / F.col("into")).cast(AMOUNT).alias("distrust"))
        sent = forward.unionByName(back).groupBy("host").agg(*[F.sum(c).alias(f"_sent_{c}") for c in kinds])
        before = state.select("host", *[F.col(c).alias(f"_old_{c}") for c in kinds])
        amounts = start.join(sent, "host", "full").join(before, "host", "left").select(
            "host", *[(F.coalesce(f"_{c}", F.lit(0.0)) + F.coalesce(
                F.col(f"_sent_{c}").cast("double"), F.lit(0.0)) * (follow / 100)).alias(c) for c in kinds],
            *[F.coalesce(f"_old_{c}", F.lit(0.0)).alias(f"_old_{c}") for c in kinds])
        moved = F.lit(False)
        for c in kinds:
            moved = moved | (F.abs(F.col(c) - F.col(f"_old_{c}")) > tolerance * F.col(c))
        written = materialize(amounts.withColumn("_moved", moved), "host-trust")
        state = written.select("host", *kinds)
        if not written.where("_moved").limit(1).count():
            return state


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
               html_col: str = "html", out: str = "judged", threshold: float = 0.0) -> DataFrame:
    """``pages`` with a struct ``out``: host, path, rule, trust, distrust, verdict.

    The longest rule decides; without one the page is blocked if its host has
    more distrust than trust by over ``threshold`` and more than the walk is
    exact to, else allowed. A host's seed is its share of allowed and of blocked
    pages among those with a rule.

    NULL urls and those without ``://`` have an empty host and path, fit no rule
    and are allowed. NULL or empty html has no links; links are whole however
    long it is. Repeated pages count as often as given. An empty table stays
    empty. An existing column named ``out`` is replaced.
    """
    columns = [c for c in pages.columns if c.lower() != out.lower()]
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    known = pages.select(*columns, host.alias("__host"), path.alias("__path"))
    known = known.withColumn("__rule", match_rule(F.col("__host"), F.col("__path"), rules))
    verdict = F.col("__rule.verdict")
    seeds = known.groupBy(F.col("__host").alias("host")).agg(
        F.count("*").alias("pages"), F.count_if(verdict == "allow").alias("good"),
        F.count_if(verdict == "block").alias("bad"))
    seeds = materialize(seeds.select(
        "host", "pages",
        F.expr("if(good + bad = 0, 0D, good / (good + bad))").alias("trust"),
        F.expr("if(good + bad = 0, 0D, bad / (good + bad))").alias("distrust")), "seeds")
    scores = propagate(seeds.drop("pages"), host_edges(known, "__host", html_col))
    hosts = materialize(scores.join(seeds.select("host", "pages"), "host").select(
        F.col("host").alias("__host"), "pages", F.col("trust").alias("__trust"),
        F.col("distrust").alias("__distrust")), "host-verdicts")
    judged = weighted_join(known, hosts, "__host", "pages", "left", [url_col, *[
        c for c in columns if c not in (url_col, html_col)]])
    exact = F.greatest("__distrust", "__trust") * (TOLERANCE * 10)  # of a change, its later rounds add up
    by_host = F.when(F.col("__distrust") - F.col("__trust") > exact + threshold, "block").otherwise("allow")
    return judged.select(*columns, F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"), F.col("__trust").alias("trust"),
        F.col("__distrust").alias("distrust"),
        F.coalesce(verdict, by_host).alias("verdict")).alias(out))
