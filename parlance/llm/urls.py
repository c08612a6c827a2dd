"""URL filtering by rules and by the empirical-Bayes reputation of hosts.

Labelled outcomes of a host's pages are shrunk by beta-binomial priors: the host's prior is its
registered domain's posterior mean, the domain's that of its suffix, the suffix's the overall rate.
How strong each level's prior is comes from the spread of its members about their parents (method of
moments). A host is blocked if the lower bound of its posterior is over a limit, which the overall
rate and the spread of hosts give: what few hosts of the prior would reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import ascii_lower, attach, stored

RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
#: prior strengths in observations, at least and at most
LEAST, MOST = 1.0, 1000.0
Z = 1.645
#: second-level labels under which two-letter suffixes hand out names; further suffixes are a parameter
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "mil", "net", "org")
SUFFIXES = ("github.io", "blogspot.com")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[str] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and its subdomains, and paths that start with its path."""
    rule = verdict = F.lit(None).cast("string")
    for line in sorted(rules, key=lambda r: len(r.split(" ", 1)[1])):  # the last one tried first
        says, what = line.split(" ", 1)
        name, slash, rest = what.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(what)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and its suffix, without user and port. An address is its own domain, of suffix ``ip``.

    A suffix is the last label, or the last two if they are in ``suffixes`` or a two-letter label after
    one of SECOND_LEVEL; the domain has one label more, if there is one.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    last = lambda n: F.substring_index(bare, ".", -n)
    two = bare.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$") | last(2).isin(*suffixes)
    return F.when(address, bare).when(two, last(3)).otherwise(last(2)), F.when(address, "ip").when(two, last(2)).otherwise(last(1))


def strength(level: DataFrame) -> float:
    """The prior strength from members (n, bad) and their parents (pn, pbad): one number, from sums over all members."""
    rate = F.try_divide("pbad", "pn")
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - rate, 2))
    by_chance = F.sum(rate * (1 - rate) * (1 - F.try_divide("n", "pn")))
    room = F.sum(F.col("n") - F.try_divide(F.col("n") * F.col("n"), "pn"))
    one = level.where("n > 0").agg(spread.alias("spread"), by_chance.alias("chance"), room.alias("room"), F.avg(rate * (1 - rate)).alias("var")).first()
    between = (one["spread"] - one["chance"]) / one["room"] if one["room"] else 0.0
    return max(LEAST, min(MOST, one["var"] / between - 1)) if between > 0 else MOST


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound, limit) from (host, bad 0/1 or null, pages): ``pages`` pages of that outcome, null if unlabelled.

    ``bound`` is the posterior mean less Z posterior standard deviations; ``limit`` the overall rate
    plus Z standard deviations of hosts about it. Hosts without labels get their domain's mean; if
    nothing is labelled the overall rate is 0.5. A null host is a host. The driver gets five numbers.
    """
    labelled = F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum(labelled).alias("n"), F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).alias("bad")).withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = stored(hosts, "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    every = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("bad"), F.lit(0)).alias("pbad")).first()
    parent = lambda df, key: df.select(key, F.col("n").alias("pn"), F.col("bad").alias("pbad"))
    k_s = strength(suffixes.withColumns({"pn": F.lit(every["pn"]), "pbad": F.lit(every["pbad"])}))
    k_d = strength(attach(domains, parent(suffixes, "suffix"), ["suffix"], ["domain"]))
    k_h = strength(attach(hosts, parent(domains, "domain"), ["domain"], ["host"]))
    overall = every["pbad"] / every["pn"] if every["pn"] else 0.5
    s = suffixes.select("suffix", ((F.col("bad") + k_s * overall) / (F.col("n") + k_s)).alias("m_s"))
    d = attach(domains, s, ["suffix"], ["domain"]).select("domain", ((F.col("bad") + k_d * F.col("m_s")) / (F.col("n") + k_d)).alias("m_d"))
    a, b = F.col("bad") + k_h * F.col("m_d"), F.col("n") - F.col("bad") + k_h * (1 - F.col("m_d"))
    mean = a / (a + b)
    limit = overall + Z * (overall * (1 - overall) / (k_h + 1)) ** 0.5
    return attach(hosts, d, ["domain"], ["host"]).select("host", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"), F.lit(limit).alias("limit"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad, pages): how many pages of each host have an outcome, the label of the document whose number stands in the second part of the path.

    ``bad`` is 1 for low quality or toxicity, 0 for neither, null without a number or label; of repeated labels the worst counts.
    """
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    shown = pages.select(host_of(F.col("url")).alias("host"), F.nullif(number, F.lit("")).cast("bigint").alias("doc_id")).groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    told = shown.where("doc_id is not null").join(worst, "doc_id", "left").select("host", "bad", "pages")
    return told.unionByName(shown.where("doc_id is null").select("host", F.lit(None).cast("int").alias("bad"), "pages"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, n, bad, mean, bound, limit of each row of ``pages`` (page_id, url); the last five as in ``host_reputation``, rounded to six places.

    A rule's verdict comes before the host's. Null urls and urls without ``://`` have an empty host,
    which is judged like another. Repeated rows and null ids are rows of their own; other columns are
    left out; an empty table gives an empty result.
    """
    known = stored(host_reputation(page_outcomes(pages, labels)), "reputation")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > F.col("limit"), "block").otherwise("allow")
    figures = [F.round(c, 6).alias(c) for c in ("mean", "bound", "limit")]
    return attach(rows, known, ["host"], ["path", "page_id"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n", "bad", *figures)
