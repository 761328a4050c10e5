"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors
shrink them level by level: public suffix towards the whole, registered domain
towards its suffix, host towards its domain, each with a prior strength that the
moments of that level's own rates give. A host is blocked when its posterior bad
rate lies above the rate of the whole and the lower bound of that rate (mean less
``z`` standard deviations) reaches ``limit``.

The limit comes from the labelled outcomes: the lowest of a grid of ``STEPS``
steps at which the hosts that reach it hold at most ``max_loss`` of the good
outcomes. Without a bad outcome nothing is blocked.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import salted_join, store

#: Steps of the grid from which a limit is chosen.
STEPS = 10_000

#: Second-level labels under which registrations happen one level lower, with two-letter top levels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_url_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path (both empty for a null url or one without ``://``)."""
    cut = lambda p: F.coalesce(F.regexp_extract("url", p, 1), F.lit(""))
    return pages.withColumn("host", _lower(cut(r"://([^/?#]*)"))).withColumn("path", cut(r"://[^/?#]*([^?#]*)"))


def domain_parts() -> tuple[Column, Column]:
    """Registered domain and suffix of column host."""
    labels = F.split(F.regexp_replace("host", r":\d*\z", ""), r"\.")
    n = F.size(labels)
    second = F.try_element_at(labels, F.lit(-2))
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & second.isin(*SECOND_LEVEL)
    tail = lambda k: F.array_join(F.when(n > k, F.slice(labels, -k, k)).otherwise(labels), ".")
    return F.when(deep, tail(3)).otherwise(tail(2)), F.when(deep, tail(2)).otherwise(tail(1))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength from the between-group variance of bad rates (method of moments)."""
    m = F.col(mean)
    spread = F.sum(F.when(m * (1 - m) > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) / (m * (1 - m))).otherwise(0.0))
    g, n, n2 = F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n"))
    rho = F.greatest(F.lit(0.005), F.least(F.lit(0.9), F.try_divide(spread - (g - 1), n - n2 / n - (g - 1))))
    return groups.where("n > 0").agg(F.coalesce(1 / rho - 1, F.lit(9.0)).alias("s")).first()["s"]


def _size(df: DataFrame, *names: str) -> tuple[int, int]:
    """Rows, and bytes of these strings."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((F.octet_length(c) for c in names), F.lit(0))), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def reputations(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host of ``counts`` (host, n, bad; each host once): n, bad, bad_rate, its lower bound bad_low, and the rate
    ``whole`` of all together. Hosts, and domains, are stored once; a level joins the one above by broadcast while that
    is small, else with salts, so that a domain or suffix of very many hosts spreads."""
    domain, suffix = domain_parts()
    base = store(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = store(base.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = store(domains.groupBy("suffix").agg(*sums), "suffixes")
    all_ = suffixes.agg(*sums).first()
    whole = ((all_["bad"] or 0) + 0.5) / ((all_["n"] or 0) + 1)

    def shrunk(df: DataFrame, mean: str, out: str) -> DataFrame:
        s = F.lit(_strength(df, mean))
        return df.withColumn(out, (F.col("bad") + s * F.col(mean)) / (F.col("n") + s))

    means1 = shrunk(suffixes.withColumn("mean0", F.lit(whole)), "mean0", "mean1").select("suffix", "mean1")
    means2 = shrunk(salted_join(domains, means1, ["suffix"], *_size(suffixes, "suffix")), "mean1", "mean2").select("domain", "mean2")
    joined = salted_join(base, means2, ["domain"], *_size(domains, "domain"))
    s = F.lit(_strength(joined, "mean2"))
    a = F.col("bad") + s * F.col("mean2")
    b = F.col("n") - F.col("bad") + s * (1 - F.col("mean2"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    low = F.greatest(F.lit(0.0), F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("a") + F.col("b") + 1)))
    rated = joined.select("host", "n", "bad", a.alias("a"), b.alias("b")).withColumn("bad_rate", mean)
    return store(rated.select("host", "n", "bad", "bad_rate", low.alias("bad_low"), F.lit(whole).alias("whole")), "reputations")


def limit_for(rates: DataFrame, max_loss: float = 0.05) -> float:
    """The lowest step at which hosts above the whole's rate whose bound reaches it hold at most ``max_loss`` of all
    good outcomes; above 1 if there is none or no outcome is bad."""
    good = F.col("n") - F.col("bad")
    worse = F.col("bad_rate") > F.col("whole")
    steps = rates.groupBy(F.when(worse, F.floor(F.col("bad_low") * STEPS)).alias("step")).agg(F.sum(good).alias("good"), F.sum("bad").alias("bad")).collect()  # at most STEPS + 2 rows
    if not sum(r["bad"] for r in steps):
        return 2.0
    room, limit = max_loss * sum(r["good"] for r in steps), 2.0
    for r in sorted((r for r in steps if r["step"] is not None), key=lambda r: -r["step"]):
        room -= r["good"]
        if room < 0:
            break
        limit = r["step"] / STEPS
    return limit


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, from (verdict, host + path) pairs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], z: float = 1.645, limit: float | None = None, max_loss: float = 0.05) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_low of every page.

    ``outcomes`` has page_id and bad; a null in either is not an outcome, and a page
    with several outcomes counts as often. ``limit`` is chosen by ``limit_for``
    unless given. A url without a host belongs to the nameless host; repeated pages
    are judged one by one; other columns are ignored. Without any outcome the bad
    rate is 1/2 everywhere and only rules block. Hosts are counted before they are
    shuffled, and their rates meet the pages by broadcast while few and short, else
    on host and a salt.
    """
    parts = with_url_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).drop("url")
    told = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    none = F.lit(0).cast("long")
    seen = parts.select("host", none.alias("n"), none.alias("bad")).unionByName(parts.join(told, "page_id").select("host", "n", "bad"))
    rates = reputations(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), z)
    limit = limit_for(rates, max_loss) if limit is None else limit
    worse = (F.col("bad_rate") > F.col("whole")) & (F.floor(F.col("bad_low") * STEPS) >= round(limit * STEPS))
    judged = rates.select("host", "bad_rate", "bad_low", F.when(worse, "block").otherwise("allow").alias("own"))
    joined = salted_join(parts, judged, ["host"], *_size(judged, "host"))
    rule, verdict = rule_of(rules)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "own").alias("verdict"), F.round("bad_rate", 9).alias("bad_rate"), F.round("bad_low", 9).alias("bad_low"))
