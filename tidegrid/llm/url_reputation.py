"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, ascii_lower

# The public suffixes of two labels that are known unless others are passed. Any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.mx", "gov.uk", "org.uk")

Rule = tuple[str, str, str]  # allow or block, host, path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and the start of the path.

    ``rules`` is a short list that goes into the plan as an expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _level(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Counts per group of one level, and the strength of its beta-binomial prior (method of moments).

    With ``S = sum n (p - p0)^2`` over the groups, the intra-class correlation is
    ``(S / (p0 (1 - p0)) - (K - 1)) / (N - sum n^2 / N - (K - 1))``, and the prior weighs ``1 / rho - 1`` outcomes.
    """
    groups = df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    seen = groups.filter("n > 0")
    total = seen.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("K"), F.sum(F.col("n") * F.col("n")).alias("Q"))
    total = total.withColumn("p0", F.try_divide("B", "N"))
    # sum n (p - p0)^2 = sum bad^2 / n - N p0^2; whole-table sums of one row each
    squares = seen.agg(F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("E"))
    one = total.crossJoin(F.broadcast(squares))  # one row each
    p0, k1 = F.col("p0"), F.col("K") - 1
    rho = F.try_divide(F.try_divide(F.col("E") - F.col("N") * p0 * p0, p0 * (1 - p0)) - k1, F.col("N") - F.try_divide("Q", "N") - k1)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.001)), F.lit(0.95))
    return groups, one.select((1 / rho - 1).alias(name), *([F.coalesce(p0, F.lit(0.5)).alias("p0")] if name == "k_suffix" else []))


def host_reputation(
    outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES, scratch: Scratch | None = None
) -> DataFrame:
    """Posterior share of bad outcomes for every row of ``hosts`` (column ``host``).

    ``outcomes`` has ``host`` and ``bad`` (0/1; NULL outcomes are left out). A host is shrunk to its registered
    domain, that to its suffix, that to the whole table; a host without outcomes takes over its parent's share with the
    prior's uncertainty. Returns host, n, bad, mean, lower, upper (normal bounds of the beta posterior).

    Empty outcomes give a prior mean of 0.5. NULL hosts are the empty host. ``two_labels`` are the public suffixes of two
    labels. Counts per host are written once, and the three levels are made from them.
    """
    found = outcomes.filter("bad IS NOT NULL").groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    base = hosts.select(F.coalesce("host", F.lit("")).alias("host")).groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    every = found.unionByName(base).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = every.withColumn("domain", domain_of(F.col("host"), two_labels)).withColumn("suffix", suffix_of(F.col("host"), two_labels))
    every = (scratch or Scratch(hosts.sparkSession, "hosts")).keep(every, "counts")
    suffixes, s = _level(every, ["suffix"], "k_suffix")
    domains, d = _level(every, ["domain", "suffix"], "k_domain")
    _, h = _level(every, ["host"], "k_host")
    priors = F.broadcast(s.crossJoin(d).crossJoin(h))  # one row
    out = (
        every.join(suffixes.select("suffix", F.col("n").alias("n_s"), F.col("bad").alias("bad_s")), "suffix")
        .join(domains.select("domain", "suffix", F.col("n").alias("n_d"), F.col("bad").alias("bad_d")), ["domain", "suffix"])
        .crossJoin(priors)
    )
    m_s = (F.col("bad_s") + F.col("k_suffix") * F.col("p0")) / (F.col("n_s") + F.col("k_suffix"))
    out = out.withColumn("m_s", m_s)
    out = out.withColumn("m_d", (F.col("bad_d") + F.col("k_domain") * F.col("m_s")) / (F.col("n_d") + F.col("k_domain")))
    a, b = F.col("bad") + F.col("k_host") * F.col("m_d"), F.col("n") - F.col("bad") + F.col("k_host") * (1 - F.col("m_d"))
    out = out.withColumn("mean", a / (a + b)).withColumn("sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return out.select(
        "host", "n", "bad", "mean",
        F.greatest(F.col("mean") - z * F.col("sd"), F.lit(0.0)).alias("lower"),
        F.least(F.col("mean") + z * F.col("sd"), F.lit(1.0)).alias("upper"),
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), limit: float = 0.5, z: float = 1.645, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES
) -> DataFrame:
    """Every row of ``pages`` (any columns, ``url`` among them) with host, path, rule, verdict, bad_mean and bad_lower.

    A rule that fits decides. Else a page is blocked if even the lower posterior bound of its host's bad share is above
    ``limit``. NULL urls have an empty host, whose reputation is that of all rows without a host. Columns of ``pages``
    with the names above are replaced.
    """
    own = ("host", "path", "rule", "verdict", "bad_mean", "bad_lower")
    rows = pages.drop(*own).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    fame = host_reputation(outcomes, rows.select("host"), z, two_labels).select("host", F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
    rows = rows.join(fame, "host", "left").withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_lower") > limit, "block").otherwise("allow")
    return rows.select(
        *[c for c in pages.columns if c not in own], "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", method).alias("verdict"), "bad_mean", "bad_lower",
    )
