"""URL filter: path rules, and empirical-Bayes host reputation where no rule fits (DataFrame
operations only).

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. The
bad rate of each level shrinks towards that of the level above: with the level's prior strength k
(one for each level, fitted by moments over its members) and the mean m of the level above, the
posterior of a member with b bad of n is Beta(k m + b, k (1 - m) + n - b). A host is blocked
if the lower bound of its posterior (mean less ``z`` standard deviations) passes ``threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import materialize
from ._common import ascii_lower

#: Second-level names that act as public suffixes under a two-letter country name.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Fixed values: (verdict, host, path) of the default rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The rules of the contract of op6, which its query and SQL take.
CONTRACT = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def public_suffix(host: Column) -> Column:
    """The last label of the bare host (no user, no port), or the last two for names like co.uk."""
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.regexp_extract(bare, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.substring_index(bare, ".", -1))


def registered_domain(host: Column) -> Column:
    """The suffix and the label before it; the bare host where there is none."""
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    labels = F.size(F.split(public_suffix(host), r"\.")) + 1
    return F.when(labels == 2, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -3))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(default: float) -> Column:
    """Prior strength by moments of the members' rates about their parents' means: with mean m and
    n trials, E (b/n - m)^2 = m (1 - m) (1/n + (1 - 1/n) rho), and k = 1 / rho - 1, kept in
    [0.5, 1000]. ``default`` where no member can tell."""
    spread = F.col("m") * (1 - F.col("m"))
    deviation = F.pow(F.col("b") / F.col("n") - F.col("m"), 2) - spread / F.col("n")
    rho = F.try_divide(F.sum(deviation), F.sum(spread * (1 - 1 / F.col("n"))))
    return F.when(rho.isNull(), default).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(0.5), 1 / F.greatest(rho, F.lit(1e-9)) - 1))).alias("k")


def host_reputation(outcomes: DataFrame, z: float = 1.645, default: float = 2.0) -> DataFrame:
    """Outcomes ``(host, bad)``, bad 0, 1 or null (unlabelled), to a row per host: host, n, b,
    mean and the lower posterior bound. A host without labels takes the mean of its domain,
    suffix or everything; without any labels at all the mean is 0.5.

    Counts combine on the map side, so a hot host costs no more than a cold one.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("b"))
    hosts = materialize(hosts, "hosts")
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": public_suffix(F.col("host"))})
    # Hosts of one domain share its suffix, so each level sums the one below.
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    top = suffixes.agg(F.try_divide(F.sum("b"), F.sum("n"))).first()[0]

    def posterior(members: DataFrame) -> DataFrame:
        k = members.where("n > 0").agg(_strength(default)).first()[0]
        return members.withColumn("k", F.lit(k)).withColumn("mean", (F.col("k") * F.col("m") + F.col("b")) / (F.col("k") + F.col("n")))

    suffixes = posterior(suffixes.withColumn("m", F.lit(0.5 if top is None else top))).select("suffix", F.col("mean").alias("m"))
    domains = posterior(domains.join(suffixes, "suffix")).select("domain", "suffix", F.col("mean").alias("m"))
    hosts = posterior(hosts.join(domains, ["domain", "suffix"]))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("k") + F.col("n") + 1))
    return hosts.select("host", "n", "b", "mean", (F.col("mean") - z * sd).alias("lower"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, bad: Column | None = None, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """A row for each row of ``pages``: page_id, host, path, rule, verdict.

    The verdict is the longest fitting rule's, else block where the host's lower posterior bound
    passes ``threshold``, else allow. The labelled outcomes are ``bad`` (0, 1 or null) where given,
    else the verdicts of the rules on the pages they fit. A null url, or one without ``://``, has
    an empty host and path; all such pages form one host. Repeated rows count each. An empty table
    gives an empty result. Other columns are not read.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (bad.cast("int") if bad is not None else F.lit(None).cast("int")).alias("bad"))
    rule, ruling = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruling": ruling})
    if bad is None:
        rows = rows.withColumn("bad", F.when(F.col("ruling") == "block", 1).when(F.col("ruling") == "allow", 0))
    hosts = host_reputation(rows.select("host", "bad"), z).select("host", "lower")
    method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return rows.join(hosts, "host").select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"))
