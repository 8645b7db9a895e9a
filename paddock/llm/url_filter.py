"""URL filter: explicit rules first, else empirical-Bayes host reputation, in SQL functions only.

Labelled page outcomes give each host, registered domain and suffix a share of bad
pages. Each level is shrunk towards the one above by a beta-binomial prior whose
strength is fitted to the spread of that level's groups; a host is blocked when the
lower posterior bound of its bad share lies above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

# fixed values: the rules as (verdict, rule); a rule is a host and a path prefix
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        hit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def spread(groups: DataFrame) -> DataFrame:
    """One row (mean, strength): overall bad share and the prior strength of groups (n, k).

    The intraclass correlation by the analysis-of-variance estimator; strength 1/rho - 1.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    s = groups.where("n > 0").agg(
        F.count(F.lit(1)).cast("double").alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kkn")
    )
    p = F.col("k") / F.col("n")
    between = (F.col("kkn") - F.col("k") * p) / (F.col("g") - 1)
    within = (F.col("k") - F.col("kkn")) / (F.col("n") - F.col("g"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("g") - 1)
    rho = (between - within) / (between + (n0 - 1) * within)
    rho = F.when((F.col("g") > 1) & (F.col("n") > F.col("g")) & (between + (n0 - 1) * within > 0), F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.999)))
    return s.select(F.coalesce(p, F.lit(0.5)).alias("mean"), (1 / F.coalesce(rho, F.lit(0.001)) - 1).alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Rows (host, n, k, bad_mean, bad_sd) from rows (host, bad): posterior bad share of every host.

    ``bad`` is 1, 0 or null (not labelled). Host, registered domain (its last two labels) and
    suffix (its last) are nested groups; each level's posterior mean is the prior mean of
    the one below. Sums of the lower level make up the next, so the pages are read once.
    """
    hosts = store(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")), "hosts")
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrink(groups: DataFrame, prior: Column, name: str) -> DataFrame:
        # one row of two numbers is joined to every group
        fitted = groups.join(F.broadcast(spread(groups)))
        mean = (F.col("k") + F.col("strength") * F.coalesce(prior, F.col("mean"))) / (F.col("n") + F.col("strength"))
        return fitted.withColumn(name, mean)

    s = shrink(suffixes, F.col("mean"), "suffix_mean").select("suffix", "suffix_mean")
    d = shrink(domains.join(s, "suffix"), F.col("suffix_mean"), "domain_mean").select("domain", "domain_mean")
    h = shrink(hosts.join(d, "domain"), F.col("domain_mean"), "bad_mean")
    sd = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + F.col("strength") + 1))
    return h.select("host", "n", "k", "bad_mean", sd.alias("bad_sd"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    z: float = 1.645,
    limit: float = 0.25,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_labelled, bad_mean, bad_low.

    ``outcomes`` has rows (page_id, bad) for some pages. The longest fitting rule decides;
    without one the page is blocked if its host's posterior mean less ``z`` posterior
    deviations exceeds ``limit``, else allowed. A null url, or one without ``://``, has an
    empty host and path: the empty host is a host like others. Rows with the same page_id
    get the same outcome; several outcomes of one page count as the worst. Null outcomes
    and null ids label nothing. An empty table gives no rows; other columns are ignored.

    Pages meet their labels by id and their host's one row by host; per-host sums are
    partial before the shuffle, and a host with most pages only makes a skewed join side,
    which can be split.
    """
    p = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    o = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = host_reputation(p.select("page_id", "host").join(o, "page_id", "left").select("host", "bad"))
    low = F.col("bad_mean") - z * F.col("bad_sd")
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        p.join(hosts, "host", "left")
        .withColumn("hit", hit)
        .select(
            "page_id",
            "host",
            "path",
            F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", F.when(low > limit, "block").otherwise("allow")).alias("verdict"),
            F.col("n").alias("n_labelled"),
            "bad_mean",
            low.alias("bad_low"),
        )
    )
