"""URL filters: reputation of hosts by empirical Bayes, shrunk from host to registered domain to suffix.

Labelled pages give each host good and bad outcomes. A suffix's share of good pages is
shrunk to the whole table's, a domain's to its suffix's, and a host's to its domain's, each
by a beta prior whose weight is estimated from how far the groups of that level differ
(method of moments for the beta-binomial). A host without labels has its domain's prior,
an unknown domain its suffix's. The verdict looks at a bound of the host's posterior, so
a few bad pages do not block a host, and many do. Rules on host and path come first.
"""

from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import pick, stored

# Suffixes of two labels; all others have one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Weights of priors stay between these many pages.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 200.0


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null without one.

    ``rules`` are (action, pattern) pairs, a pattern being a host and a path. It fits that
    host and its subdomains where the path starts with the pattern's. Of equally long rules the
    one that sorts first wins.
    """
    rule = action = F.lit(None).cast("string")
    for act, pattern in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, tail = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, action = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def levels_of(host: Column) -> tuple[Column, Column, Column]:
    """(name, domain, suffix) of a host, without user and port: the last label is the suffix, or the last two of known ones; one more makes the registered domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    known = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(known, two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    three = F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    domain = F.when(known & (three != ""), three).when(~known & (two != ""), two).otherwise(name)
    return name, domain, suffix


def prior_weight(groups: DataFrame) -> Column:
    """Pages a group's prior is worth, from the spread of the groups' shares beyond what chance gives.

    ``groups`` has ``good`` and ``n`` of each group. Groups that differ no more than by chance get the most, a table
    without labels the least. Rounded, so the order of summing does not show.
    """
    sums = groups.filter("n > 0").agg(
        F.sum("n").cast("double").alias("pages"), F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("groups"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("spread"),
    )
    p = F.col("good") / F.col("pages")
    chance = p * (1 - p)
    room = F.col("pages") - F.col("squares") / F.col("pages") - (F.col("groups") - 1)
    beyond = (F.col("spread") - p * F.col("good")) / chance - (F.col("groups") - 1)
    share = F.when((chance > 0) & (room > 0), F.round(beyond / room, 6))
    weight = F.when(F.col("pages").isNull(), F.lit(LEAST_WEIGHT)).when(share > 0, (1 - share) / share).otherwise(F.lit(MOST_WEIGHT))
    return sums.select(F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), weight))).scalar()


def host_posteriors(pages: DataFrame) -> DataFrame:
    """(name, n, good, mean, weight) of each host of ``pages`` (name, domain, suffix, outcome): the posterior's mean and the pages it is worth."""
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    outcome = F.col("outcome")
    # Read for every level and weight, so it is written once: a row per host.
    hosts = stored(pages.groupBy("name", "domain", "suffix").agg(F.coalesce(F.sum(outcome), F.lit(0)).alias("good"), F.count(outcome).alias("n")))
    domains, suffixes = sums(hosts, "domain", "suffix"), sums(hosts, "suffix")
    whole = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean")).select("mean").scalar()
    shrunk = lambda prior, weight: (F.col("good") + weight * prior) / (F.col("n") + weight)
    suffix_means = suffixes.select("suffix", shrunk(whole, prior_weight(suffixes)).alias("suffix_mean"))
    domain_means = domains.join(suffix_means, "suffix").select("domain", "suffix", shrunk(F.col("suffix_mean"), prior_weight(domains)).alias("domain_mean"))
    weight = prior_weight(hosts)
    found = hosts.join(domain_means, ["domain", "suffix"])
    return found.select("name", "n", "good", shrunk(F.col("domain_mean"), weight).alias("mean"), (F.col("n") + weight).alias("weight"))


def host_verdicts(pages: DataFrame, labels: DataFrame, rules=(), least_good: float = 0.7, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, host, path, rule, verdict, n_labelled, n_good, posterior_mean, upper_bound) of every page.

    A page's outcome is the label of its id, 1 good and 0 bad; of several labels the smallest
    counts, others than 0 and 1 do not. The verdict is the longest fitting rule's, else ``block`` where the upper bound,
    the posterior's mean plus ``z`` deviations, is below ``least_good``, else ``allow``. Pages without
    a host are one host, the empty one. Null ids have no outcome. Repeated rows are judged
    each, and their outcome counts each time. An empty table gives no rows.
    """
    urls = pick(pages, id=id_col, url=url_col).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, domain, suffix = levels_of(F.col("host"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    judged = urls.withColumns({"name": name, "domain": domain, "suffix": suffix, "rule": rule, "action": action})
    outcomes = pick(labels, id=label_id, outcome=label_col).filter(F.col("outcome").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("outcome").cast("bigint").alias("outcome"))
    posteriors = host_posteriors(judged.select("id", "name", "domain", "suffix").join(outcomes, "id", "left"))
    bound = F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    method = F.when(bound < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(posteriors, "name").select(
        "id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("good").alias("n_good"), F.round("mean", 4).alias("posterior_mean"), F.round(bound, 4).alias("upper_bound"),
    )
