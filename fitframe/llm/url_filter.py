"""URL verdicts from rules and from the reputation of hosts.

A rule that fits decides. Otherwise a host's share of good pages does: outcomes
are counted per host, registered domain and suffix, and each level's beta prior
is centred on the posterior mean of the level above, with a weight estimated
from how far the groups of that level lie apart. A page is blocked when the
upper bound of its host's posterior stays below ``least_good``, so a host with
little evidence keeps the benefit of the doubt.

A page's outcome comes from what it says: its passages (text between tags, of
``LEAST_PASSAGE`` characters or more) are looked up among the lines of labelled
documents. A line is good when at least half of the labelled documents that hold
it are, and a page when at least half of its passages that are found are good.
A passage counts once a page and a line once a document.

The registered domain is the last two labels of a host and the suffix its last
one; there is no public list of suffixes to consult here.

Defined cases: a null url or one without ``://`` has an empty host and an empty
path, fits no rule, and is judged by the empty host's record; pages without a
passage of a labelled document, null and empty ``html`` among them, count for
nothing; of several labels of one document all must be good, and those without a
quality or an id are left out; repeated rows are judged, and counted, once each;
without any label every page that no rule fits is allowed. Only ``page_id``,
``url`` and ``html``, ``doc_id`` and ``text``, and the labels are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fitframe.llm.common import hot_join
from fitframe.plans.scratch import Scratch

# Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEVELS = ("suffix", "domain", "host")
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
LEAST_PASSAGE = 30
# Character references and what they stand for, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path, both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://(.*)", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, effect in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(effect)).otherwise(verdict)
    return rule, verdict


def with_levels(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn(
        "domain", F.substring_index("host", ".", -2)
    )


def prior_weight(groups: DataFrame) -> float:
    """The beta prior's weight from ``groups(n, good, prior)``, by moments.

    The variance t2 of the groups' true shares is what their squared distances
    from the prior mean hold beyond chance; the weight is m(1 - m) / t2 - 1.
    """
    m = F.col("prior")
    chance = m * (1 - m)
    distance = F.pow(F.col("good") / F.col("n") - m, F.lit(2.0))
    n, level, noise, spread = groups.where("n > 0").agg(
        F.sum("n"), F.sum(F.col("n") * chance), F.sum(chance), F.sum(F.col("n") * distance)
    ).first()
    if not n or spread <= noise:
        return MOST_WEIGHT
    return min(max(level / (spread - noise) - 1, LEAST_WEIGHT), MOST_WEIGHT)


def reputations(outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, share, deviation``: the posterior of ``outcomes(host, n, good)``.

    ``outcomes`` has every host, with zeros where no page has an outcome.
    """
    n, good = outcomes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    known = with_levels(outcomes.select("host", "n", "good")).withColumn("prior", F.lit((good + 1.0) / (n + 2.0)))
    for level in LEVELS:
        groups = known.groupBy(level).agg(
            F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("prior").alias("prior"),
            F.count(F.lit(1)).alias("hosts"),
        )
        groups = scratch.store(groups, level).df
        weight = prior_weight(groups)
        a = F.col("good") + weight * F.col("prior")
        whole = F.col("n") + weight
        share = a / whole
        deviation = F.sqrt(share * (1 - share) / (whole + 1))
        posterior = groups.select(level, share.alias("prior"), deviation.alias("deviation"))
        # One suffix, or one domain, can have most hosts.
        sizes = groups.select(level, F.col("hosts").alias("size"))
        known = hot_join(known.drop("prior", "deviation"), posterior, level, sizes, scratch)
        known = scratch.store(known, f"by_{level}").df
    return known.select("host", F.col("prior").alias("share"), "deviation")


def passages(pieces: Column) -> Column:
    """Hashes of the distinct pieces that are long enough, without white space around them."""
    trimmed = F.transform(pieces, lambda p: F.btrim(p, F.lit(" \t\r\n")))
    return F.array_distinct(
        F.transform(F.filter(trimmed, lambda p: F.length(p) >= LEAST_PASSAGE), lambda p: F.xxhash64(p))
    )


def page_passages(html: Column) -> Column:
    def plain(piece: Column) -> Column:
        for reference, character in REFERENCES:
            piece = F.replace(piece, F.lit(reference), F.lit(character))
        return piece

    return passages(F.transform(F.split(html, "<[^>]*>"), plain))


def line_verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``passage, good``: 1 if at least half of the labelled documents with that line are good.

    A document is good with quality 1 and toxic 0.
    """
    is_good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    verdicts = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(is_good.cast("long")).alias("good")
    )
    lines = documents.select("doc_id", passages(F.split("text", "\n")).alias("passages"))
    held = lines.join(verdicts, "doc_id").select(F.explode("passages").alias("passage"), "good")
    share = F.sum("good") * 2 >= F.count(F.lit(1))
    return held.groupBy("passage").agg(share.cast("long").alias("good"))


def page_outcomes(pages: DataFrame, verdicts: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, pages, n, good``: all pages of every host, those with an outcome, and the good ones.

    ``pages`` has ``host`` and ``html``, ``verdicts`` is ``line_verdicts``.
    """
    numbered = pages.select(
        F.monotonically_increasing_id().alias("row"), "host", page_passages(F.col("html")).alias("passages")
    )
    # Stored, so that a lost task cannot number the rows anew.
    met = scratch.store(numbered.select("row", "host", F.explode("passages").alias("passage")), "passages").df
    # Navigation and notices can stand on every page.
    sizes = met.groupBy("passage").agg(F.count(F.lit(1)).alias("size"))
    found = hot_join(met, scratch.store(verdicts, "lines").df, "passage", sizes, scratch)
    judged = found.groupBy("row", "host").agg((F.sum("good") * 2 >= F.count(F.lit(1))).cast("long").alias("good"))
    counted = judged.select("host", F.lit(0).alias("pages"), F.lit(1).alias("n"), "good")
    every = pages.select("host", F.lit(1).alias("pages"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("good"))
    return every.unionByName(counted).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "good")))


def judged_urls(
    pages: DataFrame, documents: DataFrame, labels: DataFrame, rules=RULES, least_good: float = 0.5, z: float = 1.645
) -> DataFrame:
    """``page_id, host, path, rule, verdict, share`` for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    said = pages.select(host.alias("host"), "html")
    hosts = scratch.store(page_outcomes(said, line_verdicts(documents, labels), scratch), "hosts").df
    upper = F.col("share") + z * F.col("deviation")
    records = reputations(hosts, scratch).select("host", "share", (upper < least_good).alias("bad"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    # One host can have a third of all pages.
    together = hot_join(split, records, "host", hosts.select("host", F.col("pages").alias("size")), scratch)
    return together.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "share"
    )
