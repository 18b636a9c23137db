"""URL filter: rules indexed by their rarest literal token.

The library has no table of URLs, so the operator is general: it takes any
table with an address column, such as links found in reports. Only DataFrame
functions are used.

Two kinds of rules. Site rules name a host, an optional path prefix and a
verdict; the longest that fits wins. Pattern rules are regular expressions; a
URL that no site rule fits is blocked when one of them matches.

A rule is indexed under one of its literal tokens: the one that the fewest
distinct URLs hold. A URL's tokens fetch its candidate rules, and only those run.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word-like runs of the address; a literal token of a pattern must be a whole such run, as \b around it makes sure.
TOKEN = r"[a-z0-9]+"

# Patterns for addresses that no site rule knows. Each alternative holds a whole literal token.
DEFAULT_PATTERNS = (
    r"\bspam\b",
    r"\badult\b",
    r"\bcasino\b",
    r"\bporn\b",
    r"\bxxx\b",
    r"\bpoker\b",
    r"\bviagra\b",
    r"\btorrent\b",
    r"\bphishing\b",
    r"\bmalware\b",
)


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end; empty without '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def pattern_tokens(pattern: str) -> list[str]:
    """Literal tokens that every match of a pattern holds as a whole token: those between two \\b."""
    if "|" in pattern or "(?" in pattern:
        return []
    return re.findall(rf"\\b({TOKEN})(?=\\b)(?!\\b[?*{{])", pattern)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0))


def filter_urls(
    urls: DataFrame,
    site_rules: Sequence[tuple[str, str, str]],
    patterns: Sequence[str] = DEFAULT_PATTERNS,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Every row of the table with (host, path, rule, verdict); columns of these names are replaced.

    site_rules: (host, path prefix, verdict); a rule fits its host and all its
    subdomains, if the path starts with the prefix. Of those that fit, the one
    with the longest text wins, ties going to the one listed first. rule is
    null where none fits; the verdict is then 'block' if a pattern matches the
    URL, else the default. Patterns match the URL in lower case.

    Null and malformed URLs have an empty host and path, no rule and, unless a
    pattern matches, the default. Repeated rows are judged alike; an empty
    table gives an empty table. A pattern without a whole literal token cannot
    be indexed and is tried on every URL.
    """
    spark = urls.sparkSession
    known = urls.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct()
    tokens = known.select("u", F.explode(_tokens(F.col("u"))).alias("token"))
    rules = [
        (i, "site", f"{host}{path}", verdict, host.lower(), path, None, re.findall(TOKEN, host.lower()))
        for i, (host, path, verdict) in enumerate(site_rules)
    ] + [(len(site_rules) + i, "pattern", None, "block", None, None, p, pattern_tokens(p)) for i, p in enumerate(patterns)]
    schema = (
        "rule_no int, kind string, name string, rule_verdict string, rule_host string, rule_path string, "
        "pattern string, literals array<string>"
    )
    table = spark.createDataFrame(rules, schema)
    literals = table.select("rule_no", F.explode("literals").alias("token"))
    # How many URLs hold each literal; counted over all URLs, only for tokens that rules have.
    held = tokens.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        literals.join(held, "token", "left")
        .groupBy("rule_no")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    indexed = table.drop("literals").join(rarest, "rule_no")
    plain = table.where(F.size("literals") == 0).drop("literals")
    candidates = tokens.join(indexed, "token").drop("token")
    if any(not rule[-1] for rule in rules):
        # Bounded by the number of rules without a literal, which the caller wrote.
        every = F.array(*[F.lit(rule[0]) for rule in rules if not rule[-1]])
        candidates = candidates.unionByName(known.withColumn("rule_no", F.explode(every)).join(plain, "rule_no"))
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    fits = F.when(
        F.col("kind") == "site",
        ((host == F.col("rule_host")) | host.endswith(F.concat(F.lit("."), F.col("rule_host"))))
        & path.startswith(F.col("rule_path")),
    ).otherwise(F.regexp_like(F.lower("u"), F.coalesce("pattern", F.lit("(?!)"))))
    found = candidates.where(fits)
    site = F.when(F.col("kind") == "site", F.struct(F.length("name").alias("n"), (-F.col("rule_no")).alias("o"), "name", "rule_verdict"))
    judged = found.groupBy("u").agg(F.max(site).alias("best"), F.max(F.col("kind") == "pattern").alias("matched"))
    verdict = F.coalesce("best.rule_verdict", F.when(F.col("matched"), F.lit("block")), F.lit(default))
    judged = judged.select("u", F.col("best.name").alias("rule"), verdict.alias("verdict"))
    # Given columns go under names of their own, so that any may be called as one of those here.
    given = {c: f"c{i}" for i, c in enumerate(urls.columns)}
    rows = urls.select(*[F.col(f"`{c}`").alias(a) for c, a in given.items()])
    joined = rows.join(judged, F.col(given[url]) == F.col("u"), "left")
    return joined.select(
        *[F.col(a).alias(c) for c, a in given.items() if c not in ("host", "path", "rule", "verdict")],
        host_of(F.col(given[url])).alias("host"),
        path_of(F.col(given[url])).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
