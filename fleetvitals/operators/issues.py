"""Merging, numbering, scoring and recommending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S
from fleetvitals.functions.once import made_once
from fleetvitals.operators.ranking import range_row_number
from fleetvitals.sources.config import Config, apply_config

MERGED = [
    "priority", "scope", "dimension", "description", "current_value",
    "recommended_value", "needs_confirmation", "node_ip", "role",
]
DIMENSIONS = list(fv.DIMENSION_WEIGHTS)


def _shared() -> Column:
    return F.col("scope") == "cluster"


def merge_issues(
    raw: DataFrame, nodes: DataFrame, shared: DataFrame | None = None, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """Issues of one group become one: the first node's values, worded as the node with the most objects words it.

    raw holds every issue, or only those of single nodes when the shared ones
    are passed apart.

    An issue whose group is its own node has nothing to merge with and skips
    the shuffle. Counts are over distinct nodes: a rule fires at most once per
    node and subject. The list of affected nodes stays in issue_nodes, so no
    group's nodes are ever collected into one row.
    """
    alone, together = (raw.filter(~_shared()), raw.filter(_shared())) if shared is None else (raw, shared)
    single = alone.select(
        *cluster_keys,
        "type",
        "subject",
        *MERGED,
        F.col("priority").alias("max_priority"),
        F.col("node_order").alias("first_order"),
        "n_objects",
        F.lit(1).cast("bigint").alias("n_nodes"),
    )
    # Issues that belong to no node have no order; they still need a first one.
    first = F.min_by(F.struct(*MERGED), F.coalesce("node_order", F.lit("")))
    grouped = (
        together.groupBy(*cluster_keys, "type", "subject")
        .agg(
            first.alias("f"),
            # The text names a number of objects, so it goes with n_objects: the largest, of the first such node.
            F.min_by("description", F.struct(-F.coalesce("n_objects", F.lit(0)), F.coalesce("node_order", F.lit("")))).alias("text"),
            F.min("priority").alias("max_priority"),
            F.min("node_order").alias("first_order"),
            F.max("n_objects").alias("n_objects"),
            F.count("node_ip").alias("n_nodes"),
        )
        .select(
            *cluster_keys,
            "type",
            "subject",
            *[F.col("text" if c == "description" else f"f.{c}").alias(c) for c in MERGED],
            "max_priority",
            "first_order",
            "n_objects",
            "n_nodes",
        )
    )
    totals = nodes.groupBy(*cluster_keys).agg(F.count(F.lit(1)).alias("n_total"))
    merged = single.unionByName(grouped).join(totals, cluster_keys, "left")
    everywhere = (F.col("n_nodes") >= F.col("n_total")) | F.col("node_ip").isNull()
    label = (
        F.when((F.col("n_nodes") == 1) & F.col("node_ip").isNotNull(), F.format_string("%s (%s)", "node_ip", "role"))
        .when(everywhere, "all nodes")
        .otherwise(F.format_string("%d/%d nodes", "n_nodes", "n_total"))
    )
    return merged.withColumn("node", label)


def issue_nodes(raw: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Every node of every issue, one row each."""
    return raw.filter(F.col("node_ip").isNotNull()).select(
        *cluster_keys, "type", "subject", "node_ip", "priority", "n_objects"
    )


def number_issues(issues: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """seq by priority, then type, then first node; a huge cluster is numbered by many tasks."""
    return range_row_number(issues, cluster_keys, ["priority", "type", "first_order", "subject"], "seq")


def backup_issue(severity: DataFrame, config: Config | None = None, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """The backup assessment as a raw issue per cluster."""
    none = F.lit(None).cast("string")
    rows = severity.filter(F.col("severity") != "OK").select(
        *cluster_keys,
        none.alias("node_ip"),
        none.alias("role"),
        none.alias("node_order"),
        F.lit("backup_capability").alias("type"),
        F.col("severity").alias("priority"),
        F.lit("cluster").alias("scope"),
        F.lit("").alias("subject"),
        none.alias("dimension"),
        F.lit(None).cast("bigint").alias("n_objects"),
        F.concat(F.lit("backup capability: "), "assessment").alias("description"),
        none.alias("current_value"),
        none.alias("recommended_value"),
        F.lit(False).alias("needs_confirmation"),
    )
    return apply_config(rows, config or Config())


def promote_backup(raw: DataFrame, severity: DataFrame, config: Config | None = None) -> DataFrame:
    return raw.unionByName(backup_issue(severity, config))


def merge_double_trigger(issues: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Root open to every host, found twice, is reported once.

    The second input is no longer produced by the rules, so this changes
    nothing unless a caller adds compliance issues. Only the flags of the few
    matching issues are grouped and joined back.
    """
    compliance = "compliance_fail_no_wildcard_root"
    root = (F.col("type") == "wildcard_critical") & F.lower("description").contains("root")
    flags = (
        issues.filter(root | (F.col("type") == compliance))
        .groupBy(*cluster_keys)
        .agg((F.bool_or(root) & F.bool_or(F.col("type") == compliance)).alias("_twice"))
        .filter("_twice")
    )
    joined = issues.join(flags, cluster_keys, "left")
    twice = F.coalesce("_twice", F.lit(False))
    return (
        joined.filter(~(twice & (F.col("type") == compliance)))
        .withColumn("dual_trigger", twice & root)
        .drop("_twice")
    )


def issue_scope(issues: DataFrame) -> DataFrame:
    cluster_level = (F.col("n_nodes") >= F.col("n_total")) | (F.col("n_nodes") > 1) | F.col("node_ip").isNull()
    return issues.withColumn("is_cluster_level", cluster_level)


def priority_distribution(issues: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    return issues.groupBy(*cluster_keys).agg(
        *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in fv.PENALTY]
    )


def issue_dimension(issues: DataFrame, documented: bool = False) -> DataFrame:
    """Dimension and penalty factor: explicit, else by type, else half to availability."""
    return issues.withColumns(_dimension_columns(documented))


@made_once
def _dimension_columns(documented: bool) -> dict[str, Column]:
    by_type = S.first_case([(F.col("type").rlike(p), F.lit(d)) for d, p in fv.DIMENSION_PATTERNS])
    options = [F.col("dimension")]
    if documented:
        docs = F.create_map(*[F.lit(x) for pair in fv.DOCUMENTED_DIMENSIONS.items() for x in pair])
        options.append(docs[F.col("type")])
    found = F.coalesce(*options, by_type)
    return {
        "dimension": F.coalesce(found, F.lit("availability")),
        "factor": F.when(found.isNotNull(), 1.0).otherwise(0.5),
    }


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def dimension_scores(
    issues: DataFrame,
    clusters: DataFrame,
    backup: DataFrame,
    security: DataFrame,
    cluster_keys: list[str] = CLUSTER_KEYS,
    documented: bool = False,
) -> DataFrame:
    """Score per cluster and dimension.

    clusters: one row per cluster. backup: has_tool, has_artifact,
    has_backup_cron. security: has_encryption, has_tls, has_audit. Penalties
    become one wide row per cluster, so a cluster with many issues is summed
    map-side.
    """
    sums = issue_dimension(issues, documented).groupBy(*cluster_keys).agg(*_penalty_sums())
    wide = (
        clusters.select(*cluster_keys)
        .join(sums, cluster_keys, "left")
        .join(backup, cluster_keys, "left")
        .join(security, cluster_keys, "left")
    )
    return wide.select(*cluster_keys, _score_rows()).select(*cluster_keys, "r.*")


@made_once
def _penalty_sums() -> list[Column]:
    penalties = F.create_map(*[F.lit(x) for pair in fv.PENALTY.items() for x in pair])
    points = F.coalesce(penalties[F.col("priority")], F.lit(0.0)) * F.col("factor")
    return [F.sum(F.when(F.col("dimension") == d, points)).alias(d) for d in DIMENSIONS]


@made_once
def _score_rows() -> Column:
    """A row per dimension, from penalties and evidence side by side."""

    def missing(name: str, cost: float) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit(False)), 0.0).otherwise(cost)

    tool, artifact = F.coalesce("has_tool", F.lit(False)), F.coalesce("has_artifact", F.lit(False))
    cron = F.coalesce("has_backup_cron", F.lit(False))
    extra = {
        "operations": missing("has_tool", 15.0)
        + missing("has_artifact", 15.0)
        + F.when(~cron & (tool | artifact), 5.0).otherwise(0.0),
        "security": missing("has_encryption", 5.0) + missing("has_tls", 5.0) + missing("has_audit", 3.0),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.greatest(
                    F.lit(0),
                    F.least(
                        F.lit(100),
                        round_half_up(F.lit(100.0) - F.coalesce(F.col(d), F.lit(0.0)) - extra.get(d, F.lit(0.0))),
                    ),
                )
                .cast("bigint")
                .alias("score"),
            )
            for d in DIMENSIONS
        ]
    )
    return F.explode(rows).alias("r")


def total_score(scores: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Weighted total. Weights are hundredths, so the sum is exact before rounding."""
    weights = F.create_map(
        *[F.lit(x) for d, w in fv.DIMENSION_WEIGHTS.items() for x in (d, round(w * 100))]
    )
    return scores.groupBy(*cluster_keys).agg(
        round_half_up(F.sum(F.col("score") * weights[F.col("dimension")]) / 100.0).cast("bigint").alias("total")
    )


def score_levels(scores: DataFrame) -> DataFrame:
    return scores.withColumn("level", S.score_level("score"))


def overall_label(
    clusters: DataFrame, issues: DataFrame, totals: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    found = issues.groupBy(*cluster_keys).agg(F.min("priority").alias("worst"))
    label = (
        F.when(F.col("worst") == "P0", "urgent risks, act now")
        .when(F.col("worst") == "P1", "stable, with important problems to solve soon")
        .when(F.col("worst").isNotNull(), "stable, with suggestions")
        .otherwise("stable, no problems found")
    )
    return (
        clusters.select(*cluster_keys)
        .join(found, cluster_keys, "left")
        .join(totals, cluster_keys, "left")
        .select(*cluster_keys, label.alias("label"), "total")
    )


# Recommendations every report ends with.
LONG_TERM = [
    "Report slow statements daily and keep tuning them",
    "Drill a restore every quarter",
    "Monitor disks, delay, load, connections, slow statements and binlog growth",
]
LONG_TERM_REPLICATED = "Use semi-synchronous replication with automatic failover"


def recommendations(issues: DataFrame, totals: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Distinct advice per horizon: (cluster, horizon, text). totals holds n_nodes per cluster."""
    horizon = (
        F.when(F.col("priority") == "P0", "immediate")
        .when(F.col("priority") == "P1", "short_term")
        .when(F.col("priority") == "P2", "mid_term")
    )
    from_issues = (
        issues.select(
            *cluster_keys, horizon.alias("horizon"), F.concat_ws(": ", "description", "action").alias("text")
        )
        .filter(F.col("horizon").isNotNull())
        .distinct()
    )
    replicated = F.when(F.col("n_nodes") >= 3, F.lit(LONG_TERM_REPLICATED))
    texts = F.filter(F.array(replicated, *[F.lit(t) for t in LONG_TERM]), lambda t: t.isNotNull())
    always = totals.select(*cluster_keys, F.lit("long_term").alias("horizon"), F.explode(texts).alias("text"))
    return from_issues.unionByName(always)
