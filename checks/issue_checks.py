"""AGG-*, SCR-*, REC-*: merging, numbering, scoring, recommending."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog_checks import plain
from checks.registry import check
from checks.rule_checks import INCONSISTENT, nodes_of, raw_sql
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import fleet, issues, rules

# Backup severity used by the issue checks: by cluster, with every level.
SEVERITY = "SELECT DISTINCT cluster_id, CASE cluster_id % 5 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' ELSE 'OK' END AS severity FROM {nodes}"
EMPTY = "CAST(NULL AS VARCHAR)"
RAW = f"""SELECT cluster_id, node_ip, type, priority, scope, subject, dimension, n_objects, role, node_order FROM ({raw_sql()})
UNION ALL SELECT cluster_id, {EMPTY}, type, priority, 'cluster', subject, {EMPTY}, CAST(NULL AS BIGINT), {EMPTY}, {EMPTY} FROM ({INCONSISTENT})
UNION ALL SELECT cluster_id, {EMPTY}, 'backup_capability', severity, 'cluster', '', {EMPTY}, CAST(NULL AS BIGINT), {EMPTY}, {EMPTY} FROM ({SEVERITY}) WHERE severity <> 'OK'"""
MERGED = f"""
WITH raw AS ({RAW}), totals AS (SELECT cluster_id, count(*) AS n_total FROM {{nodes}} GROUP BY cluster_id),
grouped AS (SELECT cluster_id, type, subject, arg_min(priority, coalesce(node_order, '')) AS priority, min(priority) AS max_priority,
  min(node_order) AS first_order, arg_min(coalesce(node_ip, ''), coalesce(node_order, '')) AS ip, arg_min(coalesce(role, ''), coalesce(node_order, '')) AS role,
  max(n_objects) AS n_objects, count(node_ip) AS n_nodes, any_value(dimension) AS dimension FROM raw GROUP BY cluster_id, type, subject),
merged AS (SELECT cluster_id, type, subject, priority, max_priority, first_order, n_objects, n_nodes, n_total, dimension, NULLIF(ip, '') AS node_ip,
  CASE WHEN n_nodes = 1 THEN concat(ip, ' (', role, ')') WHEN n_nodes >= n_total OR ip = '' THEN 'all nodes' ELSE concat(n_nodes, '/', n_total, ' nodes') END AS node
FROM grouped JOIN totals USING (cluster_id))
"""
OUT = ["cluster_id", "type", "subject", "priority", "max_priority", "n_objects", "n_nodes", "n_total", "node"]


def severity(v):
    cluster = F.col("cluster_id")
    level = F.when(cluster % 5 == 0, "P0").when(cluster % 5 == 1, "P1").when(cluster % 5 == 2, "P2").otherwise("OK")
    return v["nodes"].select("cluster_id", "snapshot_date").distinct().withColumns(
        {"severity": level, "assessment": F.concat(F.lit("level "), level)}
    )


def raw(v):
    nodes = nodes_of(v)
    found = rules.evaluate_rules(nodes).unionByName(rules.parameter_issues(nodes))
    return issues.promote_backup(found, severity(v))


def merged(v):
    nodes = nodes_of(v)
    single, shared = rules.evaluate_by_scope(nodes)
    shared = issues.promote_backup(shared.unionByName(rules.parameter_issues(nodes)), severity(v))
    return issues.merge_issues(single, v["nodes"], shared)


@check("agg_01_merge_raw_issues", f"{MERGED} SELECT {', '.join(OUT)} FROM merged")
def _(v):
    return issues.merge_issues(raw(v), v["nodes"]).select(*OUT)


@check("agg_01_merge_issues", f"{MERGED} SELECT {', '.join(OUT)} FROM merged")
def _(v):
    return merged(v).select(*OUT)


@check("agg_01_issue_nodes", f"SELECT cluster_id, type, subject, node_ip, priority, n_objects FROM ({RAW}) WHERE node_ip IS NOT NULL")
def _(v):
    return plain(issues.issue_nodes(raw(v)))


@check("agg_02_number_issues", f"""{MERGED} SELECT cluster_id, type, subject, priority,
  row_number() OVER (PARTITION BY cluster_id ORDER BY priority, type, first_order NULLS FIRST, subject) AS seq FROM merged""")
def _(v):
    return issues.number_issues(merged(v)).select("cluster_id", "type", "subject", "priority", "seq")


@check("agg_03_promote_backup", f"SELECT cluster_id, 'backup_capability' AS type, severity AS priority FROM ({SEVERITY}) WHERE severity <> 'OK'")
def _(v):
    return issues.backup_issue(severity(v)).select("cluster_id", "type", "priority")


@check("agg_04_merge_double_trigger", """
WITH i AS (SELECT c_nationkey AS cluster_id, c_custkey AS k, c_custkey % 3 = 0 AS wild, c_custkey % 3 = 1 AND c_nationkey % 2 = 0 AS comp FROM customer),
t AS (SELECT cluster_id, bool_or(wild) AND bool_or(comp) AS twice FROM i GROUP BY cluster_id)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, k, twice AND wild AS dual_trigger FROM i JOIN t USING (cluster_id) WHERE NOT (twice AND comp)""")
def _(v):
    k, cluster = F.col("c_custkey"), F.col("c_nationkey")
    kind = (
        F.when(k % 3 == 0, "wildcard_critical")
        .when((k % 3 == 1) & (cluster % 2 == 0), "compliance_fail_no_wildcard_root")
        .otherwise("mem_high")
    )
    rows = v["customer"].select(
        cluster.cast("bigint").alias("cluster_id"), k.alias("k"), kind.alias("type"), F.lit("root is open").alias("description")
    )
    found = issues.merge_double_trigger(rows, ["cluster_id"])
    return found.select("cluster_id", "k", "dual_trigger")


@check("agg_05_issue_scope", f"{MERGED} SELECT cluster_id, type, subject, n_nodes >= n_total OR n_nodes > 1 OR node_ip IS NULL AS is_cluster_level FROM merged")
def _(v):
    return issues.issue_scope(merged(v)).select("cluster_id", "type", "subject", "is_cluster_level")


COUNTS = ", ".join(f"count(*) FILTER (priority = '{p}') AS {p.lower()}" for p in ("P0", "P1", "P2", "P3"))


@check("agg_06_priority_distribution", f"{MERGED} SELECT cluster_id, {COUNTS} FROM merged GROUP BY cluster_id")
def _(v):
    return plain(issues.priority_distribution(merged(v)))


BY_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(type, '{p}') THEN '{d}'" for d, p in fv.DIMENSION_PATTERNS) + " END"
CHARGED = f"charged AS (SELECT *, coalesce(dimension, {BY_TYPE}, 'availability') AS dim, CASE WHEN coalesce(dimension, {BY_TYPE}) IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM merged)"


@check("scr_01_issue_dimension", f"{MERGED}, {CHARGED} SELECT cluster_id, type, subject, dim AS dimension, factor FROM charged")
def _(v):
    return issues.issue_dimension(merged(v)).select("cluster_id", "type", "subject", "dimension", "factor")


@check("scr_01_documented_dimension", f"""{MERGED}, {CHARGED} SELECT cluster_id, type, subject,
  CASE WHEN type IN ('mysql_version_eol', 'mysql_version_security', 'slow_log_off') THEN 'operations' ELSE dim END AS dimension FROM charged""")
def _(v):
    return issues.issue_dimension(merged(v), documented=True).select("cluster_id", "type", "subject", "dimension")


BACKUP = "SELECT cluster_id, bool_or(k % 3 = 0) AS has_tool, bool_or(k % 4 = 1) AS has_artifact, bool_or(k % 5 = 2) AS has_cron FROM {nodes} GROUP BY cluster_id"
SECURITY = """SELECT cluster_id, coalesce(bool_or(has_encryption), FALSE) AS enc, coalesce(bool_or(have_ssl = 'YES'), FALSE) AS tls, coalesce(bool_or(has_audit), FALSE) AS aud
FROM {nodes} GROUP BY cluster_id"""
DIMS = ", ".join(f"('{d}')" for d in fv.DIMENSION_WEIGHTS)
SCORES = f"""{MERGED}, {CHARGED},
sums AS (SELECT cluster_id, dim, sum(CASE priority WHEN 'P0' THEN 18.0 WHEN 'P1' THEN 7.0 WHEN 'P2' THEN 3.0 WHEN 'P3' THEN 1.0 ELSE 0.0 END * factor) AS points FROM charged GROUP BY cluster_id, dim),
scores AS (SELECT b.cluster_id, d.dimension, CAST(greatest(0, least(100, floor(100 - coalesce(points, 0)
  - CASE d.dimension WHEN 'operations' THEN CASE WHEN has_tool THEN 0 ELSE 15 END + CASE WHEN has_artifact THEN 0 ELSE 15 END + CASE WHEN NOT has_cron AND (has_tool OR has_artifact) THEN 5 ELSE 0 END
    WHEN 'security' THEN CASE WHEN enc THEN 0 ELSE 5 END + CASE WHEN tls THEN 0 ELSE 5 END + CASE WHEN aud THEN 0 ELSE 3 END ELSE 0 END + 0.5))) AS BIGINT) AS score
FROM ({BACKUP}) b JOIN ({SECURITY}) s USING (cluster_id) CROSS JOIN (VALUES {DIMS}) d(dimension) LEFT JOIN sums ON sums.cluster_id = b.cluster_id AND sums.dim = d.dimension)
"""


def evidence(v):
    k = F.col("k")
    backup = v["nodes"].groupBy("cluster_id", "snapshot_date").agg(
        F.bool_or(k % 3 == 0).alias("has_tool"), F.bool_or(k % 4 == 1).alias("has_artifact"), F.bool_or(k % 5 == 2).alias("has_backup_cron")
    )
    security = v["nodes"].groupBy("cluster_id", "snapshot_date").agg(
        F.bool_or("has_encryption").alias("has_encryption"), F.bool_or(F.col("have_ssl") == "YES").alias("has_tls"), F.bool_or("has_audit").alias("has_audit")
    )
    return backup, security


def scores(v):
    backup, security = evidence(v)
    return issues.dimension_scores(merged(v), fleet.topology(v["nodes"]), backup, security)


@check("scr_02_dimension_scores", f"{SCORES} SELECT cluster_id, dimension, score FROM scores")
def _(v):
    return plain(scores(v))


WEIGHTS = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {round(w * 100)}" for d, w in fv.DIMENSION_WEIGHTS.items()) + " END"
TOTALS = f"totals2 AS (SELECT cluster_id, CAST(floor(sum(score * {WEIGHTS}) / 100.0 + 0.5) AS BIGINT) AS total FROM scores GROUP BY cluster_id)"


@check("scr_03_total_score", f"{SCORES}, {TOTALS} SELECT cluster_id, total FROM totals2")
def _(v):
    return plain(issues.total_score(scores(v)))


@check("scr_04_overall_label", f"""{SCORES}, {TOTALS}, worst AS (SELECT cluster_id, min(priority) AS p FROM merged GROUP BY cluster_id)
SELECT cluster_id, CASE p WHEN 'P0' THEN 'urgent risks, act now' WHEN 'P1' THEN 'stable, with important problems to solve soon' ELSE 'stable, with suggestions' END AS label, total
FROM worst JOIN totals2 USING (cluster_id)""")
def _(v):
    found = merged(v)
    backup, security = evidence(v)
    clusters = fleet.topology(v["nodes"])
    totals = issues.total_score(issues.dimension_scores(found, clusters, backup, security))
    return plain(issues.overall_label(clusters, found, totals))


LEVEL = "CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 55 THEN 'medium' WHEN score >= 40 THEN 'poor' ELSE 'critical' END"


@check("scr_05_score_levels", f"{SCORES} SELECT cluster_id, dimension, score, {LEVEL} AS level FROM scores")
def _(v):
    return plain(issues.score_levels(scores(v)))


@check("rec_01_recommendations", f"""{MERGED}, n AS (SELECT cluster_id, count(*) AS n FROM {{nodes}} GROUP BY cluster_id)
SELECT cluster_id, CASE priority WHEN 'P0' THEN 'immediate' WHEN 'P1' THEN 'short_term' ELSE 'mid_term' END AS horizon, concat(type, '-', subject) AS text
FROM merged WHERE priority IN ('P0', 'P1', 'P2') GROUP BY ALL
UNION ALL SELECT cluster_id, 'long_term', t FROM n, (VALUES {", ".join(f"('{t}')" for t in issues.LONG_TERM)}) l(t)
UNION ALL SELECT cluster_id, 'long_term', '{issues.LONG_TERM_REPLICATED}' FROM n WHERE n >= 3""")
def _(v):
    found = merged(v).withColumns({"description": F.concat_ws("-", "type", "subject"), "action": F.lit(None).cast("string")})
    return plain(issues.recommendations(found, fleet.topology(v["nodes"])))
