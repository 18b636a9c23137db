"""BKP-*, SEC-*: backup capability and security posture."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog_checks import K, plain
from checks.registry import check
from checks.rule_checks import nodes_of
from checks.scalar_checks import LEVEL_SQL, REASON_SQL
from fleetvitals.operators import assess, fleet

TOOLING = """SELECT b.cluster_id, tool, arg_min(installed, node_order) AS installed, arg_min(detail, node_order) AS detail
FROM {backup_tools} b JOIN {nodes} n USING (cluster_id, node_ip) GROUP BY b.cluster_id, tool"""
HAS_TOOL = f"SELECT cluster_id, bool_or(installed AND tool IN ('mysqldump', 'xtrabackup')) AS has_tool FROM ({TOOLING}) GROUP BY cluster_id"
ARTIFACT = "SELECT cluster_id, bool_or(n_files > 0) AS has_artifact FROM {backup_dirs} GROUP BY cluster_id"
SCHEDULE = "SELECT cluster_id, bool_or(line LIKE '%xtrabackup%') AS has_schedule FROM {cron_lines} GROUP BY cluster_id"
LATEST = """SELECT cluster_id, node_ip, path, mtime, bytes FROM (SELECT f.*, row_number() OVER (PARTITION BY f.cluster_id ORDER BY mtime DESC, coalesce(node_order, concat('~|', f.node_ip)), path) AS r
FROM {backup_files} f LEFT JOIN {nodes} n ON n.cluster_id = f.cluster_id AND n.node_ip = f.node_ip) WHERE r = 1"""


def tooling(v):
    return assess.backup_tooling(v["backup_tools"], v["nodes"])


@check("bkp_01_backup_tooling", TOOLING)
def _(v):
    return plain(tooling(v))


@check("bkp_01_has_tool", HAS_TOOL)
def _(v):
    return plain(assess.has_tool(tooling(v)))


@check("bkp_02_latest_backup", LATEST)
def _(v):
    return plain(assess.latest_backup(v["backup_files"], v["nodes"]))


@check("bkp_03_has_artifact", ARTIFACT)
def _(v):
    return plain(assess.has_artifact(v["backup_dirs"]))


@check("bkp_04_has_schedule", SCHEDULE)
def _(v):
    return plain(assess.has_schedule(v["cron_lines"]))


@check("bkp_05_backup_paths", """
SELECT DISTINCT cluster_id, CASE WHEN path LIKE '/opt%' THEN '/opt/db_bak' ELSE path END AS path FROM {backup_dirs}
UNION SELECT cluster_id, regexp_extract(line, '(/var/dump/log[0-9]+)', 1) FROM {cron_lines} WHERE line LIKE '%/var/dump%'
UNION SELECT cluster_id, regexp_extract(line, '(/opt/jobs[0-9]+/xtrabackup_full.sh)', 1) FROM {cron_lines} WHERE line LIKE '%/var/dump%'""")
def _(v):
    return plain(assess.backup_paths(v["backup_dirs"], v["cron_lines"]))


# Days are shifted so that every age band occurs.
SEVERITY = f"""SELECT c.cluster_id, has_tool, has_artifact, has_schedule, DATE '2024-01-31' - mtime AS age_days,
  CASE WHEN NOT has_tool THEN 'P0' WHEN NOT has_artifact AND has_schedule THEN 'P2' WHEN NOT has_artifact THEN 'P1' WHEN NOT has_schedule THEN 'P2'
    WHEN DATE '2024-01-31' - mtime <= 1 THEN 'OK' WHEN DATE '2024-01-31' - mtime <= 7 THEN 'P2' ELSE 'P0' END AS severity
FROM (SELECT DISTINCT cluster_id FROM {{nodes}}) c LEFT JOIN ({HAS_TOOL}) USING (cluster_id) LEFT JOIN ({ARTIFACT}) USING (cluster_id) LEFT JOIN ({SCHEDULE}) USING (cluster_id)
LEFT JOIN (SELECT cluster_id, DATE '2024-01-31' - CAST(cluster_id % 12 AS INT) AS mtime FROM ({LATEST})) USING (cluster_id)"""


def severity(v):
    latest = assess.latest_backup(v["backup_files"], v["nodes"])
    recent = latest.withColumn("mtime", F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("cluster_id") % 12).cast("int")))
    return assess.backup_severity(
        fleet.topology(v["nodes"]), assess.has_tool(tooling(v)), assess.has_artifact(v["backup_dirs"]), assess.has_schedule(v["cron_lines"]), recent
    )


@check("bkp_06_backup_severity", SEVERITY)
def _(v):
    return plain(severity(v), "assessment")


@check("bkp_07_backup_dir_summary", f"""
WITH f AS (SELECT {K}, dir, count(*) AS n, max(mtime) AS latest, CAST(sum(bytes) AS BIGINT) AS total, last(bytes ORDER BY mtime, path) AS newest FROM {{backup_files}} GROUP BY ALL),
d AS (SELECT DISTINCT {K}, dir AS path FROM {{backup_files}} UNION ALL SELECT {K}, '/opt/none' FROM {{nodes}})
SELECT cluster_id, node_ip, path, coalesce(n, 0) AS n_files, latest, total AS total_bytes, CAST(ceil(newest / 209715200.0) AS BIGINT) AS restore_s
FROM d LEFT JOIN f ON d.cluster_id = f.cluster_id AND d.node_ip = f.node_ip AND d.path = f.dir""".replace("SELECT cluster_id, node_ip, path", "SELECT d.cluster_id, d.node_ip, path"))
def _(v):
    keys = ["cluster_id", "snapshot_date", "node_ip"]
    found = v["backup_files"].select(*keys, F.col("dir").alias("path")).distinct().withColumn("exists", F.lit(True))
    none = v["nodes"].select(*keys, F.lit("/opt/none").alias("path"), F.lit(False).alias("exists"))
    dirs = found.unionByName(none).withColumn("total_size", F.lit("-"))
    return plain(assess.backup_dir_summary(dirs, v["backup_files"]), "exists", "total_size")


FACTS = """(SELECT cluster_id, arg_min(coalesce(has_password_policy::VARCHAR, '-'), node_order) AS lead_policy, arg_min(coalesce(have_ssl, '-'), node_order) AS lead_ssl,
  arg_min(k % 4, node_order) AS lead_k, arg_min(coalesce(require_secure, '-'), node_order) AS lead_secure, count(has_password_policy) > 0 AS s1, bool_or(n_root_open > 0) AS root_open,
  count(has_audit) > 0 AS s3, coalesce(bool_or(has_audit), FALSE) AS audit, count(have_ssl) > 0 AS s4, count(has_encryption) > 0 OR count(has_keyring) > 0 AS s6, coalesce(bool_or(has_encryption), FALSE) AS enc,
  count(has_empty_password) > 0 AS s7, coalesce(bool_or(has_empty_password), FALSE) AS ep, count(has_old_auth) > 0 AS s8, coalesce(bool_or(has_old_auth), FALSE) AS oa,
  count(has_login_failures) > 0 AS s9, coalesce(bool_or(has_login_failures), FALSE) AS lf FROM {nodes} GROUP BY cluster_id)"""


def one(check_id: str, saw: str, passed: str, otherwise: str = "FAIL") -> str:
    return f"SELECT cluster_id, '{check_id}' AS check_id, CASE WHEN NOT {saw} THEN 'UNKNOWN' WHEN {passed} THEN 'PASS' ELSE '{otherwise}' END AS status FROM {FACTS}"


CHECKS = "\nUNION ALL ".join([
    one("strong_password_policy", "s1", "lead_policy = 'true'"),
    one("no_wildcard_root", "TRUE", "NOT root_open"),
    one("audit_log", "s3", "audit"),
    one("tls_enabled", "s4", "lead_ssl = 'YES' AND lead_k = 1", "WARN"),
    one("require_secure_transport", "s4", "lead_secure = 'ON'", "WARN"),
    one("innodb_encryption", "s6", "enc", "WARN"),
    one("no_empty_password", "s7", "NOT ep"),
    one("auth_plugin", "s8", "NOT oa", "WARN"),
    one("failed_login_baseline", "s9", "NOT lf", "WARN"),
])


def security_checks(v):
    return assess.security_checks(assess.security_facts(nodes_of(v)))


@check("sec_01_security_checks", CHECKS)
def _(v):
    return plain(security_checks(v))


@check("sec_02_security_level", f"""
WITH c AS (SELECT cluster_id, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail,
  count(*) FILTER (status = 'UNKNOWN') AS unknown, count(*) AS total FROM ({CHECKS}) GROUP BY cluster_id)
SELECT *, CASE WHEN unknown > total * 0.5 THEN 'insufficient' WHEN fail = 0 AND warn <= 1 THEN 'high' WHEN fail <= 0.25 * (total - unknown) THEN 'medium' ELSE 'low' END AS level FROM c""")
def _(v):
    return plain(assess.security_level(security_checks(v)))


def framework(name: str, required: list[str], partial: bool) -> str:
    missing = f"concat_ws(',', {', '.join(f'CASE WHEN NOT {r} THEN {chr(39)}{r}{chr(39)} END' for r in required)})"
    n = " + ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in required)
    return f"SELECT cluster_id, '{name}' AS framework, CASE WHEN {n} = {len(required)} THEN 'met' WHEN {str(partial).upper()} AND {n} > 0 THEN 'partial' ELSE 'not_met' END AS status, {missing} AS missing FROM p"


@check("sec_03_framework_coverage", f"""
WITH p AS (SELECT cluster_id, bool_or(check_id = 'strong_password_policy' AND status = 'PASS') AS strong_password_policy, bool_or(check_id = 'audit_log' AND status = 'PASS') AS audit_log,
  bool_or(check_id = 'innodb_encryption' AND status = 'PASS') AS innodb_encryption, bool_or(check_id = 'tls_enabled' AND status = 'PASS') AS tls_enabled FROM ({CHECKS}) GROUP BY cluster_id)
{framework('MLPS 2.0 level 3', ['strong_password_policy', 'audit_log'], False)} UNION ALL {framework('PCI DSS', ['innodb_encryption', 'tls_enabled', 'audit_log'], True)}
UNION ALL {framework('GDPR', ['audit_log'], True)}""")
def _(v):
    return plain(assess.framework_coverage(security_checks(v)))


@check("sec_04_wildcard_groups", f"""
SELECT {K}, level, reason, count(*) AS n, min(user_name) AS first_user, max(user_name) AS last_user, CASE level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS severity_rank,
  CASE level WHEN 'low' THEN 'may stay' WHEN 'medium' THEN 'narrow the network' ELSE 'restrict now' END AS advice
FROM (SELECT *, {LEVEL_SQL} AS level, {REASON_SQL} AS reason FROM {{cat_users}} WHERE host = '%') GROUP BY {K}, level, reason""")
def _(v):
    return plain(assess.wildcard_groups(v["cat_users"]))


@check("sec_04_wildcard_users", f"SELECT {K}, user_name, {LEVEL_SQL} AS level, {REASON_SQL} AS reason FROM {{cat_users}} WHERE host = '%'")
def _(v):
    return plain(assess.wildcard_users(v["cat_users"]))
