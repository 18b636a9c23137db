"""DRF-*: parameter and schema drift."""

from __future__ import annotations

from checks.catalog_checks import K, plain
from checks.registry import check
from checks.rule_checks import nodes_of
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import drift, fleet


def value(name: str) -> str:
    return "server_version" if name == "server_version" else f"v_{name}"


HAVE = ["server_version", "server_id", "innodb_buffer_pool_size_in_mb", "innodb_log_file_size_in_mb", "max_connections", "binlog_format", "gtid_mode",
        "read_only", "expire_logs_days", "long_query_time", "slow_query_log", "sync_binlog", "innodb_flush_log_at_trx_commit", "transaction_isolation", "wait_timeout"]
PARAMS = "\nUNION ALL ".join(f"SELECT {K}, cluster_id AS c, role, node_order, '{n}' AS name, {value(n)} AS value FROM {{nodes}}" for n in HAVE)
SUMMARY = f"""WITH p AS ({PARAMS}),
s AS (SELECT cluster_id, name, count(*) AS n_nodes, count(DISTINCT value) AS n_unique, min(value) AS first_value, max(value) AS last_value,
  arg_min(TRY_CAST(value AS DOUBLE), node_order) FILTER (role = 'primary') AS pn,
  min(TRY_CAST(value AS DOUBLE)) FILTER (role <> 'primary') AS rmin, max(TRY_CAST(value AS DOUBLE)) FILTER (role <> 'primary') AS rmax,
  count(*) FILTER (TRY_CAST(value AS DOUBLE) = 0) AS zeros, count(*) FILTER (role = 'primary' AND value <> '0') AS pro, count(*) FILTER (role <> 'primary' AND value <> '1') AS rrw
FROM p GROUP BY cluster_id, name HAVING count(*) > 1 AND count(DISTINCT value) > 1)
"""


@check("drf_01_parameter_drift", f"{SUMMARY} SELECT cluster_id, name, n_nodes, n_unique, first_value, last_value FROM s")
def _(v):
    return drift.parameter_drift(nodes_of(v)).select("cluster_id", "name", "n_nodes", "n_unique", "first_value", "last_value")


@check("drf_01_parameter_values", f"WITH p AS ({PARAMS}) SELECT cluster_id, name, value, count(*) AS n_nodes FROM p WHERE value IS NOT NULL GROUP BY ALL")
def _(v):
    return plain(drift.parameter_values(nodes_of(v)))


@check("drf_01_parameter_node_values", f"{SUMMARY} SELECT p.cluster_id, p.node_ip, p.role, p.name, p.value FROM p JOIN s USING (cluster_id, name)")
def _(v):
    nodes = nodes_of(v)
    return plain(drift.parameter_node_values(nodes, drift.parameter_drift(nodes)))


@check("drf_02_judge_parameter", f"""{SUMMARY}
SELECT cluster_id, name, CASE name WHEN 'server_id' THEN TRUE WHEN 'read_only' THEN pro = 0 AND rrw = 0
  WHEN 'expire_logs_days' THEN zeros = 0 AND coalesce(rmin >= pn AND rmax - pn <= 30, FALSE) ELSE FALSE END AS ok,
  CASE name WHEN 'server_id' THEN 'must be unique per node'
    WHEN 'read_only' THEN CASE WHEN pro = 0 AND rrw = 0 THEN 'primary writes, replicas read' ELSE concat(pro, ' read-only primaries, ', rrw, ' writable replicas') END
    WHEN 'expire_logs_days' THEN CASE WHEN zeros > 0 THEN 'some nodes never expire binlogs' WHEN coalesce(rmin >= pn AND rmax - pn <= 30, FALSE) THEN 'replicas keep binlogs at least as long as the primary' ELSE 'binlog retention differs' END
    WHEN 'long_query_time' THEN 'slow-log thresholds differ' WHEN 'slow_query_log' THEN 'the slow log is off on some nodes'
    WHEN 'innodb_buffer_pool_size_in_mb' THEN 'core parameters differ' WHEN 'max_connections' THEN 'core parameters differ' WHEN 'innodb_log_file_size_in_mb' THEN 'core parameters differ'
    WHEN 'binlog_format' THEN 'replication peers need one binlog format' ELSE 'should agree' END AS reason FROM s""")
def _(v):
    return drift.parameter_drift(nodes_of(v)).select("cluster_id", "name", "ok", "reason")


DIFF = """WITH f AS (SELECT cluster_id, arg_min(node_ip, node_order) AS first_ip FROM {nodes} GROUP BY cluster_id),
ref AS (SELECT d.cluster_id, d.name FROM {databases} d JOIN f ON d.cluster_id = f.cluster_id AND d.node_ip = f.first_ip),
others AS (SELECT n.cluster_id, n.node_ip FROM {nodes} n JOIN f USING (cluster_id) WHERE n.node_ip <> f.first_ip)
SELECT o.cluster_id, o.node_ip, d.name, 'extra' AS difference FROM others o JOIN {databases} d USING (cluster_id, node_ip)
WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.cluster_id = o.cluster_id AND r.name = d.name)
UNION ALL SELECT o.cluster_id, o.node_ip, r.name, 'missing' FROM others o JOIN ref r USING (cluster_id)
WHERE NOT EXISTS (SELECT 1 FROM {databases} d WHERE d.cluster_id = o.cluster_id AND d.node_ip = o.node_ip AND d.name = r.name)"""


@check("drf_03_schema_diff", DIFF)
def _(v):
    return plain(drift.schema_diff(v["databases"], fleet.with_node_order(v["nodes"])))


def matrix(names: list[str], have: list[str], advice: dict[str, str] | None) -> str:
    parts = []
    for n in names:
        cell = f"coalesce({value(n)}, '-')" if n in have else "'-'"
        extra = f", '{advice[n]}' AS advice" if advice else ""
        parts.append(f"SELECT {K}, role, '{n}' AS name, {cell} AS value{extra} FROM {{nodes}}")
    return "\nUNION ALL ".join(parts)


KNOWN = [*HAVE, "innodb_flush_method", "enforce_gtid_consistency", "log_bin", "slave_parallel_workers", "slave_net_timeout"]


@check("drf_04_parameter_matrix", matrix([n for n, _ in fv.MATRIX_PARAMETERS], KNOWN, dict(fv.MATRIX_PARAMETERS)))
def _(v):
    return plain(drift.parameter_matrix(nodes_of(v)))


@check("drf_04_replication_matrix", matrix(fv.REPLICATION_PARAMETERS, KNOWN, None))
def _(v):
    return plain(drift.replication_matrix(nodes_of(v)))
