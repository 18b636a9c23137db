"""FLT-*: roles, order, topology and disk attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog_checks import K, plain
from checks.registry import check
from fleetvitals.operators import fleet

SELF = f"""SELECT *, is_replica AND (master_host = node_ip OR lower(master_host) = hostname) AS residue FROM {{nodes}}"""


def resolved(v):
    return fleet.resolve_roles(fleet.self_ref_replica(fleet.conform(v.node_facts().drop("role"))))


@check("flt_01_self_ref_replica", f"SELECT {K}, is_replica AND NOT residue AS is_replica, residue AS is_residue FROM ({SELF})")
def _(v):
    return fleet.self_ref_replica(v.node_facts()).select("cluster_id", "node_ip", "is_replica", "is_residue")


EVIDENCE = "(coalesce(connected_replicas > 0, FALSE) OR has_dump_session)"


@check("flt_02_primary_evidence", f"SELECT {K}, {EVIDENCE} AS has_evidence FROM {{nodes}}")
def _(v):
    return fleet.primary_evidence(fleet.conform(v.node_facts())).select("cluster_id", "node_ip", "has_evidence")


@check("flt_02_session_evidence", f"SELECT {K}, coalesce(bool_or(user_name = 'repl' AND command = 'Binlog Dump'), FALSE) AS has_dump_session FROM {{sessions}} GROUP BY {K}")
def _(v):
    return fleet.session_facts(v["sessions"]).select("cluster_id", "node_ip", "has_dump_session")


ALONE = """CASE WHEN is_replica THEN NULL WHEN v_read_only = '0' THEN 'standalone_rw' WHEN v_read_only = '1' AND v_log_bin <> 'OFF' THEN 'standalone_readonly' END"""


@check("flt_03_standalone_primary", f"""
SELECT {K}, CASE WHEN src IS NULL THEN NULL ELSE 'primary' END AS standalone_role, src AS standalone_source, coalesce(src = 'standalone_readonly', FALSE) AS standalone_confirm
FROM (SELECT *, {ALONE} AS src FROM {{nodes}})""")
def _(v):
    df = fleet.standalone_primary(fleet.conform(v.node_facts()))
    return df.select("cluster_id", "node_ip", "standalone_role", "standalone_source", "standalone_confirm")


ROLES = f"""
WITH s AS ({SELF}), f AS (SELECT *, is_replica AND NOT residue AS rep, {EVIDENCE} AS ev,
  CASE WHEN is_replica AND NOT residue THEN NULL WHEN v_read_only = '0' THEN 'standalone_rw' WHEN v_read_only = '1' AND v_log_bin <> 'OFF' THEN 'standalone_readonly' END AS alone FROM s),
g AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'dr' WHEN ev THEN 'primary' WHEN k % 11 = 1 THEN 'slave' WHEN rep THEN 'slave' WHEN alone IS NOT NULL THEN 'primary' ELSE 'unknown' END AS r1,
  CASE WHEN k % 7 = 0 THEN 'dr' WHEN ev THEN 'evidence' WHEN k % 11 = 1 THEN 'declared' WHEN rep THEN 'replica' WHEN alone IS NOT NULL THEN alone ELSE 'unknown' END AS s1 FROM f),
h AS (SELECT *, count(*) OVER c AS n, min(CASE WHEN r1 = 'primary' THEN node_ip END) OVER c AS found, min(CASE WHEN ev AND NOT rep THEN node_ip END) OVER c AS fallback
  FROM g WINDOW c AS (PARTITION BY cluster_id)),
roles AS (SELECT cluster_id, node_ip, k,
  CASE WHEN found IS NULL AND node_ip = fallback THEN 'primary' WHEN n = 1 AND r1 = 'unknown' THEN 'primary'
    WHEN node_ip <> coalesce(found, fallback) AND rep AND r1 <> 'dr' THEN 'slave' ELSE r1 END AS role,
  CASE WHEN found IS NULL AND node_ip = fallback THEN 'evidence' WHEN n = 1 AND r1 = 'unknown' THEN 'single_node_fallback' ELSE s1 END AS role_source FROM h)
"""


@check("flt_04_resolve_roles", f"{ROLES} SELECT {K}, role, role_source, role_source IN ('standalone_readonly', 'single_node_fallback') AS needs_confirmation FROM roles")
def _(v):
    return resolved(v).select("cluster_id", "node_ip", "role", "role_source", "needs_confirmation")


@check("flt_05_rank_nodes", f"SELECT {K}, row_number() OVER (PARTITION BY cluster_id ORDER BY node_order) AS node_rank FROM {{nodes}}")
def _(v):
    return fleet.rank_nodes(fleet.with_node_order(v["nodes"])).select("cluster_id", "node_ip", "node_rank")


TOPOLOGY = """SELECT cluster_id, count(*) AS n_nodes, count(*) FILTER (role <> 'primary') AS n_replicas, TRUE AS has_primary,
  CASE WHEN count(*) FILTER (role <> 'primary') > 0 THEN concat('primary + ', count(*) FILTER (role <> 'primary'), ' replicas (async)') ELSE 'single node' END AS label
FROM {nodes} GROUP BY cluster_id"""


@check("flt_06_topology", TOPOLOGY)
def _(v):
    return plain(fleet.topology(v["nodes"]))


KINDS = ["binlog", "slowLog", "errorLog", "relayLog", "ibtmp1", "datadir"]
PARTS = " UNION ALL ".join(
    f"SELECT {K}, cluster_id AS c, '{kind}' AS kind, {i} AS pos, {column} AS bytes, k, v_expire_logs_days FROM {{nodes}} WHERE {column} > 0"
    for i, (kind, column) in enumerate(fleet.DISK_KINDS.items())
)


@check("flt_07_disk_attribution", f"""
SELECT {K}, kind, bytes, CAST(bytes AS DOUBLE) / CAST(sum(bytes) OVER (PARTITION BY {K}) AS DOUBLE) AS pct,
  row_number() OVER (PARTITION BY {K} ORDER BY bytes DESC, pos) AS rnk FROM ({PARTS})""")
def _(v):
    return plain(fleet.disk_attribution(fleet.conform(v.node_facts())))


@check("flt_08_node_facts", f"""SELECT {K}, hostname, role, mem_pct, qps, v_read_only AS read_only, root_pct, v_slave_skip_errors AS skip_errors FROM {{nodes}}""")
def _(v):
    nodes = fleet.conform(v.node_facts())
    return nodes.select(
        "cluster_id", "node_ip", "hostname", "role", "mem_pct", "qps", fleet.variable("read_only").alias("read_only"),
        F.col("disks")[0]["use_pct"].alias("root_pct"), fleet.variable("slave_skip_errors").alias("skip_errors"),
    )
