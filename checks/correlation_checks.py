"""COR-*: root-cause correlations, one query each and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fleet_checks import PARTS
from checks.registry import check
from checks.rule_checks import SHARE, nodes_of, num
from fleetvitals.operators import correlate

NOBODY = "CAST(NULL AS VARCHAR)"
GIB = 1073741824
ONE = "confirmed: "

P = "{nodes} WHERE role = 'primary'"
N = "(SELECT cluster_id, count(*) AS n, bool_and(v_innodb_flush_log_at_trx_commit = '0') AND bool_and(v_sync_binlog = '0') AS weak, bool_and(n_root_open > 0) AS root_open FROM {nodes} GROUP BY cluster_id)"
LAG = "(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY lag_seconds DESC, node_order) AS r FROM {nodes} WHERE is_replica AND lag_seconds > 60)"


def join(*cases: tuple[str, str]) -> str:
    """Verdict texts of the conditions that hold, in order."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in cases) + ")"


def finding(code: str, subject: str, verdicts: str, source: str, where: str = "TRUE") -> str:
    return f"SELECT cluster_id, '{code}' AS code, {subject} AS subject_node, {verdicts} AS verdicts FROM {source} WHERE {where}"


def first(condition: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY node_order) AS r FROM {{nodes}} WHERE {condition}) WHERE r = 1)"


SWAP = [(f"{SHARE} > 0.7", ONE + "buffer pool competes for memory"), ("qps > 500", ONE + "busy workload keeps swap in use"),
        (f"{num('max_connections')} > 1000", ONE + "many connection buffers")]
SLOW = [("v_log_queries_not_using_indexes = 'ON'", ONE + "statements without index are logged"), (f"{num('long_query_time')} > 0 AND {num('long_query_time')} < 1", ONE + "long_query_time is too low"),
        ("slow_queries > 1000000", ONE + "many truly slow statements")]
TEMP = f"""(SELECT *, (umax - umin) / 86400.0 AS days FROM (SELECT cluster_id, count(*) AS n, min(temp_bytes) AS tmin, max(temp_bytes) AS tmax, arg_min(node_ip, node_order) FILTER (temp_bytes = top) AS ip,
  bool_and(uptime_sec IS NOT NULL) AS ups, min(uptime_sec) AS umin, max(uptime_sec) AS umax, count(*) FILTER (qps > 0) AS nb, min(qps) FILTER (qps > 0) AS qmin, max(qps) FILTER (qps > 0) AS qmax
  FROM (SELECT *, max(temp_bytes) OVER (PARTITION BY cluster_id) AS top FROM {{nodes}} WHERE role <> 'primary' AND temp_bytes IS NOT NULL) GROUP BY cluster_id))"""
RATES = """(SELECT cluster_id, count(*) AS n, min(rate) AS rmin, max(rate) AS rmax, arg_min(node_ip, node_order) FILTER (rate = top) AS ip
FROM (SELECT *, max(rate) OVER (PARTITION BY cluster_id) AS top FROM (SELECT *, binlog_bytes / (uptime_sec / 86400.0::DOUBLE) AS rate FROM {nodes} WHERE binlog_bytes > 0 AND uptime_sec > 0)) GROUP BY cluster_id)"""
TOP_PART = f"(SELECT {'cluster_id, node_ip, kind'} FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, node_ip ORDER BY bytes DESC, pos) AS r FROM ({PARTS})) WHERE r = 1)"

FINDINGS: dict[str, str] = {
    "COR-01": finding("COR-01", "node_ip", "CASE WHEN kind IS NULL THEN 'needs-investigation: binlog retention' ELSE concat('confirmed: ', kind) END",
                      f"(SELECT n.*, t.kind FROM {{nodes}} n LEFT JOIN {TOP_PART} t USING (cluster_id, node_ip))",
                      f"(root_pct >= 80 OR data_pct >= 80) AND (kind IS NOT NULL OR v_expire_logs_days = '0' OR {num('expire_logs_days')} > 30)"),
    "COR-02": finding("COR-02", NOBODY, f"'{ONE}no node is durable'", N, "weak AND n > 1"),
    "COR-03": finding("COR-03", "node_ip", f"'{ONE}slow statements spill to temporary tables'", "{nodes}", f"role = 'primary' AND slow_queries > 1000000 AND temp_bytes > 5368709120"),
    "COR-04": finding("COR-04", "ip", "CASE WHEN v = '' THEN 'needs-investigation: no uptime or load data' ELSE v END",
                      "(SELECT *, " + join(("ups AND days > 7", ONE + "restart times differ"), ("ups AND days <= 7", "excluded: restart times are close"),
                                           ("nb >= 2 AND qmax > qmin * 2", ONE + "read load differs"), ("nb >= 2 AND qmax <= qmin * 2", "excluded: read load is even")) + f" AS v FROM {TEMP})",
                      f"n >= 2 AND tmax > tmin * 4 AND tmax > {GIB}"),
    "COR-05": finding("COR-05", NOBODY, f"'{ONE}root is open on every node'", N, "root_open AND n > 1"),
    "COR-06": finding("COR-06", "node_ip", "CASE WHEN uptime_sec IS NULL THEN 'needs-investigation: uptime is unknown' WHEN uptime_sec < 604800 THEN 'confirmed: restarted within 7 days' "
                      "WHEN uptime_sec < 2592000 THEN 'confirmed: still warming up' ELSE 'excluded: cold start; load is light' END",
                      f"(SELECT n.*, p.mem_pct AS pm FROM {{nodes}} n JOIN (SELECT cluster_id, mem_pct FROM {P}) p USING (cluster_id))", "role <> 'primary' AND mem_pct < pm - 30"),
    "COR-07": finding("COR-07", "node_ip", "v", "(SELECT w.cluster_id, w.node_ip, " + join(
        ("w.v_slave_parallel_workers = '0'", ONE + "single-threaded replication"), ("p.qps > 1000 AND w.v_slave_parallel_workers = '0'", ONE + "primary is busy"),
        ("w.qps > p.qps", ONE + "replica is busier with reads than the primary"), ("w.v_binlog_format <> 'ROW'", ONE + "binlog format is not ROW"))
        + f" AS v FROM {LAG} w JOIN (SELECT * FROM {P}) p USING (cluster_id) WHERE w.r = 1)", "v <> ''"),
    "COR-08": finding("COR-08", "node_ip", join(*SWAP), first("swap_pct > 0 AND (" + " OR ".join(c for c, _ in SWAP) + ")")),
    "COR-09": finding("COR-09", "ip", f"'{ONE}system and server are both out of support'",
                      f"(SELECT o.cluster_id, o.ip, p.k FROM (SELECT cluster_id, arg_min(node_ip, node_order) AS ip FROM {{nodes}} WHERE k % 6 IN (0, 1, 2) GROUP BY cluster_id) o JOIN (SELECT * FROM {P}) p USING (cluster_id))",
                      "k % 9 IN (0, 1, 2)"),
    "COR-10": finding("COR-10", "node_ip", join(*SLOW), first(f"slow_log_bytes >= {GIB} AND (" + " OR ".join(c for c, _ in SLOW) + ")")),
    "COR-11": finding("COR-11", "node_ip", f"'{ONE}errors and warnings are frequent'", first("error_log_bytes >= 104857600 AND error_count + warning_count > 100")),
    "COR-12": finding("COR-12", NOBODY, f"'{ONE}weak durability and delay add up'", f"(SELECT n.* FROM {N} n WHERE EXISTS (SELECT 1 FROM {LAG} l WHERE l.cluster_id = n.cluster_id))", "weak"),
    "COR-13": finding("COR-13", "node_ip", f"'{ONE}replica accepts writes while late'", "{nodes}", "is_replica AND lag_seconds > 60 AND v_read_only = '0'"),
    "COR-14": finding("COR-14", "node_ip", f"'{ONE}key range and statement speed degrade together'", "{nodes}", "role = 'primary' AND max_auto_rate >= 0.7 AND slow_queries > 100000"),
    "COR-15": finding("COR-15", "ip", "'needs-investigation: binlog growth differs between nodes'", RATES, f"n >= 2 AND rmax > rmin * 5 AND rmax > {GIB}"),
}


def flat(df):
    text = F.array_join(F.transform("verdicts", lambda x: F.concat_ws(": ", x["state"], x["cause"])), "; ")
    return df.select("cluster_id", "code", "subject_node", text.alias("verdicts"))


def register(code: str, sql: str) -> None:
    @check(f"{code.lower().replace('-', '_')}_correlation", sql)
    def _(v):
        return flat(correlate.correlations(nodes_of(v)).filter(F.col("code") == code))


for code, sql in FINDINGS.items():
    register(code, sql)


@check("cor_00_all_correlations", "\nUNION ALL ".join(FINDINGS.values()))
def _(v):
    return flat(correlate.correlations(nodes_of(v)))


@check("cor_00_metrics", f"""
SELECT cluster_id, 'COR-13' AS code, node_ip AS subject_node, 'lag' AS metric, CAST(lag_seconds AS DOUBLE) AS value FROM {{nodes}} WHERE is_replica AND lag_seconds > 60 AND v_read_only = '0'
UNION ALL SELECT cluster_id, 'COR-12', NULL, 'worst_lag', CAST(lag AS DOUBLE) FROM (SELECT n.cluster_id, max(lag_seconds) AS lag FROM {N} n JOIN {LAG} l USING (cluster_id) WHERE weak GROUP BY 1)
UNION ALL SELECT cluster_id, 'COR-12', NULL, 'rpo_seconds', CAST(lag + 1 AS DOUBLE) FROM (SELECT n.cluster_id, max(lag_seconds) AS lag FROM {N} n JOIN {LAG} l USING (cluster_id) WHERE weak GROUP BY 1)""")
def _(v):
    found = correlate.correlations(nodes_of(v)).filter(F.col("code").isin("COR-12", "COR-13"))
    return found.select("cluster_id", "code", "subject_node", F.explode("metrics").alias("metric", "value"))
