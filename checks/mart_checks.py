"""MRT-*, SNK-*, DQ-*: report tables, documents and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import issue_checks as I
from checks.catalog_checks import AUTO_ALL, K, NO_PK, OBJECTS, RATE, REDUNDANT, UNUSED, USER, auto_increment, no_pk, object_counts, plain, topk
from checks.drift_checks import SUMMARY
from checks.registry import check
from checks.rule_checks import HIT, nodes_of
from checks.workload_checks import LONG, SESSION
from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import catalog, documents, drift, fleet, issues, marts, rules
from fleetvitals.plans.lineage import shared_folder
from fleetvitals.sources import tables

GIB = 1073741824


def uptime(column: str) -> str:
    return f"CASE WHEN {column} IS NULL OR {column} <= 0 THEN '-' ELSE concat({column} // 86400, ' 天') END"


def outcome(v):
    """Issues, totals and labels of every cluster."""
    found = I.merged(v)
    backup, security = I.evidence(v)
    clusters = fleet.topology(v["nodes"])
    totals = issues.total_score(issues.dimension_scores(found, clusters, backup, security))
    return found, totals, issues.overall_label(clusters, found, totals)


@check("mrt_01_key_facts", f"""{I.SCORES}, {I.TOTALS}, pr AS (SELECT cluster_id, {I.COUNTS}, min(priority) AS worst FROM merged GROUP BY cluster_id)
SELECT t.cluster_id, t.label AS topology, t.n_nodes, total, CASE worst WHEN 'P0' THEN 'urgent risks, act now' WHEN 'P1' THEN 'stable, with important problems to solve soon' ELSE 'stable, with suggestions' END AS assessment,
  p0, p1, p2, p3, severity AS backup_severity FROM (SELECT cluster_id, count(*) AS n_nodes,
    CASE WHEN count(*) > 1 THEN concat('primary + ', count(*) - 1, ' replicas (async)') ELSE 'single node' END AS label FROM {{nodes}} GROUP BY cluster_id) t
JOIN totals2 USING (cluster_id) JOIN pr USING (cluster_id) JOIN ({I.SEVERITY}) USING (cluster_id)""")
def _(v):
    found, totals, labels = outcome(v)
    return plain(marts.key_facts(fleet.topology(v["nodes"]), totals, labels, issues.priority_distribution(found), I.severity(v)))


@check("mrt_02_node_inventory", f"""
SELECT {K}, hostname, role, server_version, CAST(k AS VARCHAR) AS server_id, {uptime('uptime_sec')} AS uptime, CASE WHEN k % 6 IN (0, 1, 2) THEN 'eol' WHEN k % 6 = 4 THEN 'unrecognised' ELSE 'unknown' END AS os_status,
  cpu_cores, mem_total_kb, mem_pct, swap_used_kb, swap_pct FROM {{nodes}}""")
def _(v):
    return marts.node_inventory(nodes_of(v)).select(
        "cluster_id", "node_ip", "hostname", "role", "server_version", "server_id", "uptime", "os_status", "cpu_cores", "mem_total_kb", "mem_pct", "swap_used_kb", "swap_pct")


BAND = "CASE WHEN use_pct >= 90 THEN 'urgent' WHEN use_pct >= 80 THEN 'attention' WHEN use_pct >= 70 THEN 'normal' ELSE 'ample' END"


@check("mrt_03_disk_usage", f"SELECT {K}, mount, use_pct, {BAND} AS band, mount = '/data' AS is_key FROM {{disks}}")
def _(v):
    return plain(marts.disk_usage(nodes_of(v)))


@check("mrt_04_connection_usage", f"""
SELECT {K}, role, threads_connected AS used, CAST(v_max_connections AS BIGINT) AS max_connections, round(threads_connected * 100.0::DOUBLE / CAST(v_max_connections AS BIGINT), 1) AS pct,
  CASE WHEN threads_connected * 100 >= 80 * CAST(v_max_connections AS BIGINT) THEN 'high' WHEN threads_connected * 100 >= 60 * CAST(v_max_connections AS BIGINT) THEN 'middle' ELSE 'low' END AS band FROM {{nodes}}""")
def _(v):
    return plain(marts.connection_usage(nodes_of(v)))


def mix(group: str) -> str:
    return f"""SELECT {group}, count(*) AS total, count(*) FILTER (command = 'Sleep') AS sleep, count(*) FILTER (command = 'Query') AS query, count(*) FILTER (command = 'Connect') AS connect,
  count(*) FILTER (command = 'Binlog Dump') AS binlog_dump, count(*) FILTER (command = 'Execute') AS other FROM {{sessions}} GROUP BY {group}"""


@check("mrt_05_session_mix", mix(K))
def _(v):
    return plain(marts.session_mix(v["sessions"]))


@check("mrt_05_cluster_session_mix", mix("cluster_id"))
def _(v):
    return plain(marts.session_mix(v["sessions"], CLUSTER_KEYS))


@check("mrt_06_long_session_detail", topk(SESSION, "{sessions}", LONG, "time_s DESC, session_id", 30))
def _(v):
    return plain(marts.long_session_detail(v["sessions"]))


@check("mrt_07_performance_kpis", f"""SELECT {K}, role, {uptime('uptime_sec')} AS uptime, questions, qps, slow_queries,
  CASE WHEN slow_queries > 0 THEN round(slow_queries * 100.0::DOUBLE / questions, 4) END AS slow_pct FROM {{nodes}}""")
def _(v):
    return plain(marts.performance_kpis(nodes_of(v)))


@check("mrt_08_buffer_pool", f"SELECT {K}, v_innodb_buffer_pool_size_in_mb AS pool_mb, round({HIT}, 1) AS hit_pct, CASE WHEN bp_hits >= 990 THEN 'good' WHEN bp_hits >= 950 THEN 'warn' ELSE 'bad' END AS band FROM {{nodes}}")
def _(v):
    return plain(marts.buffer_pool(nodes_of(v)))


@check("mrt_09_slow_log_config", f"SELECT {K}, v_slow_query_log AS slow_query_log, v_long_query_time AS long_query_time, '-' AS slow_query_log_file, slow_queries FROM {{nodes}}")
def _(v):
    return plain(marts.slow_log_config(nodes_of(v)))


SIZE = "round(CAST(sum(data_length + index_length) AS DOUBLE) / 1073741824, 3)"


@check("mrt_10_capacity", f"SELECT {K}, table_schema AS name, {SIZE} AS size_gb, FALSE AS is_total FROM {{cat_tables}} WHERE {USER} GROUP BY {K}, table_schema UNION ALL SELECT {K}, 'total', {SIZE}, TRUE FROM {{cat_tables}} WHERE {USER} GROUP BY {K}")
def _(v):
    return plain(marts.capacity(catalog.schema_sizes(v["cat_tables"])))


TOP = topk(f"{K}, table_schema, table_name, data_length + index_length AS bytes, k", "{cat_tables}", USER, "data_length + index_length DESC, table_schema, table_name", 10)


@check("mrt_10_tagged_top_tables", f"SELECT {K}, table_schema, table_name, bytes, CASE WHEN k % 11 = 0 THEN 'archive' ELSE 'business' END AS table_kind FROM ({TOP})")
def _(v):
    return marts.tagged_top_tables(catalog.top_tables(v["cat_tables"])).select("cluster_id", "node_ip", "table_schema", "table_name", "bytes", "table_kind")


FRAGMENTS = f"""SELECT {K}, table_schema, table_name, table_rows, data_length, data_free, {RATE} AS frag_rate, CASE WHEN data_free >= 10737418240 THEN 'rebuild_first' ELSE 'rebuild' END AS rebuild_class
FROM {{cat_tables}} WHERE {USER} AND data_length + index_length > 4194304 AND {RATE} >= 0.7 AND data_free >= 104857600"""


def fragments(v):
    return marts.significant_fragments(catalog.fragmented_tables(v["cat_tables"]))


@check("mrt_11_significant_fragments", FRAGMENTS)
def _(v):
    return plain(fragments(v))


RECLAIM = f"""SELECT coalesce(f.cluster_id, a.cluster_id) AS cluster_id, coalesce(f.node_ip, a.node_ip) AS node_ip, coalesce(nf, 0) AS n_fragmented, CAST(coalesce(fb, 0) AS BIGINT) AS frag_bytes, coalesce(na, 0) AS n_archives, CAST(coalesce(ab, 0) AS BIGINT) AS archive_bytes
FROM (SELECT {K}, count(*) AS nf, sum(data_free) AS fb FROM ({FRAGMENTS}) GROUP BY {K}) f
FULL JOIN (SELECT {K}, count(*) AS na, sum(bytes) AS ab FROM ({TOP}) WHERE k % 11 = 0 GROUP BY {K}) a ON f.cluster_id = a.cluster_id AND f.node_ip = a.node_ip"""


def reclaimable(v):
    return marts.reclaimable(fragments(v), catalog.top_tables(v["cat_tables"]))


@check("mrt_11_reclaimable", RECLAIM)
def _(v):
    return plain(reclaimable(v))


@check("mrt_12_releasable_space", f"""
SELECT r.cluster_id, r.node_ip, frag_bytes + archive_bytes AS bytes, frag_bytes, archive_bytes, CAST(floor((frag_bytes + archive_bytes) * 100.0 / total + 0.5) AS BIGINT) AS pct_of_data
FROM ({RECLAIM}) r JOIN (SELECT {K}, sum(data_length + index_length) AS total FROM {{cat_tables}} WHERE {USER} GROUP BY {K}) t USING (cluster_id, node_ip) WHERE frag_bytes + archive_bytes >= {GIB}""")
def _(v):
    totals = catalog.schema_sizes(v["cat_tables"]).filter("is_total")
    return plain(marts.releasable_space(reclaimable(v), totals))


CATEGORY = f"CASE WHEN regexp_matches(table_name, '{fv.CATEGORY_TEMP}') THEN 'temp' WHEN regexp_matches(table_name, '{fv.CATEGORY_HISTORY}') THEN 'history' WHEN starts_with(table_name, '_') THEN 'temp' ELSE 'business' END"


def categories(source: str) -> str:
    return f"SELECT {K}, " + ", ".join(f"count(*) FILTER ({CATEGORY} = '{c}') AS {c}" for c in ("business", "history", "temp")) + f" FROM ({source}) GROUP BY {K}"


@check("mrt_13_no_pk_summary", categories(NO_PK))
def _(v):
    return plain(marts.category_counts(no_pk(v)))


@check("mrt_13_no_pk_top", f"""SELECT * FROM ({topk(f"{K}, table_schema, table_name, table_rows, category", f"(SELECT *, {CATEGORY} AS category FROM ({NO_PK}))", "TRUE",
    "table_rows DESC, table_name, table_schema", 10, f"{K}, category")}) WHERE category = 'business' OR rnk <= 5""")
def _(v):
    return plain(marts.no_pk_top(no_pk(v)))


@check("mrt_14_temp_tablespace_status", f"""SELECT {K}, role, temp_bytes, v_innodb_temp_data_file_path AS config,
  CASE WHEN temp_bytes IS NOT NULL THEN 'collected' WHEN temp_collected THEN 'collected_no_row' ELSE 'not_collected' END AS status FROM {{nodes}}""")
def _(v):
    return plain(marts.temp_tablespace_status(nodes_of(v)))


@check("mrt_15_engine_overview", f"SELECT {K}, history_list, bp_hits, bp_lookups FROM {{nodes}}")
def _(v):
    return plain(marts.engine_overview(nodes_of(v)))


@check("mrt_15_active_transactions", f"SELECT {K}, trx_id, 'ACTIVE' AS state, CASE WHEN length(query) > 80 THEN concat(substr(query, 1, 80), '…') ELSE query END AS detail FROM {{trx}}")
def _(v):
    return plain(marts.active_transaction_list(v["trx"].withColumns({"state": F.lit("ACTIVE"), "detail": F.col("query")})))


def counter(name: str) -> str:
    return f"CAST(max(CASE WHEN name = '{name}' THEN CAST(value AS BIGINT) END) AS BIGINT) AS {name.lower()}"


@check("mrt_16_lock_summary", f"""
WITH w AS (SELECT {K}, count(*) AS n FROM {{lock_wait_rows}} GROUP BY {K}), m AS (SELECT {K}, count(*) AS n FROM {{open_tables}} GROUP BY {K}),
c AS (SELECT {K}, {', '.join(counter(n) for n in marts.LOCK_COUNTERS)} FROM {{status}} GROUP BY {K}),
u AS (SELECT {K} FROM w UNION SELECT {K} FROM m UNION SELECT {K} FROM c)
SELECT u.cluster_id, u.node_ip, coalesce(w.n, 0) AS n_waits, coalesce(m.n, 0) AS n_metadata_locks, {', '.join(n.lower() for n in marts.LOCK_COUNTERS)}
FROM u LEFT JOIN w USING (cluster_id, node_ip) LEFT JOIN m USING (cluster_id, node_ip) LEFT JOIN c USING (cluster_id, node_ip)""")
def _(v):
    return plain(marts.lock_summary(v["lock_wait_rows"], v["open_tables"], v["status"]))


@check("mrt_17_replication_status", f"SELECT {K}, role, master_host, io_running, sql_running, lag_seconds FROM {{nodes}} WHERE is_replica")
def _(v):
    return plain(marts.replication_status(nodes_of(v)))


@check("mrt_17_replication_health", "SELECT cluster_id, count(*) FILTER (io_running = 'Yes' AND sql_running = 'Yes') AS n_healthy, count(*) AS n_replicas, max(lag_seconds) AS max_lag FROM {nodes} WHERE is_replica GROUP BY cluster_id")
def _(v):
    return plain(marts.replication_health(nodes_of(v)))


@check("mrt_17_replication_issues", f"{I.MERGED} SELECT cluster_id, type, subject, priority FROM merged WHERE type IN ({', '.join(repr(t) for t in fv.REPLICATION_ISSUES)})")
def _(v):
    return marts.replication_issues(I.merged(v)).select("cluster_id", "type", "subject", "priority")


@check("mrt_18_object_matrix", f"SELECT {K}, db, " + ", ".join(f"count(*) FILTER (object_type = '{t}') AS n_{t.lower()}" for t in marts.OBJECT_TYPES) + f" FROM ({OBJECTS}) GROUP BY {K}, db")
def _(v):
    return plain(marts.object_matrix(object_counts(v)))


def unused(v):
    return catalog.unused_indexes(v["index_usage"])


@check("mrt_19_unused_index_summary", categories(UNUSED))
def _(v):
    return plain(marts.category_counts(unused(v)))


@check("mrt_19_unused_index_top", topk(f"{K}, table_schema, table_name, index_name, {CATEGORY} AS category", f"({UNUSED})", "TRUE", "table_schema, table_name, index_name", 30))
def _(v):
    return plain(marts.index_top(unused(v), ["table_schema", "table_name", "index_name"]))


@check("mrt_19_redundant_index_top", topk(f"{K}, table_schema, table_name, redundant_index, dominant_index, {CATEGORY} AS category", f"({REDUNDANT})", "TRUE", "table_schema, table_name, redundant_index, dominant_index", 15))
def _(v):
    found = catalog.redundant_indexes(v["cat_index_columns"]).drop("redundant_columns", "dominant_columns")
    return plain(marts.index_top(found, ["table_schema", "table_name", "redundant_index", "dominant_index"], k=15))


@check("mrt_20_large_column_tables", f"""SELECT {K}, table_schema, table_name, count(*) AS n, string_agg(column_name, ', ' ORDER BY column_name) AS names, string_agg(DISTINCT data_type, '/' ORDER BY data_type) AS types
FROM {{cat_columns}} WHERE {USER} AND (data_type LIKE '%text' OR data_type LIKE '%blob') GROUP BY {K}, table_schema, table_name""")
def _(v):
    return plain(marts.large_column_tables(catalog.large_columns(v["cat_columns"])))


@check("mrt_21_auto_increment_bands", f"SELECT {K}, table_schema, table_name, rate, CASE WHEN rate >= 0.8 THEN 'urgent' WHEN rate >= 0.5 THEN 'attention' ELSE 'normal' END AS band FROM ({AUTO_ALL})")
def _(v):
    return marts.auto_increment_bands(auto_increment(v)).select("cluster_id", "node_ip", "table_schema", "table_name", "rate", "band")


@check("mrt_22_action_plan", f"""{I.MERGED}, s AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY priority, type, first_order NULLS FIRST, subject) AS seq FROM merged)
SELECT cluster_id, priority, seq, type, node FROM s WHERE priority <> 'P3'""")
def _(v):
    plan = marts.action_plan(rules.with_advice(issues.number_issues(I.merged(v))))
    return plan.select("cluster_id", "priority", "seq", "type", "node")


@check("mrt_23_lineage", f"SELECT {K}, file_name FROM {{nodes}}")
def _(v):
    return plain(marts.lineage(v["nodes"]))


def parts(v):
    """Parts of every cluster's document; the members that have no oracle of their own stay small."""
    nodes = nodes_of(v)
    topology = fleet.topology(nodes)
    return documents.document_parts({
        "schemaVersion": topology.select(*CLUSTER_KEYS, F.lit(documents.SCHEMA_VERSION).alias("value")),
        "cluster": topology.select(*CLUSTER_KEYS, "label", "n_nodes"),
        "paramJudgments": drift.parameter_drift(nodes).select(*CLUSTER_KEYS, "name", "ok"),
        "nodes": nodes.select(*KEYS, "role"),
    })


DRIFTS = f"SELECT cluster_id, count(*) AS n FROM ({SUMMARY} SELECT cluster_id, name FROM s) GROUP BY cluster_id"
MEMBER_COUNTS = f"""SELECT cluster_id, 'nodes' AS member, count(*) AS n FROM {{nodes}} GROUP BY cluster_id UNION ALL SELECT DISTINCT cluster_id, 'cluster', 1 FROM {{nodes}}
UNION ALL SELECT DISTINCT cluster_id, 'schemaVersion', 1 FROM {{nodes}} UNION ALL SELECT cluster_id, 'paramJudgments', n FROM ({DRIFTS})"""


@check("snk_02_document_parts", MEMBER_COUNTS)
def _(v):
    return parts(v).groupBy("cluster_id", "member").agg(F.count(F.lit(1)).alias("n"))


ALL_MEMBERS = ", ".join(f"('{n}')" for n, _ in documents.MEMBERS)


@check("snk_02_cluster_documents", f"""WITH c AS ({MEMBER_COUNTS}), k AS (SELECT DISTINCT cluster_id FROM {{nodes}}), m(member) AS (VALUES {ALL_MEMBERS}),
r AS (SELECT cluster_id, 'nodes' AS member, sum(hash_role) AS roles FROM (SELECT cluster_id, CASE role WHEN 'primary' THEN 1 WHEN 'dr' THEN 1000 ELSE 1000000 END AS hash_role FROM {{nodes}}) GROUP BY cluster_id)
SELECT k.cluster_id, m.member, coalesce(c.n, 0) AS n_items, CAST(r.roles AS BIGINT) AS roles FROM k CROSS JOIN m LEFT JOIN c USING (cluster_id, member) LEFT JOIN r USING (cluster_id, member)""")
def _(v):
    """Every item of every cluster is in one chunk, however small the slices are."""
    chunks = documents.cluster_documents(parts(v), slice_items=7)
    nodes = F.from_json("json", "array<struct<role:string>>")
    weight = F.aggregate(nodes, F.lit(0).cast("bigint"), lambda t, n: t + F.when(n["role"] == "primary", 1).when(n["role"] == "dr", 1000).otherwise(1000000))
    counted = chunks.withColumn("w", F.when(F.col("member") == "nodes", weight))
    return counted.groupBy("cluster_id", "member").agg(F.sum("n_items").alias("n_items"), F.sum("w").alias("roles"))


@check("snk_01_write_mart", "SELECT cluster_id, count(*) AS n_nodes, count(*) FILTER (role <> 'primary') AS n_replicas FROM {nodes} GROUP BY cluster_id")
def _(v):
    """A result table written, written again for the same snapshot, and read back."""
    path = f"{shared_folder(v.spark)}/marts-{uuid.uuid4().hex}"
    topology = fleet.topology(v["nodes"])
    for _ in range(2):
        tables.write_marts({"topology": topology}, path)
    return tables.read_base_tables(v.spark, path, ["topology"])["topology"].select("cluster_id", "n_nodes", "n_replicas")


@check("dq_01_validate", """
SELECT cluster_id, 'WARN' AS level, 'schemaVersion' AS path, 'older than current' AS message, 1 AS n FROM {nodes} WHERE cluster_id % 4 = 1 GROUP BY cluster_id
UNION ALL SELECT cluster_id, 'ERROR', 'project', 'missing', 1 FROM {nodes} WHERE cluster_id % 4 = 2 GROUP BY cluster_id
UNION ALL SELECT cluster_id, 'ERROR', 'nodes.role', 'missing', count(*) FROM {nodes} WHERE k % 10 = 0 GROUP BY cluster_id
UNION ALL SELECT CAST(o_custkey % 25 AS BIGINT), 'ERROR', 'issues.priority', 'missing', count(*) FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1
UNION ALL SELECT CAST(o_custkey % 25 AS BIGINT), 'WARN', 'issues.priority', 'not P0-P3', count(*) FROM orders WHERE o_orderkey % 9 = 1 GROUP BY 1
UNION ALL SELECT CAST(o_custkey % 25 AS BIGINT), 'WARN', 'issues.description', 'missing', count(*) FROM orders WHERE o_orderkey % 9 = 2 GROUP BY 1""")
def _(v):
    cluster, k, o = F.col("cluster_id"), F.col("k"), F.col("o_orderkey") % 9
    headers = fleet.topology(v["nodes"]).select(
        *CLUSTER_KEYS, F.when(cluster % 4 == 1, 2).otherwise(3).alias("schema_version"), F.when(cluster % 4 != 2, "p").alias("project"),
        F.col("label").alias("topology"), "n_nodes", F.lit("ok").alias("overall_assessment"))
    nodes = v["nodes"].select(*KEYS, F.when(k % 10 != 0, F.col("role")).alias("role"))
    rows = v["orders"].select(
        (F.col("o_custkey") % 25).alias("cluster_id"), F.lit("2024-01-31").cast("date").alias("snapshot_date"),
        F.when(o == 1, "P9").when(o != 0, "P1").alias("priority"), F.when(o != 2, "text").alias("description"))
    return plain(documents.validate(headers, rows, nodes))




# --- Whole documents: every member from the views, written, and read back line by line.

PRIORITY = "CASE WHEN k % 4 = 0 THEN 'P0' ELSE 'P2' END"
HORIZON_OF = "CASE WHEN k % 4 = 0 THEN 'immediate' ELSE 'mid_term' END"


def seventeen(v):
    """All members of every cluster's document."""
    nodes = v["nodes"].withColumn("node_order", F.col("k"))
    topology = fleet.topology(v["nodes"])

    def constant(value):
        return topology.select(*CLUSTER_KEYS, value.cast("string").alias("value"))

    some = nodes.where("k % 3 = 0")
    return documents.document_parts({
        "schemaVersion": topology.select(*CLUSTER_KEYS, F.lit(3).alias("value")),
        "project": constant(F.concat(F.lit("p"), F.col("cluster_id"))), "reportVersion": constant(F.lit("1.0")),
        "inspectionDate": constant(F.col("snapshot_date")), "reportDate": constant(F.col("snapshot_date")),
        "cluster": topology.select(*CLUSTER_KEYS, F.col("label").alias("topology"), F.col("n_nodes").alias("nodeCount")),
        documents.ADDRESSES: nodes.select(*CLUSTER_KEYS, "node_ip", "node_order"),
        "healthScore": topology.select(*CLUSTER_KEYS, (100 - F.col("n_nodes") % 50).alias("total")),
        "overallAssessment": topology.select(*CLUSTER_KEYS, F.when(F.col("cluster_id") % 2 == 0, "fine").alias("label")),
        "issues": some.select(*CLUSTER_KEYS, F.col("k").alias("seq"), F.expr(PRIORITY).alias("priority"), F.concat(F.lit('is "'), "hostname", F.lit('"')).alias("description")),
        "correlations": nodes.where("k % 5 = 0").select(*CLUSTER_KEYS, F.concat(F.lit("COR-"), F.col("k")).alias("code")),
        "paramJudgments": nodes.where("k % 7 = 0").select(*CLUSTER_KEYS, F.concat(F.lit("v"), F.col("k")).alias("name"), (F.col("k") % 2 == 0).alias("ok")),
        "backupAssessment": topology.where("cluster_id % 3 = 0").select(*CLUSTER_KEYS, F.lit("P1").alias("severity")),
        "securityAssessment": topology.select(*CLUSTER_KEYS, F.lit("low").alias("level")),
        "nodes": nodes.select(*KEYS, F.col("node_ip").alias("ip"), "node_order", "role"),
        "recommendations": some.select(*CLUSTER_KEYS, F.expr(HORIZON_OF).alias("horizon"), F.concat(F.lit("do "), F.col("k")).alias("text")),
        "hcConfig": topology.select(*CLUSTER_KEYS, F.lit("80").alias("disk.high_pct")),
        "disabledRulesApplied": constant(F.lit("")),
    })


def _document_sql() -> str:
    """The same lines by hand: (cluster, slot, step, position, text)."""
    single = "(SELECT cluster_id, count(*) AS n FROM {nodes} GROUP BY cluster_id)"
    label = "CASE WHEN n > 1 THEN concat('primary + ', n - 1, ' replicas (async)') ELSE 'single node' END"
    values = {
        "schemaVersion": "'3'", "project": "concat('\"p', cluster_id, '\"')", "reportVersion": "'\"1.0\"'", "inspectionDate": "'\"2024-01-31\"'",
        "reportDate": "'\"2024-01-31\"'", "cluster": f"concat('{{\"topology\":\"', {label}, '\",\"nodeCount\":', n)",
        "healthScore": "concat('{\"total\":', 100 - n % 50, '}')", "overallAssessment": "CASE WHEN cluster_id % 2 = 0 THEN '\"fine\"' ELSE 'null' END",
        "backupAssessment": "CASE WHEN cluster_id % 3 = 0 THEN '{\"severity\":\"P1\"}' ELSE 'null' END", "securityAssessment": "'{\"level\":\"low\"}'",
        "hcConfig": "'{\"disk.high_pct\":\"80\"}'", "disabledRulesApplied": "'\"\"'",
    }
    order = "lpad(CAST(k AS VARCHAR), 19, '0')"
    items = {
        "ips": ("concat('\"', node_ip, '\"')", order, "TRUE"),
        "issues": (f"concat('{{\"seq\":', k, ',\"priority\":\"', {PRIORITY}, '\",\"description\":\"is \\\"', hostname, '\\\"\"}}')", order, "k % 3 = 0"),
        "correlations": ("concat('{\"code\":\"COR-', k, '\"}')", "concat('COR-', k)", "k % 5 = 0"),
        "paramJudgments": ("concat('{\"name\":\"v', k, '\",\"ok\":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '}')", "concat('v', k)", "k % 7 = 0"),
        "nodes": ("concat('{\"node_ip\":\"', node_ip, '\",\"ip\":\"', node_ip, '\",\"node_order\":', k, ',\"role\":\"', role, '\"}')", order, "TRUE"),
        **{h: ("concat('\"do ', k, '\"')", "''", f"k % 3 = 0 AND {HORIZON_OF} = '{h}'") for h in ("immediate", "short_term", "mid_term", "long_term")},
    }
    slots = [
        *(("single", m) for m in ("schemaVersion", "project", "reportVersion", "inspectionDate", "reportDate", "cluster")), ("ips", "ips"),
        *(("single", m) for m in ("healthScore", "overallAssessment")), *(("list", m) for m in ("issues", "correlations", "paramJudgments")),
        *(("single", m) for m in ("backupAssessment", "securityAssessment")), ("list", "nodes"),
        *(("horizon", m) for m in ("immediate", "short_term", "mid_term", "long_term")), ("single", "hcConfig"), ("single", "disabledRulesApplied"),
    ]
    rows = []
    for i, (kind, m) in enumerate(slots):
        before = {"single": f'"{m}":', "ips": ',"ips":[', "list": f'"{m}":[', "horizon": ('"recommendations":{' if m == "immediate" else ",") + f'"{m}":['}[kind]
        after = {"single": ",", "ips": "]},", "list": "],", "horizon": "]}," if m == "long_term" else "]"}[kind]
        after = "" if m == "cluster" else "}" if m == "disabledRulesApplied" else after
        rows += [f"SELECT cluster_id, {i}, 0, '', '{"{" if i == 0 else ""}{before}' FROM {single}", f"SELECT cluster_id, {i}, 3, '', '{after}' FROM {single}"]
        if kind == "single":
            rows.append(f"SELECT cluster_id, {i}, 1, '', {values[m]} FROM {single}")
        else:
            text, position, where = items[m]
            by = f"({position}), ({text})"
            rows.append(
                f"SELECT cluster_id, {i}, 1, {position}, concat(CASE WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY {by}) = 1 THEN '' ELSE ',' END, {text}) FROM {{nodes}} WHERE {where}"
            )
    body = " UNION ALL ".join(rows)
    return f"""WITH l(cluster_id, slot, step, position, line) AS ({body})
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY slot, step, position, ltrim(line, ',')) - 1 AS INTEGER) AS line_no, line FROM l"""


@check("snk_02_document_text", _document_sql())
def _(v):
    """Every line, in its place, of the JSON file of every cluster: 17 members each."""
    path = f"{shared_folder(v.spark)}/documents-{uuid.uuid4().hex}"
    tables.write_cluster_documents(documents.document_lines(seventeen(v)), path)
    text = documents.read_documents(v.spark, path)
    lines = F.split(F.regexp_replace("json", "\n$", ""), "\n")
    return text.select("cluster_id", F.posexplode(lines).alias("line_no", "line"))


@check("dq_01_own_documents", "SELECT cluster_id, 'ERROR' AS level, 'overallAssessment' AS path, 'missing' AS message, 1 AS n FROM {nodes} WHERE cluster_id % 2 = 1 GROUP BY cluster_id UNION ALL SELECT cluster_id, 'WARN', 'issues.priority', 'not P0-P3', count(*) FROM {nodes} WHERE k % 12 = 0 GROUP BY cluster_id")
def _(v):
    """Documents in parts, too large for a row or not: the label is null in every second cluster, priorities are spoilt."""
    spoilt = seventeen(v).withColumn("json", F.regexp_replace("json", '"seq":(\\d*),"priority":"P0"', '"seq":$1,"priority":"urgent"'))
    return plain(documents.validate_parts(spoilt))


# A fault per way that a path can be wrong: (member, its text in place of the sound one, level, path, message).
SOUND = {
    "schemaVersion": "3", "project": '"p"', "reportVersion": '"1.0"', "inspectionDate": '"2024-01-31"', "reportDate": '"2024-01-31"',
    "cluster": '{"topology":"single node","nodeCount":1,"ips":["10.0.0.1"]}', "healthScore": '{"total":9}', "overallAssessment": '"fine"',
    "issues": '[{"priority":"P1","description":"d"}]', "correlations": "[]", "paramJudgments": "[]", "backupAssessment": "{}",
    "securityAssessment": "{}", "nodes": '[{"ip":"10.0.0.1","role":"primary","hostname":"h"}]', "recommendations": "{}", "collectorVersion": '"3.0"',
}
FAULTS = [
    *((m, None, "ERROR", m, "missing") for m in ("project", "inspectionDate", "reportDate", "overallAssessment", "issues", "nodes")),
    *((m, "null", "ERROR", m, "missing") for m in ("project", "issues")),
    *((m, "7", "ERROR", m, "not of kind string: number") for m in ("project", "reportVersion", "inspectionDate", "reportDate", "overallAssessment")),
    *((m, "{}", "ERROR", m, "not of kind array: object") for m in ("issues", "correlations", "paramJudgments", "nodes")),
    *((m, '"x"', "ERROR", m, "not of kind object: string") for m in ("healthScore", "backupAssessment", "securityAssessment", "recommendations")),
    ("cluster", '{"nodeCount":1,"ips":["a"]}', "ERROR", "cluster.topology", "missing"),
    ("cluster", '{"topology":"t","ips":["a"]}', "ERROR", "cluster.nodeCount", "missing"),
    ("cluster", '{"topology":"t","nodeCount":"1","ips":["a"]}', "ERROR", "cluster.nodeCount", "not of kind number: string"),
    ("cluster", '{"topology":"t","nodeCount":1}', "ERROR", "cluster.ips", "missing"),
    ("cluster", '{"topology":"t","nodeCount":1,"ips":[]}', "ERROR", "cluster.ips", "too short"),
    ("cluster", '{"topology":true,"nodeCount":1,"ips":["a"]}', "ERROR", "cluster.topology", "not of kind string: boolean"),
    ("nodes", "[]", "ERROR", "nodes", "too short"),
    ("nodes", '[{"role":"dr"}]', "ERROR", "nodes.ip", "missing"),
    ("nodes", '[{"ip":"a","hostname":"h"}]', "ERROR", "nodes.role", "missing"),
    ("nodes", '[{"ip":"a","role":"dr","hostname":5}]', "ERROR", "nodes.hostname", "not of kind string: number"),
    ("issues", '[{"description":"d"}]', "ERROR", "issues.priority", "missing"),
    ("issues", '[{"priority":"P4","description":"d"}]', "WARN", "issues.priority", "not P0-P3"),
    ("issues", '[{"priority":"P0","description":""}]', "WARN", "issues.description", "missing"),
    ("schemaVersion", None, "WARN", "schemaVersion", "missing"),
    ("schemaVersion", "2", "WARN", "schemaVersion", "older than current"),
    ("schemaVersion", "4", "WARN", "schemaVersion", "newer than supported"),
    ("collectorVersion", '"three"', "WARN", "collectorVersion", "not a version"),
]
FAULT_ROWS = ", ".join(f"({i}, '{level}', '{path}', '{message}')" for i, (_, _, level, path, message) in enumerate(FAULTS))


@check("dq_01_document_paths", f"""
SELECT cluster_id, node_ip, level, path, message, 1 AS n FROM {{nodes}} JOIN (VALUES {FAULT_ROWS}) f(i, level, path, message) ON k % {len(FAULTS) + 1} = i""")
def _(v):
    """A document per node, each with one fault of its own or none."""
    fault = F.col("k") % (len(FAULTS) + 1)

    def member(name):
        text = F.lit(f'"{name}":{SOUND[name]}')
        for i, (spoilt, value, *_) in enumerate(FAULTS):
            if spoilt == name:
                text = F.when(fault == i, F.lit(None if value is None else f'"{name}":{value}').cast("string")).otherwise(text)
        return text

    body = F.concat(F.lit("{"), F.concat_ws(",", *[member(m) for m in SOUND]), F.lit("}"))
    return plain(documents.validate_documents(v["nodes"].select(*KEYS, body.alias("json")), KEYS))
