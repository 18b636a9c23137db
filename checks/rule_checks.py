"""RUL-*: every rule alone, all rules together, and rules under layered configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.catalog_checks import AUTO_ALL, K, NO_PK, RATE, USER, auto_increment, no_pk
from checks.config_checks import LAYERED, layered_config
from checks.registry import check
from checks.workload_checks import LONG
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import catalog, fleet, rules

Threshold = Callable[[str], str]
COLUMNS = ["cluster_id", "node_ip", "type", "priority", "scope", "subject", "dimension", "n_objects"]


def default(key: str) -> str:
    return f"{float(fv.DEFAULT_THRESHOLDS[key])}::DOUBLE"


def num(name: str) -> str:
    return f"TRY_CAST(v_{name} AS DOUBLE)"


MEM = "(mem_total_kb / 1048576.0::DOUBLE)"
SHARE = f"({num('innodb_buffer_pool_size_in_mb')} / 1024 / {MEM})"
REDO = num("innodb_log_file_size_in_mb")
HIT = "(bp_hits * 100.0::DOUBLE / bp_lookups)"
LINUX = "(k % 9 <> 0)"
DR = "(role = 'dr' OR k % 7 = 0)"
UP = "(io_running = 'Yes' AND sql_running = 'Yes')"
PEAK = f"((1.0::DOUBLE + {num('tmp_table_size_in_mb')}) * {num('max_connections')} / ({MEM} * 1024))"
SIZE = "coalesce(NULLIF(primary_gb, 0), db_total_gb, 0)"
RATIO = f"(db_total_gb / {MEM})"


def simple_rules(t: Threshold) -> list[tuple]:
    """(id, type, priority, condition, subject or None for the node, dimension)."""
    hll, lag = "history_list", "lag_seconds"
    return [
        (1, "mem_high", "'P1'", f"mem_pct > {t('memory.high_pct')}", None, None),
        (2, "os_version_eol", "CASE k % 6 WHEN 0 THEN 'P1' ELSE 'P2' END", "k % 6 IN (0, 1, 2)", "concat('CentOS ', 6 + k % 6)", None),
        (3, "swap_used", "'P1'", "swap_used_kb > 0", None, None),
        (4, "innodb_hll_high", f"CASE WHEN {hll} >= {t('innodb.hll_p1')} THEN 'P1' ELSE 'P2' END", f"{hll} > {t('innodb.hll_warn')}", None, None),
        (8, "repl_thread_down", "'P0'", f"is_replica AND NOT {UP}", None, None),
        (9, "repl_delay_high", "'P1'", f"is_replica AND {UP} AND {lag} > {t('replication.delay_p1_seconds')}", None, None),
        (10, "repl_delay_low", "'P2'", f"is_replica AND {UP} AND {lag} > {t('replication.delay_p2_seconds')} AND {lag} <= {t('replication.delay_p1_seconds')}", None, None),
        (16, "slow_query_abs_high", "'P1'", f"slow_queries > {t('sql.slow_query_abs_high')}", None, None),
        (17, "slow_query_abs_med", "'P2'", f"slow_queries > {t('sql.slow_query_abs_med')} AND slow_queries <= {t('sql.slow_query_abs_high')}", None, None),
        (18, "slow_log_off", "'P2'", "v_slow_query_log = '0'", None, None),
        (19, "long_query_time_loose", "'P3'", f"{num('long_query_time')} >= {t('sql.long_query_time_loose')}", None, None),
        (20, "ibtmp1_oversize", "'P2'", f"temp_bytes > {t('innodb.ibtmp1_max_gb')} * 1073741824", None, None),
        (21, "tls_weak_protocol", "'P2'", "tls_version LIKE 'TLSv1,%'", "''", None),
        (22, "ibtmp1_no_max", "'P2'", "v_innodb_temp_data_file_path NOT LIKE '%:max:%'", "''", None),
        (23, "flush_log_weak", "'P1'", "v_innodb_flush_log_at_trx_commit = '0'", "''", None),
        (24, "sync_binlog_weak", "'P1'", "v_sync_binlog = '0'", "''", None),
        (25, "gtid_off", "'P2'", "v_gtid_mode = 'OFF'", "''", None),
        (26, "master_readonly", "CASE WHEN role_source = 'standalone_readonly' THEN 'P3' ELSE 'P1' END", "role = 'primary' AND v_read_only = '1'", None, None),
        (27, "slave_writable", "'P1'", f"role <> 'primary' AND is_replica AND v_read_only = '0' AND NOT {DR}", None, None),
        (28, "dr_writable", "'P3'", f"role <> 'primary' AND is_replica AND v_read_only = '0' AND {DR}", None, None),
        (29, "self_ref_slave_residue", "'P2'", "is_residue", None, None),
        (30, "expire_logs_zero", "'P1'", "v_expire_logs_days = '0'", None, None),
        (31, "expire_logs_long", "'P3'", f"v_expire_logs_days <> '0' AND {num('expire_logs_days')} > {t('binlog.expire_logs_max_days')}", None, None),
        (32, "bp_hit_low", "'P1'", f"{HIT} < {t('innodb.bp_hit_low_pct')}", None, None),
        (33, "bp_hit_sub99", "'P3'", f"{HIT} >= {t('innodb.bp_hit_low_pct')} AND {HIT} < {t('innodb.bp_hit_warn_pct')}", None, None),
        (34, "bp_too_small", f"CASE WHEN {SHARE} < {t('innodb.bp_too_small_p1_ratio')} THEN 'P1' ELSE 'P2' END",
         f"{MEM} >= {t('innodb.bp_too_small_min_mem_gb')} AND {SHARE} < {t('innodb.bp_too_small_ratio')}", None, "performance"),
        (35, "bp_too_large", "'P1'", f"{MEM} >= {t('innodb.bp_too_small_min_mem_gb')} AND {SHARE} > {t('innodb.bp_too_large_ratio')}", None, "availability"),
        (36, "redo_log_too_small", f"CASE WHEN {REDO} < 128 THEN 'P1' ELSE 'P2' END",
         f"{REDO} < {t('innodb.redo_log_min_mb')} AND (db_total_gb >= {t('innodb.redo_log_db_gb_busy')} OR qps > 200)", None, "performance"),
        (37, "flush_method_not_o_direct", "'P2'", f"{LINUX} AND v_innodb_flush_method = 'fsync'", "''", "performance"),
        (38, "doublewrite_off", "'P1'", "v_innodb_doublewrite <> 'ON'", "''", "durability"),
        (39, "charset_not_utf8mb4", "'P2'", "v_character_set_server <> 'utf8mb4'", "''", "dataDesign"),
        (40, "sql_mode_missing_strict", "'P2'", "sql_mode NOT LIKE '%STRICT%'", "''", "dataDesign"),
        (41, "auth_plugin_native_on_80", "'P2'", "k % 9 IN (3, 4, 5, 6, 7) AND v_default_authentication_plugin = 'mysql_native_password'", "''", "security"),
        (42, "performance_schema_off", "'P2'", "v_performance_schema = 'OFF'", "''", "operations"),
        (43, "max_connections_vs_memory", f"CASE WHEN {PEAK} > {t('max_connections.peak_memory_ratio_p1')} THEN 'P1' ELSE 'P2' END",
         f"{PEAK} > {t('max_connections.peak_memory_ratio_warn')}", None, "availability"),
        (44, "slave_skip_errors_set", "'P0'", "v_slave_skip_errors = '1062'", None, "durability"),
        (46, "data_to_memory_ratio_high", f"CASE WHEN {RATIO} > {t('data_memory.ratio_p1')} THEN 'P1' ELSE 'P2' END", f"{RATIO} > {t('data_memory.ratio_warn')}", None, "performance"),
        (50, "lct_zero_linux", "'P3'", f"v_lower_case_table_names = '0' AND {LINUX}", "''", None),
        (51, "slave_parallel_workers_zero", f"CASE WHEN {SIZE} >= {t('replication.parallel_workers_data_gb_p1')} THEN 'P1' ELSE 'P2' END",
         f"role <> 'primary' AND is_replica AND v_slave_parallel_workers = '0' AND {SIZE} >= {t('replication.parallel_workers_data_gb_p2')}", "''", None),
        (52, "mysql_version_eol", "CASE WHEN k % 9 IN (0, 1) THEN 'P0' WHEN k % 9 = 2 THEN 'P1' ELSE 'P2' END", "k % 9 IN (0, 1, 2, 6, 7)",
         "CASE k % 9 WHEN 0 THEN '5.5' WHEN 1 THEN '5.6' WHEN 2 THEN '5.7' WHEN 6 THEN 'MariaDB 10.x' ELSE 'MariaDB 11.0-11.3' END", None),
        (53, "mysql_version_security", "'P3'", "k % 9 = 3", "'8.0'", None),
    ]


FACTS = "(SELECT *, max(CASE WHEN role = 'primary' THEN db_total_gb END) OVER (PARTITION BY cluster_id) AS primary_gb FROM {nodes})"


def select_rule(source: str, rule: str, priority: str, where: str, subject: str | None, dimension: str | None, n: str = "CAST(NULL AS BIGINT)") -> str:
    scope = "node" if subject is None or subject.startswith("concat(node_ip") else "cluster"
    dim = f"'{dimension}'" if dimension else "CAST(NULL AS VARCHAR)"
    return f"SELECT {K}, '{rule}' AS type, {priority} AS priority, '{scope}' AS scope, {subject or 'node_ip'} AS subject, {dim} AS dimension, {n} AS n_objects, role, node_order FROM {source} WHERE {where}"


def disk_sql(t: Threshold) -> list[tuple[int, str, str]]:
    critical, high = t("disk.critical_pct"), t("disk.high_pct")
    source = "(SELECT d.*, n.role, n.node_order FROM {disks} d JOIN {nodes} n USING (cluster_id, node_ip))"
    subject = "concat(node_ip, ':', mount)"
    return [
        (6, "disk_critical", select_rule(source, "disk_critical", "'P0'", f"use_pct >= {critical}", subject, None)),
        (7, "disk_high", select_rule(source, "disk_high", "'P1'", f"use_pct >= {high} AND use_pct < {critical}", subject, None)),
    ]


def raw_sql(t: Threshold = default) -> str:
    """Every rule that the nodes view can fire, as one union."""
    parts = [select_rule(FACTS, *r[1:]) for r in simple_rules(t)] + [s for _, _, s in disk_sql(t)]
    return "\nUNION ALL ".join(parts)


def nodes_of(v) -> DataFrame:
    return fleet.conform(v.node_facts())


def only_columns(sql: str) -> str:
    return f"SELECT {', '.join(COLUMNS)} FROM ({sql})"


def register_single(number: int, rule: str, sql: str) -> None:
    @check(f"rul_{number:02d}_{rule}", only_columns(sql))
    def _(v):
        return rules.evaluate_rules(nodes_of(v), only=[rule]).select(*COLUMNS)


for number, rule, *rest in simple_rules(default):
    register_single(number, rule, select_rule(FACTS, rule, *rest))
for number, rule, disk in disk_sql(default):
    register_single(number, rule, disk)


@check("rul_00_evaluate_rules", only_columns(raw_sql()))
def _(v):
    return rules.evaluate_rules(nodes_of(v)).select(*COLUMNS)


@check("rul_00_evaluate_rules_layered", f"""
SELECT {', '.join(c for c in COLUMNS if c != 'priority')}, CASE WHEN type = 'gtid_off' THEN 'P3' ELSE priority END AS priority FROM ({raw_sql(LAYERED)})
WHERE NOT (cluster_id % 5 = 1 AND type IN ('sql_mode_missing_strict', 'charset_not_utf8mb4', 'auth_plugin_native_on_80', 'performance_schema_off'))""")
def _(v):
    return rules.evaluate_rules(nodes_of(v), layered_config(v)).select(*COLUMNS)


def child_nodes(facts: DataFrame) -> DataFrame:
    """Nodes made of child-table sums alone."""
    return fleet.conform(facts).withColumns({"role": F.lit("primary"), "node_order": F.col("node_ip")})


def child_rule(number: int, rule: str, facts: str, priority: str, where: str, subject: str | None, dimension: str | None, n: str):
    sql = select_rule(f"(SELECT *, 'primary' AS role, node_ip AS node_order FROM ({facts}))", rule, priority, where, subject, dimension, n)

    def register(build):
        @check(f"rul_{number:02d}_{rule}", only_columns(sql))
        def _(v):
            return rules.evaluate_rules(child_nodes(build(v)), only=[rule]).select(*COLUMNS)

        return build

    return register


SESSIONS = f"SELECT {K}, count(*) FILTER ({LONG}) AS n, max(time_s) FILTER ({LONG}) AS top FROM {{sessions}} GROUP BY {K}"
NO = "CAST(NULL AS BIGINT)"


@child_rule(5, "long_running_session", SESSIONS, "CASE WHEN top >= 600 THEN 'P2' ELSE 'P3' END", "n > 0", None, None, NO)
def _(v):
    return fleet.session_facts(v["sessions"])


OTHER = "(" + " OR ".join(f"regexp_matches(table_name, '{p}')" for p in fv.TEMP_OR_HISTORY_PATTERNS) + ")"
NO_PK_FACTS = f"SELECT {K}, count(*) FILTER (NOT {OTHER}) AS business, count(*) FILTER ({OTHER}) AS other FROM ({NO_PK}) GROUP BY {K}"


@child_rule(11, "no_pk_tables", NO_PK_FACTS, "'P2'", "business > 0", "''", None, "business")
def _(v):
    return fleet.no_pk_facts(no_pk(v))


# Spread over more nodes, some of which then hold nothing but archive tables.
SPREAD = "concat(node_ip, '/', CAST(regexp_extract(table_name, '_t([0-9]+)', 1) AS BIGINT) % 11)"


@child_rule(12, "no_pk_tables_temp_only",
            f"SELECT cluster_id, ip AS node_ip, count(*) FILTER (NOT {OTHER}) AS business, count(*) FILTER ({OTHER}) AS other "
            f"FROM (SELECT *, {SPREAD} AS ip FROM ({NO_PK})) GROUP BY cluster_id, ip",
            "'P3'", "business = 0 AND other > 0", "''", None, "other")
def _(v):
    number = F.regexp_extract("table_name", "_t([0-9]+)", 1).cast("bigint") % 11
    spread = no_pk(v).withColumn("node_ip", F.concat_ws("/", "node_ip", number.cast("string")))
    return fleet.no_pk_facts(spread)


FRAG = f"SELECT *, {RATE} AS frag_rate FROM {{cat_tables}} WHERE {USER} AND data_length + index_length > 4194304 AND {RATE} > 0.3"


def fragments(v):
    frag = catalog.fragmented_tables(v["cat_tables"])
    return fleet.fragment_facts(frag, F.lit(fv.DEFAULT_THRESHOLDS["frag.rate"]), F.lit(fv.DEFAULT_THRESHOLDS["frag.min_mb"]))


GHOST = "k % 23 = 0 AND data_length + data_free >= 1073741824"


@child_rule(13, "ghost_tables", f"SELECT {K}, count(*) FILTER ({GHOST}) AS n FROM ({FRAG}) GROUP BY {K}", "'P2'", "n > 0", "''", None, "n")
def _(v):
    return fragments(v)


@child_rule(14, "non_utf8_tables", f"SELECT {K}, count(*) AS n FROM {{cat_tables}} WHERE {USER} AND k % 12 = 0 GROUP BY {K}", "'P2'", "n > 0", "''", None, "n")
def _(v):
    return fleet.non_utf8_facts(catalog.non_utf8_tables(v["cat_tables"]))


@child_rule(15, "heavy_frag_tables", f"SELECT {K}, count(*) FILTER (frag_rate >= 0.7 AND data_free >= 104857600) AS n FROM ({FRAG}) GROUP BY {K}", "'P2'", "n > 0", "''", None, "n")
def _(v):
    return fragments(v)


@child_rule(45, "auto_increment_exhausting", f"SELECT {K}, count(*) FILTER (rate >= 0.7) AS n, max(rate) AS top FROM ({AUTO_ALL}) GROUP BY {K}",
            "CASE WHEN top >= 0.9 THEN 'P0' WHEN top >= 0.8 THEN 'P1' ELSE 'P2' END", "n > 0", "''", "dataDesign", "n")
def _(v):
    return fleet.auto_increment_facts(auto_increment(v), F.lit(fv.DEFAULT_THRESHOLDS["auto_increment.rate_p2"]))


LEVELS = {"critical": ("P0", "(user_name = 'root' OR user_name LIKE 'admin%')"), "high": ("P1", "user_name LIKE 'backup%'"),
          "medium": ("P2", "(user_name LIKE 'app%' OR user_name LIKE 'repl%')")}


def register_wildcard(number: int, level: str) -> None:
    priority, match = LEVELS[level]

    @child_rule(number, f"wildcard_{level}", f"SELECT {K}, count(*) FILTER (host = '%' AND {match}) AS n FROM {{cat_users}} GROUP BY {K}",
                f"'{priority}'", "n > 0", "node_ip", None, "n")
    def _(v):
        return fleet.account_facts(v["cat_users"])


for number, level in ((47, "critical"), (48, "high"), (49, "medium")):
    register_wildcard(number, level)

INCONSISTENT = "\nUNION ALL ".join(
    f"SELECT cluster_id, '{p}' AS subject, 'param_inconsistent' AS type, 'P2' AS priority FROM {{nodes}} GROUP BY cluster_id HAVING count(*) > 1 AND count(DISTINCT v_{p}) > 1"
    for p in fv.CONSISTENT_PARAMETERS
)


@check("rul_54_param_inconsistent", INCONSISTENT)
def _(v):
    return rules.parameter_issues(nodes_of(v)).select("cluster_id", "subject", "type", "priority")


def text_sql(rule: str, description: str, current: str = "CAST(NULL AS VARCHAR)", recommended: str = "CAST(NULL AS VARCHAR)") -> str:
    where = next(r[3] for r in simple_rules(default) if r[1] == rule)
    return f"SELECT {K}, '{rule}' AS type, {description} AS description, {current} AS current_value, {recommended} AS recommended_value FROM {FACTS} WHERE {where}"


PER_CONNECTION = f"(1.0::DOUBLE + {num('tmp_table_size_in_mb')})"
ADVISED_CONNECTIONS = f"CAST(floor({MEM} * 1024 * {default('max_connections.peak_memory_ratio_warn')} / greatest({PER_CONNECTION}, 1.0)) AS BIGINT)"
TEXTS = "\nUNION ALL ".join([
    text_sql("slow_query_abs_high", "concat(slow_queries, ' slow queries')"),
    text_sql("slow_query_abs_med", "concat(slow_queries, ' slow queries')"),
    text_sql("slow_log_off", "'slow log is off'"),
    text_sql("long_query_time_loose", "concat('long_query_time = ', v_long_query_time)"),
    text_sql("auth_plugin_native_on_80", "'default authentication plugin is mysql_native_password'", "'mysql_native_password'", "'caching_sha2_password'"),
    text_sql("max_connections_vs_memory", "CAST(NULL AS VARCHAR)", f"concat('max_connections=', CAST({num('max_connections')} AS BIGINT))", f"concat('max_connections=', {ADVISED_CONNECTIONS})"),
    text_sql("data_to_memory_ratio_high", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "concat(CAST(ceil(db_total_gb / 5) AS BIGINT), ' GB of memory')"),
])


@check("rul_00_issue_texts", TEXTS)
def _(v):
    """Wording and advice. Numbers with decimals are left to tests: the two engines round them differently."""
    kinds = ["slow_query_abs_high", "slow_query_abs_med", "slow_log_off", "long_query_time_loose", "auth_plugin_native_on_80", "max_connections_vs_memory", "data_to_memory_ratio_high"]
    found = rules.evaluate_rules(nodes_of(v), only=kinds)
    rounded = F.col("type").isin("max_connections_vs_memory", "data_to_memory_ratio_high")
    return found.select(
        "cluster_id", "node_ip", "type", F.when(~rounded, F.col("description")).alias("description"),
        F.when(F.col("type") != "data_to_memory_ratio_high", F.col("current_value")).alias("current_value"), "recommended_value")
