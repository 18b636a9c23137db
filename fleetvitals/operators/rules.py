"""Threshold rules over node_facts.

Every node rule is one entry of a declarative list. Evaluation is a single
projection that builds an array of the rules that fired and explodes it, so
all rules share one scan and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S
from fleetvitals.functions.once import made_once
from fleetvitals.operators import fleet
from fleetvitals.sources.config import Config, apply_config

NODE, CLUSTER = "node", "cluster"

# Advice per rule type: (what to do, statement to run). Static text, attached after merging.
ADVICE: dict[str, tuple[str, str | None]] = {
    "mem_high": ("Check workload and buffer pool size; add memory if needed", None),
    "os_version_eol": ("Plan a move to a supported operating system", None),
    "swap_used": ("Lower vm.swappiness to 1 or disable swap; check the buffer pool size", "sysctl -w vm.swappiness=1"),
    "innodb_hll_high": ("Look for long transactions and purge pressure", "SHOW ENGINE INNODB STATUS"),
    "long_running_session": ("Confirm the business impact before ending the session", "SHOW FULL PROCESSLIST"),
    "disk_critical": ("Free or add space now", None),
    "disk_high": ("Plan clean-up or more space this week", None),
    "repl_thread_down": ("Read the last replication error, then restart replication", "SHOW SLAVE STATUS"),
    "repl_delay_high": ("Look for large transactions; enable parallel replication", None),
    "repl_delay_low": ("Keep watching the replication delay", None),
    "no_pk_tables": ("Add a primary or unique key", None),
    "no_pk_tables_temp_only": ("Drop the tables when nothing uses them", None),
    "ghost_tables": ("Confirm nothing refers to the tables, then drop them", None),
    "non_utf8_tables": ("Convert the tables to utf8mb4", None),
    "heavy_frag_tables": ("Rebuild the tables in a maintenance window", None),
    "slow_query_abs_high": ("Digest the slow log and tune the top statements first", None),
    "slow_query_abs_med": ("Digest the slow log regularly", None),
    "slow_log_off": ("Enable the slow log", "SET GLOBAL slow_query_log = 1"),
    "long_query_time_loose": ("Lower the threshold to one second", "SET GLOBAL long_query_time = 1"),
    "ibtmp1_oversize": ("Set an upper limit and restart in a maintenance window", None),
    "tls_weak_protocol": ("Keep TLSv1.2 and newer only", None),
    "ibtmp1_no_max": ("Add an upper limit to the temporary tablespace", None),
    "flush_log_weak": ("Flush at every commit", "SET GLOBAL innodb_flush_log_at_trx_commit = 1"),
    "sync_binlog_weak": ("Sync the binlog at every commit", "SET GLOBAL sync_binlog = 1"),
    "gtid_off": ("Plan a rolling change to GTID", None),
    "master_readonly": ("Check whether the primary is read-only on purpose", "SET GLOBAL read_only = 0"),
    "slave_writable": ("Make the replica read-only", "SET GLOBAL read_only = 1"),
    "dr_writable": ("Document the exception if it is by design", None),
    "self_ref_slave_residue": ("Clear the left-over replication settings", "RESET SLAVE ALL"),
    "expire_logs_zero": ("Keep 7 to 15 days and purge old binlogs", "SET GLOBAL expire_logs_days = 7"),
    "expire_logs_long": ("Weigh disk cost against recovery needs", None),
    "bp_hit_low": ("Consider a larger buffer pool", None),
    "bp_hit_sub99": ("Watch the hit rate", None),
    "bp_too_small": ("Enlarge the buffer pool", None),
    "bp_too_large": ("Shrink the buffer pool", None),
    "redo_log_too_small": ("Enlarge the redo log", None),
    "flush_method_not_o_direct": ("Use O_DIRECT; needs a restart", None),
    "doublewrite_off": ("Enable doublewrite", "SET GLOBAL innodb_doublewrite = ON"),
    "charset_not_utf8mb4": ("Change the server default first, then convert", None),
    "sql_mode_missing_strict": ("Enable strict mode after a test", None),
    "auth_plugin_native_on_80": ("Move accounts to caching_sha2_password", None),
    "performance_schema_off": ("Enable performance_schema; needs a restart", None),
    "max_connections_vs_memory": ("Lower max_connections or the per-connection buffers", None),
    "slave_skip_errors_set": ("Turn it off and verify the data", None),
    "auto_increment_exhausting": ("Widen the column to BIGINT UNSIGNED", None),
    "data_to_memory_ratio_high": ("Add memory, archive or split the data", None),
    "wildcard_critical": ("Restrict the accounts to known networks now", None),
    "wildcard_high": ("Restrict the accounts to the hosts that need them", None),
    "wildcard_medium": ("Restrict the accounts to known networks", None),
    "lct_zero_linux": ("Keep in mind when moving between platforms", None),
    "slave_parallel_workers_zero": ("Use 8 to 16 workers", "SET GLOBAL slave_parallel_workers = 16"),
    "mysql_version_eol": ("Plan an upgrade to a supported release", None),
    "mysql_version_security": ("Watch the end-of-life date and plan the upgrade", None),
    "param_inconsistent": ("Decide whether the nodes should agree", None),
    "backup_capability": ("Improve backup tools, schedule and drills", None),
}


@dataclass
class Rule:
    type: str
    when: Column
    priority: Column
    about: Column
    scope: str = NODE
    subject: Column | None = None
    dimension: str | None = None
    n_objects: Column | None = None
    current: Column | None = None
    recommended: Column | None = None
    confirm: Column | None = None


def _text(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)


def _is(name: str, *values: str) -> Column:
    return F.coalesce(fleet.variable(name).isin(*values), F.lit(False))


def _p(name: str) -> Column:
    return F.lit(name)


def resource_rules(t) -> list[Rule]:
    os = S.os_lifecycle("os_release")
    hll = F.col("history_list")
    return [
        Rule(
            "mem_high",
            F.round("mem_pct", 1) > t("memory.high_pct"),
            _p("P1"),
            _text("memory usage %.1f%%", F.col("mem_pct")),
        ),
        Rule(
            "os_version_eol",
            os["status"] == "eol",
            os["priority"],
            F.concat(F.lit("operating system out of support: "), os["major"], F.lit(" since "), os["eol_date"]),
            CLUSTER,
            subject=os["major"],
        ),
        Rule(
            "swap_used",
            F.col("swap_used_kb") > 0,
            _p("P1"),
            _text("swap in use: %d of %d KB", F.col("swap_used_kb"), F.col("swap_total_kb")),
        ),
        Rule(
            "innodb_hll_high",
            hll > t("innodb.hll_warn"),
            F.when(hll >= t("innodb.hll_p1"), "P1").otherwise("P2"),
            _text("history list length %d", hll),
        ),
        Rule(
            "long_running_session",
            F.col("n_long_sessions") > 0,
            F.when(F.col("top_session_s") >= t("session.long_running_seconds_p2"), "P2").otherwise("P3"),
            _text("long session %s, %d s", F.col("top_session"), F.col("top_session_s")),
            confirm=F.lit(True),
        ),
    ]


def replication_rules(t) -> list[Rule]:
    replica = F.coalesce("is_replica", F.lit(False))
    up = (F.coalesce("io_running", F.lit("")) == "Yes") & (F.coalesce("sql_running", F.lit("")) == "Yes")
    lag = F.col("lag_seconds")
    late = _text("replication delay %d s", lag)
    primary = F.col("role") == "primary"
    dr = S.is_dr("role", "hostname", "file_name")
    inferred = F.coalesce(F.col("role_source") == "standalone_readonly", F.lit(False))
    writable = ~primary & replica & _is("read_only", "0")
    workers = F.coalesce(fleet.number("slave_parallel_workers"), F.lit(0.0))
    size = F.coalesce(F.nullif(F.col("primary_db_gb"), F.lit(0.0)), F.col("db_total_gb"), F.lit(0.0))
    return [
        Rule(
            "repl_thread_down",
            replica & ~up,
            _p("P0"),
            _text("replication thread down (IO=%s, SQL=%s)", F.col("io_running"), F.col("sql_running")),
        ),
        Rule("repl_delay_high", replica & up & (lag > t("replication.delay_p1_seconds")), _p("P1"), late),
        Rule(
            "repl_delay_low",
            replica
            & up
            & (lag > t("replication.delay_p2_seconds"))
            & ~(lag > t("replication.delay_p1_seconds")),
            _p("P2"),
            late,
        ),
        Rule(
            "master_readonly",
            primary & _is("read_only", "1"),
            F.when(inferred, "P3").otherwise("P1"),
            _p("primary is read-only"),
            confirm=inferred,
        ),
        Rule("slave_writable", writable & ~dr, _p("P1"), _p("replica accepts writes")),
        Rule("dr_writable", writable & dr, _p("P3"), _p("DR node accepts writes"), confirm=F.lit(True)),
        Rule(
            "self_ref_slave_residue",
            F.coalesce("is_residue", F.lit(False)),
            _p("P2"),
            F.concat(F.lit("replica status points at the node itself: "), F.col("master_host")),
        ),
        Rule(
            "slave_parallel_workers_zero",
            ~primary & replica & (workers == 0) & (size >= t("replication.parallel_workers_data_gb_p2")),
            F.when(size >= t("replication.parallel_workers_data_gb_p1"), "P1").otherwise("P2"),
            _text("single-threaded replication with %.0f GB of data", size),
            CLUSTER,
        ),
    ]


def design_rules(t) -> list[Rule]:
    business, other = F.col("n_no_pk_business"), F.col("n_no_pk_other")
    rate = F.col("max_auto_rate")
    linux = F.col("os_kernel").rlike(fv.LINUX_KERNEL)
    charset = F.nullif(fleet.variable("character_set_server"), F.lit(""))
    modes = S.sql_mode_set(F.coalesce(F.nullif(F.col("sql_mode"), F.lit("")), fleet.variable("sql_mode")))
    strict = F.array_contains(modes, "STRICT_TRANS_TABLES") | F.array_contains(modes, "STRICT_ALL_TABLES")
    return [
        Rule(
            "no_pk_tables",
            business > 0,
            _p("P2"),
            _text("%d business tables without primary key, e.g. %s", business, F.col("no_pk_example")),
            CLUSTER,
            n_objects=business,
        ),
        Rule(
            "no_pk_tables_temp_only",
            (F.coalesce(business, F.lit(0)) == 0) & (other > 0),
            _p("P3"),
            _text("%d tables without primary key, all temporary or historic", other),
            CLUSTER,
            n_objects=other,
        ),
        Rule(
            "ghost_tables",
            F.col("n_ghost") > 0,
            _p("P2"),
            _text("%d left-over schema change tables, e.g. %s", F.col("n_ghost"), F.col("ghost_example")),
            CLUSTER,
            n_objects=F.col("n_ghost"),
            confirm=F.lit(True),
        ),
        Rule(
            "non_utf8_tables",
            F.col("n_non_utf8") > 0,
            _p("P2"),
            _text("%d tables not in utf8, e.g. %s", F.col("n_non_utf8"), F.col("non_utf8_example")),
            CLUSTER,
            n_objects=F.col("n_non_utf8"),
        ),
        Rule(
            "heavy_frag_tables",
            F.col("n_fragmented") > 0,
            _p("P2"),
            _text("%d heavily fragmented tables, e.g. %s", F.col("n_fragmented"), F.col("frag_example")),
            CLUSTER,
            n_objects=F.col("n_fragmented"),
        ),
        Rule(
            "charset_not_utf8mb4",
            ~charset.rlike("(?i)utf8mb4"),
            _p("P2"),
            F.concat(F.lit("server character set "), charset),
            CLUSTER,
            dimension="dataDesign",
            current=charset,
            recommended=_p("utf8mb4"),
        ),
        Rule(
            "sql_mode_missing_strict",
            (F.size(modes) > 0) & ~strict,
            _p("P2"),
            _p("sql_mode has no strict mode"),
            CLUSTER,
            dimension="dataDesign",
            current=F.array_join(modes, ","),
            recommended=_p("STRICT_TRANS_TABLES"),
        ),
        Rule(
            "auto_increment_exhausting",
            F.col("n_auto_full") > 0,
            F.when(rate >= t("auto_increment.rate_p0"), "P0")
            .when(rate >= t("auto_increment.rate_p1"), "P1")
            .otherwise("P2"),
            _text("auto-increment key %s at %.0f%%", F.col("auto_example"), rate * 100),
            CLUSTER,
            dimension="dataDesign",
            n_objects=F.col("n_auto_full"),
            current=_text("%.0f%%", rate * 100),
            recommended=_p("BIGINT UNSIGNED"),
        ),
        Rule(
            "lct_zero_linux",
            _is("lower_case_table_names", "0") & linux,
            _p("P3"),
            _p("table names are case-sensitive"),
            CLUSTER,
        ),
    ]


def workload_rules(t) -> list[Rule]:
    slow = F.col("slow_queries")
    hit = F.when(F.col("bp_hits") > 0, F.try_divide(F.col("bp_hits") * 100.0, F.col("bp_lookups")))
    mem = fleet.mem_gb()
    pool = F.nullif(S.size_to_mb(fleet.variable("innodb_buffer_pool_size_in_mb"), "innodb_buffer_pool_size_in_mb"), F.lit(0.0))
    share = (pool / 1024) / mem
    advised = S.format_mb(S.recommend_buffer_pool_mb(mem))
    redo = S.size_to_mb(fleet.variable("innodb_log_file_size_in_mb"), "innodb_log_file_size_in_mb")
    data = F.coalesce("db_total_gb", F.lit(0.0))
    busy, heavy = t("innodb.redo_log_db_gb_busy"), t("innodb.redo_log_db_gb_heavy")
    target = F.when(data >= heavy, 2048).when(data >= busy, 1024).otherwise(512)
    ratio = F.try_divide(data, mem)
    return [
        Rule(
            "slow_query_abs_high",
            slow > t("sql.slow_query_abs_high"),
            _p("P1"),
            _text("%d slow queries", slow),
        ),
        Rule(
            "slow_query_abs_med",
            (slow > t("sql.slow_query_abs_med")) & ~(slow > t("sql.slow_query_abs_high")),
            _p("P2"),
            _text("%d slow queries", slow),
        ),
        Rule("slow_log_off", _is("slow_query_log", "0"), _p("P2"), _p("slow log is off")),
        Rule(
            "long_query_time_loose",
            fleet.number("long_query_time") >= t("sql.long_query_time_loose"),
            _p("P3"),
            F.concat(F.lit("long_query_time = "), fleet.variable("long_query_time")),
        ),
        Rule("bp_hit_low", hit < t("innodb.bp_hit_low_pct"), _p("P1"), _text("buffer pool hit rate %.1f%%", hit)),
        Rule(
            "bp_hit_sub99",
            (hit >= t("innodb.bp_hit_low_pct")) & (hit < t("innodb.bp_hit_warn_pct")),
            _p("P3"),
            _text("buffer pool hit rate %.1f%%", hit),
        ),
        Rule(
            "bp_too_small",
            (mem >= t("innodb.bp_too_small_min_mem_gb")) & (share < t("innodb.bp_too_small_ratio")),
            F.when(share < t("innodb.bp_too_small_p1_ratio"), "P1").otherwise("P2"),
            _text("buffer pool is %.0f%% of memory", share * 100),
            dimension="performance",
            current=S.format_mb(pool),
            recommended=advised,
        ),
        Rule(
            "bp_too_large",
            (mem >= t("innodb.bp_too_small_min_mem_gb"))
            & ~(share < t("innodb.bp_too_small_ratio"))
            & (share > t("innodb.bp_too_large_ratio")),
            _p("P1"),
            _text("buffer pool is %.0f%% of memory", share * 100),
            dimension="availability",
            current=S.format_mb(pool),
            recommended=advised,
        ),
        Rule(
            "redo_log_too_small",
            (redo < t("innodb.redo_log_min_mb")) & ((data >= busy) | (F.coalesce("qps", F.lit(0.0)) > 200)),
            F.when(redo < 128, "P1").otherwise("P2"),
            _text("redo log of %.0f MB for %.0f GB of data", redo, data),
            dimension="performance",
            current=S.format_mb(redo),
            recommended=S.format_mb(target),
        ),
        Rule(
            "data_to_memory_ratio_high",
            (data > 0) & (ratio > t("data_memory.ratio_warn")),
            F.when(ratio > t("data_memory.ratio_p1"), "P1").otherwise("P2"),
            _text("data is %.1f times the memory", ratio),
            dimension="performance",
            current=_text("%.1fx", ratio),
            recommended=_text("%d GB of memory", F.ceil(data / 5)),
        ),
        Rule(
            "performance_schema_off",
            _is("performance_schema", "OFF"),
            _p("P2"),
            _p("performance_schema is off"),
            CLUSTER,
            dimension="operations",
            current=_p("OFF"),
            recommended=_p("ON"),
        ),
        Rule(
            "flush_method_not_o_direct",
            F.col("os_kernel").rlike(fv.LINUX_KERNEL)
            & (fleet.variable("innodb_flush_method") != "")
            & ~fleet.variable("innodb_flush_method").isin("O_DIRECT", "O_DIRECT_NO_FSYNC"),
            _p("P2"),
            F.concat(F.lit("innodb_flush_method = "), fleet.variable("innodb_flush_method")),
            CLUSTER,
            dimension="performance",
            current=fleet.variable("innodb_flush_method"),
            recommended=_p("O_DIRECT"),
        ),
    ]


def durability_rules(t) -> list[Rule]:
    config = F.nullif(fleet.variable("innodb_temp_data_file_path"), F.lit(""))
    skip = F.coalesce(
        F.nullif(fleet.variable("slave_skip_errors"), F.lit("")), fleet.variable("replica_skip_errors")
    )
    return [
        Rule(
            "ibtmp1_oversize",
            F.col("temp_bytes") > t("innodb.ibtmp1_max_gb") * S.GIB,
            _p("P2"),
            F.concat(F.lit("temporary tablespace has grown to "), S.fmt_bytes("temp_bytes")),
        ),
        Rule(
            "ibtmp1_no_max",
            ~config.rlike("(?i):max:"),
            _p("P2"),
            F.concat(F.lit("temporary tablespace without limit: "), config),
            CLUSTER,
        ),
        Rule(
            "flush_log_weak",
            _is("innodb_flush_log_at_trx_commit", "0"),
            _p("P1"),
            _p("log is flushed once per second"),
            CLUSTER,
        ),
        Rule("sync_binlog_weak", _is("sync_binlog", "0"), _p("P1"), _p("binlog is not synced"), CLUSTER),
        Rule("gtid_off", _is("gtid_mode", "OFF"), _p("P2"), _p("GTID is off"), CLUSTER),
        Rule("expire_logs_zero", _is("expire_logs_days", "0"), _p("P1"), _p("binlogs never expire")),
        Rule(
            "expire_logs_long",
            ~_is("expire_logs_days", "0")
            & (fleet.number("expire_logs_days") > t("binlog.expire_logs_max_days")),
            _p("P3"),
            F.concat(F.lit("binlogs are kept for days: "), fleet.variable("expire_logs_days")),
        ),
        Rule(
            "doublewrite_off",
            _is("innodb_doublewrite", "OFF", "0"),
            _p("P1"),
            _p("doublewrite is off"),
            CLUSTER,
            dimension="durability",
            current=_p("OFF"),
            recommended=_p("ON"),
        ),
        Rule(
            "slave_skip_errors_set",
            (skip != "") & ~skip.isin("OFF", "NONE", "off"),
            _p("P0"),
            F.concat(F.lit("replication skips errors: "), skip),
            dimension="durability",
            current=skip,
            recommended=_p("OFF"),
        ),
    ]


# Buffers that every connection can allocate.
CONNECTION_BUFFERS = [
    "sort_buffer_size_in_kb", "join_buffer_size_in_kb", "read_buffer_size_in_kb",
    "read_rnd_buffer_size_in_kb", "tmp_table_size_in_mb",
]


def connection_rules(t) -> list[Rule]:
    mem = fleet.mem_gb()
    connections = F.coalesce(fleet.number("max_connections"), F.lit(0.0))
    per = F.lit(0.0)
    for name in CONNECTION_BUFFERS:
        per = per + F.coalesce(S.size_to_mb(fleet.variable(name), name), F.lit(0.0))
    peak = per * connections / (mem * 1024)
    warn = t("max_connections.peak_memory_ratio_warn")
    advised = F.floor(mem * 1024 * warn / F.greatest(per, F.lit(1.0)))
    return [
        Rule(
            "max_connections_vs_memory",
            (connections > 0) & (peak > warn),
            F.when(peak > t("max_connections.peak_memory_ratio_p1"), "P1").otherwise("P2"),
            _text("connection buffers can take %.0f%% of memory", peak * 100),
            dimension="availability",
            current=_text("max_connections=%.0f", connections),
            recommended=_text("max_connections=%d", advised),
        ),
    ]


def security_rules(t) -> list[Rule]:
    def wildcard(level: str, priority: str) -> Rule:
        n = F.col(f"n_open_{level}")
        return Rule(
            f"wildcard_{level}",
            n > 0,
            _p(priority),
            _text("%d " + level + " accounts open to every host, e.g. %s", n, F.col(f"open_{level}_example")),
            CLUSTER,
            # A matter of the cluster, but each node's accounts are reported on their own.
            subject=F.col("node_ip"),
            n_objects=n,
        )

    return [
        wildcard("critical", "P0"),
        wildcard("high", "P1"),
        wildcard("medium", "P2"),
        Rule(
            "tls_weak_protocol",
            S.tls_weak(F.col("tls_config")["tls_version"]),
            _p("P2"),
            F.concat(F.lit("TLS allows "), F.col("tls_config")["tls_version"]),
            CLUSTER,
        ),
        Rule(
            "auth_plugin_native_on_80",
            S.is_version_80_plus("server_version")
            & _is("default_authentication_plugin", "mysql_native_password"),
            _p("P2"),
            _p("default authentication plugin is mysql_native_password"),
            CLUSTER,
            dimension="security",
            current=_p("mysql_native_password"),
            recommended=_p("caching_sha2_password"),
        ),
    ]


def lifecycle_rules(t) -> list[Rule]:
    life = S.server_lifecycle("server_version")

    def version(status: str) -> Rule:
        return Rule(
            f"mysql_version_{status}",
            life["status"] == status,
            life["priority"],
            F.concat(F.lit("server version "), F.col("server_version"), F.lit(f" is in state {status}")),
            CLUSTER,
            subject=life["major"],
        )

    return [version("eol"), version("security")]


FAMILIES = [
    resource_rules,
    replication_rules,
    design_rules,
    workload_rules,
    durability_rules,
    connection_rules,
    security_rules,
    lifecycle_rules,
]


DISK_TYPES = ("disk_critical", "disk_high")


def _by_config(config: Config, *rest) -> tuple:
    return config.columns_key, *(tuple(x) if isinstance(x, list) else x for x in rest)


def _node_rules(config: Config, only: list[str] | None = None) -> list[Rule]:
    rules = [rule for family in FAMILIES for rule in family(config.threshold)]
    return [r for r in rules if only is None or r.type in only]


node_rules = made_once(_node_rules, _by_config)


FIELDS = [
    "type", "priority", "scope", "subject", "dimension", "n_objects",
    "description", "current_value", "recommended_value", "needs_confirmation",
]


class _Structs:
    """Builds one issue struct per rule; the constants they share are made once."""

    def __init__(self) -> None:
        self.names = [F.lit(n) for n in FIELDS]
        self.text = F.lit(None).cast("string")
        self.long = F.lit(None).cast("bigint")
        self.false = F.lit(False)
        self.empty = F.lit("")
        self.node_ip = F.col("node_ip")
        self.literals: dict[str, Column] = {}

    def literal(self, value: str | None) -> Column:
        if value is None:
            return self.text
        if value not in self.literals:
            self.literals[value] = F.lit(value)
        return self.literals[value]

    def __call__(self, rule: Rule) -> Column:
        subject = rule.subject
        if subject is None:
            subject = self.node_ip if rule.scope == NODE else self.empty
        values = [
            self.literal(rule.type),
            rule.priority,
            self.literal(rule.scope),
            subject,
            self.literal(rule.dimension),
            self.long if rule.n_objects is None else rule.n_objects,
            rule.about,
            self.text if rule.current is None else rule.current,
            self.text if rule.recommended is None else rule.recommended,
            self.false if rule.confirm is None else rule.confirm,
        ]
        return F.named_struct(*[c for pair in zip(self.names, values) for c in pair])


def _disk_structs(config: Config, struct: _Structs) -> Column:
    critical, high = config.threshold("disk.critical_pct"), config.threshold("disk.high_pct")

    def issue(d: Column) -> Column:
        pct = d["use_pct"]
        hit = pct >= critical
        rule = Rule(
            "disk",
            hit,
            F.when(hit, "P0").otherwise("P1"),
            F.format_string("disk %s at %d%%", d["mount"], pct),
            subject=F.concat(F.col("node_ip"), F.lit(":"), d["mount"]),
        )
        named = struct(rule).withField("type", F.when(hit, "disk_critical").otherwise("disk_high"))
        return F.when(pct >= F.least(critical, high), named)

    none = F.filter(F.array(struct(Rule("disk", F.lit(False), _p(""), _p("")))), lambda x: F.lit(False))
    return F.coalesce(F.transform("disks", issue), none)


def _wanted(rule: Column, only: list[str] | None) -> Column:
    return F.lit(True) if only is None else rule.isin(only)


def primary_size(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Data size of each cluster's first primary."""
    primary = F.col("role") == "primary"
    return nodes.groupBy(*cluster_keys).agg(
        F.min_by(F.when(primary, F.col("db_total_gb")), F.when(primary, F.col("node_order"))).alias("primary_db_gb")
    )


def _prepare(nodes: DataFrame, config: Config, only: list[str] | None) -> DataFrame:
    facts = nodes
    if only is None or "slave_parallel_workers_zero" in only:
        facts = facts.join(primary_size(nodes), CLUSTER_KEYS, "left")
    return config.attach(facts)


def _issues(config: Config, scope: str | None, disks: bool, only: list[str] | None) -> Column:
    """The rules that fired on a node, as rows."""
    rules = [r for r in node_rules(config, only) if scope is None or r.scope == scope]
    struct, structs = _Structs(), []
    if rules:
        structs.append(F.array(*[F.when(r.when, struct(r)) for r in rules]))
    if disks:
        structs.append(_disk_structs(config, struct))
    found = F.filter(
        F.concat(*structs), lambda i: i.isNotNull() & config.is_enabled(i["type"]) & _wanted(i["type"], only)
    )
    return F.explode(found).alias("i")


_issues_once = made_once(_issues, _by_config)


def _fire(facts: DataFrame, config: Config, scope: str | None, disks: bool, only: list[str] | None, keys: list[str]) -> DataFrame:
    """Explodes the rules that fired on each node."""
    exploded = facts.select(
        *keys,
        "role",
        "node_order",
        *(["cluster_cfg"] if config.cluster_layer is not None else []),
        _issues_once(config, scope, disks, only),
    )
    flat = exploded.select(*[c for c in exploded.columns if c != "i"], "i.*")
    return config.detach(flat.withColumn("priority", config.priority(F.col("type"), F.col("priority"))))


def evaluate_rules(
    nodes: DataFrame, config: Config | None = None, only: list[str] | None = None, keys: list[str] = KEYS
) -> DataFrame:
    """Raw issues, one row per node and fired rule, after disabling and overriding.

    only names the rule types to evaluate; the others then cost nothing.
    """
    config = config or Config()
    disks = only is None or any(t in only for t in DISK_TYPES)
    return _fire(_prepare(nodes, config, only), config, None, disks, only, keys)


def evaluate_by_scope(
    nodes: DataFrame, config: Config | None = None, keys: list[str] = KEYS
) -> tuple[DataFrame, DataFrame]:
    """Raw issues of single nodes and raw issues that a cluster shares, apart.

    Each rule is evaluated in one of the two only, and the first kind never
    has to be merged.
    """
    config = config or Config()
    return (
        _fire(config.attach(nodes), config, NODE, True, None, keys),
        _fire(_prepare(nodes, config, None), config, CLUSTER, False, None, keys),
    )


@made_once
def _disagreements(names: tuple[str, ...]) -> tuple[list[Column], Column]:
    """Bounds of every parameter, and those whose bounds differ, as rows."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for name in names:
        aggregates += [F.min(fleet.variable(name)).alias(f"lo_{name}"), F.max(fleet.variable(name)).alias(f"hi_{name}")]
    found = F.array(
        *[
            F.when(
                F.col(f"lo_{n}") != F.col(f"hi_{n}"),
                F.struct(F.lit(n).alias("name"), F.col(f"lo_{n}").alias("lo"), F.col(f"hi_{n}").alias("hi")),
            )
            for n in names
        ]
    )
    return aggregates, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")


def parameter_issues(
    nodes: DataFrame,
    config: Config | None = None,
    names: list[str] | None = None,
    cluster_keys: list[str] = CLUSTER_KEYS,
) -> DataFrame:
    """One issue per parameter on which the nodes of a cluster disagree.

    Two values differ exactly when the smallest and the largest differ, so a
    partial min/max replaces a distinct count and its extra shuffle.
    """
    config = config or Config()
    names = names or fv.CONSISTENT_PARAMETERS
    aggregates, found = _disagreements(tuple(names))
    rows = nodes.groupBy(*cluster_keys).agg(*aggregates).filter("n > 1").select(*cluster_keys, found)
    none = F.lit(None).cast("string")
    issues = rows.select(
        *cluster_keys,
        none.alias("node_ip"),
        none.alias("role"),
        none.alias("node_order"),
        F.lit("param_inconsistent").alias("type"),
        F.lit("P2").alias("priority"),
        F.lit(CLUSTER).alias("scope"),
        F.col("x.name").alias("subject"),
        none.alias("dimension"),
        F.lit(None).cast("bigint").alias("n_objects"),
        F.format_string("nodes disagree on %s: %s to %s", "x.name", "x.lo", "x.hi").alias("description"),
        none.alias("current_value"),
        none.alias("recommended_value"),
        F.lit(False).alias("needs_confirmation"),
    )
    return apply_config(issues, config)


@made_once
def _advice() -> tuple[Column, Column]:
    actions = F.create_map(*[F.lit(x) for t, (a, _) in ADVICE.items() for x in (t, a)])
    statements = F.create_map(*[F.lit(x) for t, (_, s) in ADVICE.items() if s for x in (t, s)])
    return actions[F.col("type")], statements[F.col("type")]


def with_advice(issues: DataFrame) -> DataFrame:
    """Static action and statement per type, from a literal map; no join."""
    action, statement = _advice()
    return issues.withColumns({"action": action, "sql": statement})
