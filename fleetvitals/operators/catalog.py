"""Catalog, account and index analytics over landed catalog tables.

Every operator takes the key columns it groups by, so it runs per node by
default and per cluster where the caller says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.functions import scalars as S
from fleetvitals.operators.ranking import first_k, top_k

TABLE = ["table_schema", "table_name"]


def _size() -> Column:
    return F.col("data_length") + F.col("index_length")


def _user_tables(df: DataFrame, column: str = "table_schema") -> DataFrame:
    return df.filter(S.outside_system_schemas(column))


def schema_sizes(cat_tables: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Size per schema plus a grand-total row, from one scan."""
    sized = _user_tables(cat_tables).select(*keys, "table_schema", _size().alias("bytes"))
    sets = [[F.col(k) for k in keys] + [F.col("table_schema")], [F.col(k) for k in keys]]
    grouped = sized.groupingSets(sets, *keys, "table_schema").agg(
        F.sum("bytes").alias("bytes"), F.grouping("table_schema").alias("g")
    )
    return grouped.select(
        *keys,
        "table_schema",
        F.col("bytes").cast("bigint").alias("bytes"),
        F.round(F.col("bytes") / S.GIB, 3).alias("size_gb"),
        (F.col("g") == 1).alias("is_total"),
    )


def _truncated_mb(value: Column) -> Column:
    return F.floor(value / S.MIB * 100) / 100.0


def schema_detail(cat_schemata: DataFrame, cat_tables: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows and sizes per schema; schemas without tables stay."""
    # Tables are summed per schema before the join, so the join meets one row per schema.
    sums = cat_tables.groupBy(*keys, "table_schema").agg(
        F.sum("table_rows").alias("table_rows"),
        F.sum("data_length").alias("data"),
        F.sum("index_length").alias("index"),
        F.sum(_size()).alias("all"),
        F.sum("data_free").alias("free"),
    )
    return (
        _user_tables(cat_schemata, "schema_name")
        .withColumnRenamed("schema_name", "table_schema")
        .join(sums, [*keys, "table_schema"], "left")
        .select(
            *keys,
            "table_schema",
            "charset",
            "schema_collation",
            "table_rows",
            _truncated_mb(F.col("data")).alias("data_mb"),
            _truncated_mb(F.col("index")).alias("index_mb"),
            _truncated_mb(F.col("all")).alias("all_mb"),
            _truncated_mb(F.col("free")).alias("free_mb"),
        )
    )


def object_counts(
    cat_tables: DataFrame,
    cat_events: DataFrame,
    cat_triggers: DataFrame,
    cat_routines: DataFrame,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Object counts by schema and type, grouped once after the union."""

    def named(df: DataFrame, schema: str, kind: Column) -> DataFrame:
        return df.select(*keys, F.col(schema).alias("db"), kind.alias("object_type"))

    table_kind = F.when(F.col("table_type") == "BASE TABLE", "TABLE").when(F.col("table_type") == "VIEW", "VIEW")
    objects = (
        named(cat_tables, "table_schema", table_kind)
        .unionByName(named(cat_events, "event_schema", F.lit("EVENT")))
        .unionByName(named(cat_triggers, "trigger_schema", F.lit("TRIGGER")))
        .unionByName(named(cat_routines, "routine_schema", F.upper("routine_type")))
    )
    return (
        objects.filter(F.col("object_type").isin("TABLE", "VIEW", "EVENT", "TRIGGER", "PROCEDURE", "FUNCTION"))
        .groupBy(*keys, "db", "object_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def top_tables(cat_tables: DataFrame, keys: list[str] = KEYS, k: int = 10) -> DataFrame:
    sized = _user_tables(cat_tables).select(*keys, *TABLE, _size().alias("bytes"), "table_rows", "engine")
    order = [F.desc("bytes"), F.asc("table_schema"), F.asc("table_name")]
    return top_k(sized, keys, order, k).withColumn("size_gb", F.round(F.col("bytes") / S.GIB, 3))


def top_indexes(
    cat_index_stats: DataFrame,
    cat_index_columns: DataFrame,
    keys: list[str] = KEYS,
    k: int = 10,
    page_size: int = 16384,
) -> DataFrame:
    """Largest secondary indexes with their ordered column list.

    The top rows are chosen first, so the join touches k indexes per node.
    """
    sized = cat_index_stats.filter(
        ~F.col("index_name").isin("PRIMARY", "GEN_CLUST_INDEX") & (F.col("stat_name") == "size")
    ).select(*keys, *TABLE, "index_name", (F.col("stat_value") * page_size).alias("bytes"))
    order = [F.desc("bytes"), F.asc("table_schema"), F.asc("table_name"), F.asc("index_name")]
    top = top_k(sized, keys, order, k)
    index = [*keys, *TABLE, "index_name"]
    columns = (
        cat_index_columns.join(top.select(*index), index, "left_semi")
        .groupBy(*index)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "col"))).alias("cols"))
        .select(*index, F.array_join(F.transform("cols", lambda c: c["col"]), ",").alias("columns"))
    )
    return top.join(columns, index, "left").withColumn("size_mb", F.round(F.col("bytes") / S.MIB, 2))


def fragmented_tables(
    cat_tables: DataFrame,
    keys: list[str] = KEYS,
    min_bytes: int = 4194304,
    min_rate: float = 0.3,
    k: int | None = None,
) -> DataFrame:
    rate = S.fragment_rate("table_rows", "data_length", "index_length", "data_free")
    rated = (
        _user_tables(cat_tables)
        .filter(_size() > min_bytes)
        .select(*keys, *TABLE, "table_rows", "data_length", "index_length", "data_free", rate.alias("frag_rate"))
        .filter(F.col("frag_rate") > min_rate)
    )
    order = [F.desc("data_free"), F.asc("table_schema"), F.asc("table_name")]
    return first_k(rated, keys, order, k)


def non_utf8_tables(cat_tables: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return (
        _user_tables(cat_tables)
        .filter(~F.col("table_collation").like("utf8%"))
        .select(*keys, *TABLE, "table_collation")
    )


def large_columns(cat_columns: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return (
        _user_tables(cat_columns)
        .filter(F.upper("data_type").isin(fv.LARGE_TYPES))
        .select(*keys, *TABLE, "column_name", "data_type")
    )


def partition_counts(cat_partitions: DataFrame, keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    counts = (
        _user_tables(cat_partitions)
        .groupBy(*keys, *TABLE)
        .agg(F.count(F.lit(1)).alias("n_partitions"))
        .filter("n_partitions > 1")
    )
    return first_k(counts, keys, [F.desc("n_partitions"), *[F.asc(c) for c in TABLE]], k)


def non_base_tables(cat_tables: DataFrame, keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    kept = (
        _user_tables(cat_tables).filter(F.col("table_type") != "BASE TABLE").select(*keys, *TABLE, "table_type")
    )
    return first_k(kept, keys, [F.asc(c) for c in TABLE], k)


def routines(cat_routines: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _user_tables(cat_routines, "routine_schema").select(
        *keys, "routine_schema", "routine_name", "routine_type", "definer"
    )


def schema_charsets(cat_schemata: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _user_tables(cat_schemata, "schema_name").select(*keys, "schema_name", "charset", "schema_collation")


def nonstandard_types(
    cat_columns: DataFrame, keys: list[str] = KEYS, allowed: list[str] | None = None, k: int | None = None
) -> DataFrame:
    kept = (
        _user_tables(cat_columns)
        .filter(~F.upper("data_type").isin(allowed or fv.STANDARD_TYPES))
        .select(*keys, *TABLE, "column_name", "data_type")
    )
    return first_k(kept, keys, [F.asc(c) for c in [*TABLE, "column_name"]], k)


def auto_increment_usage(
    cat_tables: DataFrame, cat_columns: DataFrame, keys: list[str] = KEYS, k: int | None = None
) -> DataFrame:
    """Share of the key range that auto-increment columns have used."""
    counters = _user_tables(cat_tables).filter(
        F.col("auto_increment").isNotNull() & (F.col("table_schema") != "test")
    )
    columns = cat_columns.filter(F.col("extra") == "auto_increment").select(
        *keys, *TABLE, "column_name", "data_type", "column_type"
    )
    rated = counters.select(*keys, *TABLE, "auto_increment").join(columns, [*keys, *TABLE]).select(
        *keys,
        *TABLE,
        "column_name",
        "auto_increment",
        S.auto_increment_rate("auto_increment", "data_type", "column_type").alias("rate"),
    )
    order = [F.desc("rate"), F.desc("auto_increment"), *[F.asc(c) for c in [*TABLE, "column_name"]]]
    return first_k(rated, keys, order, k)


def tables_without_pk(cat_tables: DataFrame, cat_index_columns: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    primary = cat_index_columns.filter(F.col("index_name") == "PRIMARY").select(*keys, *TABLE)
    base = _user_tables(cat_tables).filter(F.col("table_type") == "BASE TABLE")
    return base.join(primary, [*keys, *TABLE], "left_anti").select(*keys, *TABLE, "table_rows")


def non_default_engine(cat_tables: DataFrame, keys: list[str] = KEYS, engine: str = "InnoDB") -> DataFrame:
    return _user_tables(cat_tables).filter(F.col("engine") != engine).select(*keys, *TABLE, "engine")


def engines(cat_engines: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return cat_engines.select(*keys, "engine", "support")


def temp_tablespaces(cat_files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of the temporary tablespace among a server's data files."""
    temporary = F.lower("name").contains("ibtmp") | (F.col("name") == "innodb_temporary")
    return cat_files.filter(temporary).select(*keys, "name", "file_size", "allocated_size", "autoextend_size")


def variable_subset(variables: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    return variables.filter(F.col("name").isin(names)).select(*keys, "name", "value")


def variables_like(variables: DataFrame, pattern: str, keys: list[str] = KEYS) -> DataFrame:
    """Settings of one family, such as version_% or rpl_semi%."""
    return variables.filter(F.col("name").like(pattern)).select(*keys, "name", "value")


def plugins(cat_plugins: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return cat_plugins.filter(F.col("status") == "ACTIVE").select(*keys, "plugin", "version", "type", "library")


def master_status(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys, "file", F.col("position").cast("bigint").alias("position"), "executed_gtid_set")


def binary_logs(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Number and total size of the binary logs per node, with the newest file."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.sum("file_size").cast("bigint").alias("total_bytes"),
        F.max("log_name").alias("last_log"),
    )


def gtid_sets(variables: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    names = ["gtid_executed", "gtid_purged"]
    return variables.filter(F.col("name").isin(names)).groupBy(*keys).pivot("name", names).agg(F.max("value"))


def replication_threads(threads: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    name = F.lower("name")
    wanted = name.contains("slave") | name.contains("replica") | F.col("command").startswith("Binlog")
    return threads.filter(wanted).select(*keys, "thread_id", "name", "command", "state")


def group_members(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys, "member_id", "member_host", "member_state", "member_role")


def connection_status(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys, "channel", "service_state", "last_error_number", "last_error_message")


def applier_status(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per-channel summary of the applier workers."""
    return df.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("n_workers"),
        F.count_if(F.col("service_state") != "ON").alias("n_stopped"),
        F.count_if(F.col("last_error_number") != 0).alias("n_errors"),
    )


# Privilege flags of the account list.
PRIVILEGES = [
    "select_priv", "insert_priv", "update_priv", "delete_priv", "create_priv", "drop_priv",
    "reload_priv", "shutdown_priv", "process_priv", "file_priv", "grant_priv", "super_priv",
    "repl_slave_priv", "repl_client_priv", "create_user_priv",
]


def account_privileges(cat_users: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    present = [p for p in PRIVILEGES if p in cat_users.columns]
    return cat_users.select(*keys, "user_name", "host", "plugin", *present)


def expiring_passwords(
    cat_users: DataFrame, keys: list[str] = KEYS, days: int = 30, as_of: str = "snapshot_date"
) -> DataFrame:
    """Passwords that expire within some days of the snapshot."""
    expires = F.date_add("password_last_changed", F.col("password_lifetime").cast("int"))
    return (
        cat_users.filter(F.col("password_lifetime").isNotNull())
        .withColumn("expire_date", expires)
        .filter(F.datediff("expire_date", F.col(as_of)) < days)
        .select(*keys, F.concat("user_name", F.lit("@"), "host").alias("user_host"), "expire_date")
    )


def connected_users(sessions: DataFrame, keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    pairs = (
        sessions.filter(~F.col("user_name").isin("repl", "system user"))
        .select(*keys, "user_name", "host")
        .distinct()
    )
    return first_k(pairs, keys, [F.asc("user_name"), F.asc("host")], k)


def host_connections(hosts: DataFrame, keys: list[str] = KEYS, k: int = 50) -> DataFrame:
    kept = hosts.select(*keys, "host", "current_connections", "total_connections")
    return top_k(kept, keys, [F.desc("total_connections"), F.asc("host")], k)


def failed_login_hosts(host_cache: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    kept = host_cache.select(*keys, "ip", "host", "connect_errors", "handshake_errors", "auth_errors")
    return top_k(kept, keys, [F.desc("connect_errors"), F.asc("ip"), F.asc("host")], k)


def logins_by_user_ip(sessions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    by_ip = sessions.withColumn("login_ip", S.login_ip("host"))
    return by_ip.groupBy(*keys, "user_name", "login_ip").agg(F.count(F.lit(1)).alias("cnt"))


def logins_by_db_user_ip(sessions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    by_ip = sessions.withColumn("login_ip", S.login_ip("host"))
    return by_ip.groupBy(*keys, "db", "user_name", "login_ip").agg(F.count(F.lit(1)).alias("cnt"))


def unused_indexes(index_usage: DataFrame, keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    """Secondary non-unique indexes that were never used."""
    kept = (
        _user_tables(index_usage)
        .filter(
            F.col("index_name").isNotNull()
            & (F.col("index_name") != "PRIMARY")
            & (F.col("non_unique") == 1)
            & (F.col("count_star") == 0)
        )
        .select(*keys, *TABLE, "index_name")
    )
    return first_k(kept, keys, [F.asc(c) for c in [*TABLE, "index_name"]], k)


def redundant_indexes(cat_index_columns: DataFrame, keys: list[str] = KEYS, k: int | None = None) -> DataFrame:
    """Indexes whose columns are a left prefix of, or equal to, those of another index.

    A server allows 64 indexes of 16 columns per table, so one table's index
    list is small and its pairs are compared inside the row after one shuffle.
    """
    per_table = (
        _user_tables(cat_index_columns)
        .groupBy(*keys, *TABLE)
        .agg(F.array_sort(F.collect_list(F.struct("index_name", "seq", "col", "non_unique"))).alias("parts"))
    )
    names = F.array_distinct(F.transform("parts", lambda p: p["index_name"]))

    def index(name: Column) -> Column:
        own = F.filter("parts", lambda p: p["index_name"] == name)
        return F.struct(
            name.alias("name"),
            F.transform(own, lambda p: p["col"]).alias("cols"),
            F.get(own, F.lit(0))["non_unique"].alias("non_unique"),
        )

    indexed = per_table.select(*keys, *TABLE, F.transform(names, index).alias("ix"))

    def sort_name(i: Column) -> Column:
        return F.when(i["name"] == "PRIMARY", "").otherwise(i["name"])

    def is_prefix(short: Column, long: Column) -> Column:
        n = F.size(short["cols"])
        return (n < F.size(long["cols"])) & (F.slice(long["cols"], F.lit(1), n) == short["cols"])

    def covers(a: Column, b: Column) -> Column:
        same = a["cols"] == b["cols"]
        loses = (a["non_unique"] > b["non_unique"]) | (
            (a["non_unique"] == b["non_unique"]) & (sort_name(a) > sort_name(b))
        )
        return (a["name"] != b["name"]) & (
            (same & loses)
            | (is_prefix(a, b) & (a["non_unique"] == 1))
            | (is_prefix(b, a) & (b["non_unique"] == 0))
        )

    pairs = (
        indexed.select(*keys, *TABLE, "ix", F.explode("ix").alias("a"))
        .select(*keys, *TABLE, "a", F.explode("ix").alias("b"))
        .filter(covers(F.col("a"), F.col("b")))
        .select(
            *keys,
            *TABLE,
            F.col("a.name").alias("redundant_index"),
            F.col("b.name").alias("dominant_index"),
            F.array_join("a.cols", ",").alias("redundant_columns"),
            F.array_join("b.cols", ",").alias("dominant_columns"),
        )
    )
    order = [F.asc(c) for c in [*TABLE, "redundant_index", "dominant_index"]]
    return first_k(pairs, keys, order, k)


def low_cardinality(
    cat_index_stats: DataFrame,
    cat_table_stats: DataFrame,
    keys: list[str] = KEYS,
    pct: float = 10,
    min_rows: int = 1000,
    k: int = 50,
) -> DataFrame:
    distinct = _user_tables(cat_index_stats).filter(
        (F.col("index_name") != "PRIMARY") & F.col("stat_name").startswith("n_diff_pfx") & (F.col("stat_value") > 0)
    )
    big = cat_table_stats.filter(F.col("n_rows") > min_rows).select(*keys, *TABLE, "n_rows")
    rated = (
        distinct.select(*keys, *TABLE, "index_name", "stat_name", "stat_value")
        # Both sides have rows per table or index: never one hash table of a whole side, which compressed files make look small.
        .join(big.hint("merge"), [*keys, *TABLE])
        .withColumn("selectivity_pct", F.round(F.col("stat_value") * 100.0 / F.col("n_rows"), 2))
        .filter(F.col("selectivity_pct") < pct)
    )
    order = [F.asc("selectivity_pct"), *[F.asc(c) for c in [*TABLE, "index_name", "stat_name"]]]
    return top_k(rated, keys, order, k)


def full_scanned_tables(index_usage: DataFrame, keys: list[str] = KEYS, k: int = 20) -> DataFrame:
    kept = index_usage.filter(F.col("index_name").isNull() & (F.col("count_read") > 0)).select(
        *keys, *TABLE, F.col("count_read").alias("rows_full_scanned"), "latency_us"
    )
    return top_k(kept, keys, [F.desc("rows_full_scanned"), *[F.asc(c) for c in TABLE]], k)
